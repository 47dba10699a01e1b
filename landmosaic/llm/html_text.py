"""Main text of HTML pages by a tree-structured graphical model.

A page becomes a tree of elements. Each element is content or not: a unary potential comes from what the element is
(its tag, words of its class and id, its share of link text), a pairwise potential from the states of parent
and child and the child's kind of tag. Sum-product messages run from the leaves to the root and back, which gives the
exact marginal of every element; blocks whose innermost element is content with a marginal over one half are the text.

The potentials are fitted to the likelihood of whole labelled trees. Labelled pages are at most about TRAINING pages (chosen by
a hash of their ids) of at most TRAINING_CHARS characters that mark their article by an article tag, whose elements are
labelled by that mark, and a few built-in page skeletons. All are also shown in other guises, with the same labels: other
article elements, and side bars, notices, comments, forms and the like put in. The article mark itself is then one feature of
many, and pages without it are read too. If no page of the table marks its article, the model is that of the skeletons alone.

Pages are read by a scanner in linear time, whatever they hold. Null or empty pages give an empty text. Scripts, styles,
comments, templates and form controls never count as text. A tag that is never closed ends with its parent; stray end tags are
passed over; unclosed paragraphs and list items end where the next begins; a quote that is never closed ends with its tag; a
page that ends within a tag ends before it. Rows are independent: repeated rows and ids have no effect on each other. An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from math import exp, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRAINING, TRAINING_CHARS = 120, 200_000  # pages that training takes, and the longest that it takes
STEPS, RATE, PENALTY = 200, 0.1, 1e-5
HASHED = 64  # features for class and id words that aren't known words

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg select button object canvas audio video xmp noembed".split())
FOREIGN = frozenset(["svg", "math"])
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": ("li", frozenset(["ul", "ol", "menu"])), "dt": ("dt dd", frozenset(["dl"])), "dd": ("dt dd", frozenset(["dl"])), "tr": ("tr td th", frozenset(["table"])), "td": ("td th", frozenset(["tr", "table"])), "th": ("td th", frozenset(["tr", "table"]))}
KINDS = {"article": "article main", "section": "section div body html", "edge": "nav header footer aside form menu dialog fieldset", "prose": "p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption table tbody tr td th", "list": "ul ol li dl dt dd", "inline": ""}
KIND_OF = {t: i for i, ts in enumerate(KINDS.values()) for t in ts.split()}
TAGS = "article main section div body html nav header footer aside form menu dialog fieldset p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption table tbody tr td th ul ol li dl dt dd a b i em strong span code label address details summary".split()
BAD = "ad ads adv advert advertisement sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside widget header masthead footer foot bottom comment comments reply replies discussion disqus cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login share social related recommended recommendations toolbar pagination pager copyright legal form search tags hidden".split()
GOOD = "article content post entry story main body text page prose blog hentry".split()
TAG_AT = {t: i for i, t in enumerate(TAGS)}
WORD_AT = {w: i for i, w in enumerate(BAD + GOOD)}
N_SHAPE = 5
N_FEATURES = len(TAGS) + 1 + len(WORD_AT) + 2 + HASHED + N_SHAPE

OPEN = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z]|/)")
NAME, GAP, KEY, EQUALS, VALUE = (re.compile(x) for x in (r"[^\s/>]+", r"[\s/]*", r"[^\s/>][^\s/>=]*", r"\s*=\s*", r"[^\s>]*"))
COMMENT_END = re.compile(r"--!?>")
RAW_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
WHOLE = frozenset("script style textarea title xmp noembed iframe".split())  # without an end they last to the page's
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
SPACE = re.compile(r"\s+")


class Tree:
    """Elements in page order: parent, tag, words of class, id and role; texts with their element.

    marks: places in the page and the label (0 or 1) of the elements that begin from there on; for training."""

    def __init__(self, page: str, marks: list[tuple[int, int]] = ()):
        self.page = page
        self.parent, self.tag, self.names, self.label = [-1], ["html"], [()], [0]
        self.texts: list[tuple[int, int, str]] = []  # element, number of its block, text
        self.block = 0
        self.open = [0]
        self.where: dict[str, list[int]] = {}  # places in `open` of each tag
        self.blocks: list[int] = []  # and of blocks
        self.last_quote = {q: page.rfind(q) for q in "\"'"}
        at = k = state = 0
        known: dict[tuple, tuple] = {}
        endless: set[str] = set()  # raw elements of which no end tag follows
        while m := OPEN.search(page, at):
            start, at = m.span()
            if start > (done := self.done):
                self.text(self.open[-1], page[done:start])
            while k < len(marks) and marks[k][0] <= start:
                state, k = marks[k][1], k + 1
            kind = m[0]
            if kind == "<!--":
                if page.startswith((">", "->"), at):
                    at = page.index(">", at) + 1
                else:
                    end = COMMENT_END.search(page, at)
                    at = end.end() if end else len(page)
            elif kind in ("<!", "<?", "</"):
                at = page.find(">", at) + 1 or len(page)
            else:
                name = NAME.match(page, at - 1)
                at, values, closed = self.attributes(name.end())
                if not at:  # the page ends within the tag
                    at = len(page)
                elif kind[1] == "/":
                    self.end(name[0].lower())
                else:
                    tag = name[0].lower()
                    names = ()
                    if values:
                        names = known.get(values)
                        if names is None:
                            names = known[values] = tuple(dict.fromkeys(p.lower() for v in values for p in PARTS.findall(v)))
                    at = self.begin(tag, names, closed, at, state, endless)
            self.done = at
        if self.done < len(page):
            self.text(self.open[-1], page[self.done :])
        del self.page, self.open, self.where, self.blocks

    done = 0  # up to where the page is read

    def attributes(self, at: int) -> tuple[int, tuple[str, ...], bool]:
        """Place after a tag's end (0 if there is none), values of its class, id and role, and whether it closes itself."""
        page, values, bare = self.page, [], -1  # bare: where a value without quotes ended, a slash of its own included
        while True:
            at = GAP.match(page, at).end()
            if at >= len(page):
                return 0, (), False
            if page[at] == ">":
                return at + 1, tuple(values), page[at - 1] == "/" and at != bare
            key = KEY.match(page, at)
            at, value = key.end(), ""
            equals = EQUALS.match(page, at)
            if equals:
                at = equals.end()
                quote = page[at : at + 1]
                if quote in ("'", '"'):
                    if at >= self.last_quote[quote]:  # never closed
                        end = page.find(">", at)
                        if end < 0:
                            return 0, (), False
                        value, at = page[at + 1 : end], end
                    else:
                        end = page.index(quote, at + 1)
                        value, at = page[at + 1 : end], end + 1
                else:
                    found = VALUE.match(page, at)
                    value, at = found[0], found.end()
                    bare = at
            if value and key[0].lower() in ("class", "id", "role"):
                values.append(value)

    def begin(self, tag: str, names: tuple, closed: bool, at: int, state: int, endless: set[str]) -> int:
        """A start tag; the place from which to read on. Only foreign elements can close themselves: elsewhere, as browsers do,
        the slash of <div/> is passed over."""
        closed = closed and tag in FOREIGN
        if tag in VOID:
            if tag == "hr":
                self.block += 1
            elif tag == "br":
                self.text(self.open[-1], " ")
            return at
        if tag in RAW:
            if tag not in WHOLE and closed:
                return at
            end = None if tag in endless else RAW_ENDS[tag].search(self.page, at)
            if end:
                return self.page.find(">", end.end()) + 1 or len(self.page)
            endless.add(tag)
            return len(self.page) if tag in WHOLE else at
        if tag in BLOCK:
            self.block += 1
            if self.blocks and self.tag[self.open[self.blocks[-1]]] in ("p", "head"):
                self.cut(self.blocks[-1])
            if tag in CLOSES:  # the item before in the same list or table
                last = lambda tags: max((self.where[t][-1] for t in tags if self.where.get(t)), default=-1)
                item = last(CLOSES[tag][0].split())
                if item > last(CLOSES[tag][1]):
                    self.cut(item)
        if tag == "html" and len(self.parent) == 1:
            return at
        self.parent.append(self.open[-1])
        self.tag.append(tag)
        self.names.append(names)
        self.label.append(state)
        if not closed:
            self.where.setdefault(tag, []).append(len(self.open))
            if tag in BLOCK or tag == "head":
                self.blocks.append(len(self.open))
            self.open.append(len(self.parent) - 1)
        return at

    def end(self, tag: str) -> None:
        if tag in BLOCK:
            self.block += 1
        places = self.where.get(tag)
        if places and (tag in BLOCK or not self.blocks or places[-1] >= self.blocks[-1]):
            self.cut(places[-1])

    def cut(self, place: int) -> None:
        """Ends all that is open from that place on."""
        while len(self.open) > place:
            tag = self.tag[self.open.pop()]
            self.where[tag].pop()
            if tag in BLOCK or tag == "head":
                self.blocks.pop()

    def text(self, element: int, raw: str) -> None:
        self.texts.append((element, self.block, entities.unescape(raw) if "&" in raw else raw))

    def features(self) -> np.ndarray:
        """Rows of unary features."""
        n = len(self.parent)
        x = np.zeros((n, N_FEATURES), np.float32)
        total, linked = [0.0] * n, [0.0] * n
        for element, _, text in self.texts:
            total[element] += len(text.strip())
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            if self.tag[i] == "a":
                linked[i] = total[i]
            total[p] += total[i]
            linked[p] += linked[i]
        base = len(TAGS) + 1
        for i, (tag, names) in enumerate(zip(self.tag, self.names, strict=True)):
            x[i, TAG_AT.get(tag, len(TAGS))] = 1
            for w in names:
                k = WORD_AT.get(w)
                if k is not None:
                    x[i, base + k] = 1
                    x[i, base + len(WORD_AT) + (k >= len(BAD))] = 1
                else:
                    x[i, base + len(WORD_AT) + 2 + sum(w.encode()) % HASHED] = 1
        total, linked = np.array(total), np.array(linked)
        share = linked / np.maximum(total, 1)
        shape = x[:, -N_SHAPE:]
        shape[:, 0] = 1
        shape[:, 1] = share
        shape[:, 2] = share > 0.6
        shape[:, 3] = total == 0
        shape[:, 4] = np.array([p == 0 for p in self.parent])
        return x

    def kinds(self) -> np.ndarray:
        return np.array([KIND_OF.get(t, len(KINDS) - 1) for t in self.tag])


class Model:
    """weights: of the unary features, for content; pairs: log potential by kind of child, state of parent, state of child."""

    def __init__(self, weights: np.ndarray, pairs: np.ndarray):
        self.weights, self.pairs = weights, pairs

    def marginals(self, tree: Tree) -> np.ndarray:
        """Probability of content of each element, by sum-product in both directions (elements stand after their parents)."""
        n = len(tree.parent)
        unary = np.zeros((n, 2))
        unary[:, 1] = tree.features() @ self.weights
        up = unary.tolist()  # log potentials, then with the messages from below
        pair = self.pairs[tree.kinds()].tolist()
        sent = [(0.0, 0.0)] * n
        lae = _log_add
        for i in range(n - 1, 0, -1):
            a, b = up[i]
            (s00, s01), (s10, s11) = pair[i]
            sent[i] = m0, m1 = lae(s00 + a, s01 + b), lae(s10 + a, s11 + b)
            p = up[tree.parent[i]]
            p[0] += m0
            p[1] += m1
        belief = up  # from here with the message from above
        for i in range(1, n):
            p, (m0, m1) = belief[tree.parent[i]], sent[i]
            a, b = p[0] - m0, p[1] - m1
            (s00, s01), (s10, s11) = pair[i]
            belief[i][0] += lae(a + s00, b + s10)
            belief[i][1] += lae(a + s01, b + s11)
        odds = np.array([b - a for a, b in belief])
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))

    def text(self, page: str) -> str:
        if not page:
            return ""
        tree = Tree(page)
        content = (self.marginals(tree) > 0.5).tolist()
        blocks: dict[int, list[str]] = {}
        for element, block, text in tree.texts:
            if content[element]:
                blocks.setdefault(block, []).append(text)
        lines = (SPACE.sub(" ", "".join(b)).strip() for b in blocks.values())
        return "\n".join(line for line in lines if line)


def _log_add(a: float, b: float) -> float:
    d = a - b
    if d > 0:
        return a + (log1p(exp(-d)) if d < 40 else 0.0)
    return b + (log1p(exp(d)) if d > -40 else 0.0)

# ---------------------------------------------------------------- training

ARTICLES = ['<article>', '<article class="post">', "<main>", '<main id="content">', '<div class="content">', '<div id="article-body">', '<section class="post-content">', '<div class="entry">', '<div role="main">', '<div class="story text">']
ASIDES = [
    '<aside>{0}</aside>', '<aside class="related"><h2>{1}</h2><p>{0}</p></aside>', '<div class="sidebar"><h3>{1}</h3><p>{0}</p><ul><li><a href="/">{1}</a></li></ul></div>', '<div id="sidebar">{0}</div>',
    '<header><h2>{1}</h2><p>{0}</p></header>', '<header class="site-header"><a href="/">{1}</a></header>', '<div class="header">{0}</div>', '<div class="cookie-notice">{0} <button>{1}</button></div>', '<div class="notice"><p>{0}</p></div>',
    '<div class="alert">{0}</div>', '<div class="ad">{0}</div>', '<div class="advert"><p>{0}</p></div>', '<section class="ads">{0}</section>', '<div class="banner sponsored">{0}</div>', '<p class="ad">{0}</p>', '<p class="advert">{0}</p>', '<p class="notice">{0}</p>',
    '<form><label>{1}</label><input name="q"><p>{0}</p></form>', '<form class="newsletter"><p>{0}</p></form>', '<div class="subscribe"><p>{0}</p></div>', '<div class="comments"><h3>{1}</h3><p>{0}</p></div>',
    '<section id="comments"><div class="comment"><p>{0}</p></div><div class="comment"><p>{2}</p></div></section>', '<ol class="comment-list"><li>{0}</li><li>{2}</li></ol>', '<div class="comment"><b>{1}</b><p>{0}</p></div>', '<ul class="menu"><li><a href="/">{1}</a></li><li><a href="/">{1}</a></li></ul>',
    '<nav>{0}</nav>', '<nav class="breadcrumb"><a href="/">{1}</a> <a href="/">{1}</a></nav>', '<div class="related-posts"><a href="/">{0}</a></div>', '<div class="share"><a href="/">{1}</a></div>', '<footer><p>{0}</p></footer>', '<div id="footer">{0}</div>', '<div class="popup modal"><p>{0}</p></div>', '<div role="navigation">{0}</div>',
]
PARAGRAPHS = ["<p>{0}</p>", "<blockquote>{0}</blockquote>", "<ul><li>{0}</li><li>{1}</li></ul>", "<h2>{1}</h2>", "<pre>{0}</pre>", "<table><tr><td>{1}</td><td>{0}</td></tr></table>", "<div>{0}</div>", "<figure><figcaption>{1}</figcaption></figure>", '<p>{0} <a href="/">{1}</a></p>', "<section><h3>{1}</h3><p>{0}</p></section>", "<p><em>{1}</em></p>", "<dl><dt>{1}</dt><dd>{0}</dd></dl>", '<p><a href="/">{1}</a></p>', "<p>{1}</p>"]


#: Pages for tables in which no page marks its article; and some more for all others.
SKELETONS = [
    "<html><head><title>{1}</title></head><body><nav><ul><li><a href='/'>{1}</a></li><li><a href='/'>{1}</a></li></ul></nav><article><h1>{1}</h1><p>{0}</p><p>{0}</p></article><footer>{1}</footer></body></html>",
    "<html><body><div class='header'><a href='/'>{1}</a></div><div class='menu'><a href='/'>{1}</a> <a href='/'>{1}</a></div><article><p>{0}</p><ul><li>{1}</li><li>{1}</li></ul><p>{2}</p></article><div class='footer'>{1}</div></body></html>",
    "<html><body><article><h1>{1}</h1><div><p>{0}</p></div><blockquote>{2}</blockquote></article><aside><a href='/'>{1}</a></aside></body></html>",
    "<html><body><div class='ad'>{2}</div><article><p>{0}</p></article><footer><p>{2}</p></footer></body></html>",
]
FILLER = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()


def _some(words: list[str], rng: np.random.Generator, least: int, most: int) -> str:
    k = int(rng.integers(least, most))
    a = int(rng.integers(0, max(1, len(words) - k)))
    return " ".join(words[a : a + k])


def _said(forms: list[str], words: list[str], rng: np.random.Generator) -> str:
    return forms[int(rng.integers(len(forms)))].format(_some(words, rng, 4, 60), _some(words, rng, 1, 4), _some(words, rng, 2, 20))


def guises(page: str, rng: np.random.Generator, n: int = 4) -> Iterator[Tree]:
    """The page, and the page in other guises; elements are labelled as inside the article and in nothing put in."""
    m = re.search(r"<article\b[^>]*>(.*)</article>", page, re.S | re.I)
    if not m:
        return
    words = re.sub(r"<[^>]*>|[{}]", " ", m[0]).split() or ["text"]

    def tree(pieces: list[tuple[int, str]]) -> Tree:
        marks, at = [], 0
        for state, piece in pieces:
            marks.append((at, state))
            at += len(piece)
        return Tree("".join(x for _, x in pieces), marks)

    wrong = lambda most: [(0, _said(ASIDES, words, rng)) for _ in range(int(rng.integers(0, most)))]
    head, tail = (0, page[: m.start()]), (0, page[m.end() :])
    yield tree([head, (1, m[0]), tail])
    for i in range(n):
        whole = m[1] if i % 2 else "".join(_said(["<h1>{1}</h1>", "<h1>{2}</h1><p>{1}.</p>", "<p>{0}</p>", "<p>{2}</p><p>{1}</p>", "<h1>{1}</h1><p>{2}</p>"], words, rng) for _ in range(int(rng.integers(1, 3))))  # short ones too
        start = ARTICLES[int(rng.integers(len(ARTICLES)))]
        pieces = [(1, _said(PARAGRAPHS, words, rng)) for _ in range(int(rng.integers(0, 6)) if i % 2 else 0)] + [(1, whole)] + wrong(4)
        body = [(1, start), *(pieces[k] for k in rng.permutation(len(pieces))), (1, f"</{re.match(r'<(\w+)', start)[1]}>")]
        yield tree([head, *wrong(4), *body, *wrong(4), tail])


class Forest:
    """Trees side by side, by depth, for messages to all of them at once."""

    def __init__(self, trees: list[Tree]):
        base = np.cumsum([0, *(len(t.parent) for t in trees)])
        self.x = np.concatenate([t.features() for t in trees])
        self.kind = np.concatenate([t.kinds() for t in trees])
        self.label = np.concatenate([np.array(t.label) for t in trees])
        self.parent = np.concatenate([np.where(np.array(t.parent) < 0, -1, np.array(t.parent) + b) for t, b in zip(trees, base, strict=False)])
        depth = np.zeros(len(self.parent), np.int64)
        for i, p in enumerate(self.parent.tolist()):  # elements stand after their parents
            if p >= 0:
                depth[i] = depth[p] + 1
        self.levels = [np.flatnonzero(depth == d) for d in range(1, int(depth.max()) + 1)]
        self.inner = np.flatnonzero(self.parent >= 0)

    def expected(self, unary: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginal of each element, and joint probability (states of parent and child) for each element with a parent."""
        up = np.zeros((len(unary), 2))
        up[:, 1] = unary
        sent = np.zeros_like(up)
        pair = pairs[self.kind]
        for i in reversed(self.levels):
            t = pair[i] + up[i][:, None, :]
            sent[i] = np.logaddexp(t[:, :, 0], t[:, :, 1])
            np.add.at(up, self.parent[i], sent[i])
        belief, joint = up.copy(), np.zeros((len(unary), 2, 2))
        for i in self.levels:
            t = (belief[self.parent[i]] - sent[i])[:, :, None] + pair[i] + up[i][:, None, :]
            belief[i] = np.logaddexp(t[:, 0], t[:, 1])
            t = np.exp(t - t.max(axis=(1, 2), keepdims=True))
            joint[i] = t / t.sum(axis=(1, 2), keepdims=True)
        return 1 / (1 + np.exp(-np.clip(belief[:, 1] - belief[:, 0], -500, 500))), joint


def train(pages: list[str]) -> Model:
    """The potentials of the largest (penalised) likelihood of the labels of whole trees, by Adam."""
    rng = np.random.default_rng(42)
    skeletons = [s.format(" ".join(rng.choice(FILLER, int(rng.integers(8, 60)))), " ".join(rng.choice(FILLER, int(rng.integers(1, 4)))), " ".join(rng.choice(FILLER, int(rng.integers(3, 20))))) for s in SKELETONS * 5]
    f = Forest([t for page in pages + skeletons for t in guises(page, rng)])
    k = 4 * len(KINDS)
    w, n = np.zeros(N_FEATURES + k), len(f.inner)
    state = f.label[f.parent[f.inner]] * 2 + f.label[f.inner]
    seen = np.bincount(f.kind[f.inner] * 4 + state, minlength=k)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        marginal, joint = f.expected(f.x @ w[:N_FEATURES].astype(np.float32), w[N_FEATURES:].reshape(-1, 2, 2))
        there = np.zeros((len(KINDS), 4))
        np.add.at(there, f.kind[f.inner], joint[f.inner].reshape(-1, 4))
        g = np.concatenate([f.x.T @ (marginal - f.label).astype(np.float32), there.ravel() - seen]) / n + PENALTY * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(w[:N_FEATURES], w[N_FEATURES:].reshape(-1, 2, 2))


def fit(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", most: int = TRAINING) -> Model:
    """A model of a bounded sample of the pages that mark their article."""
    html = F.col(html_col)
    marked = pages.where(html.contains("<article") & html.contains("</article>") & (F.length(html) <= TRAINING_CHARS))
    n = marked.count()
    draw = F.pmod(F.xxhash64(F.lit("page"), id_col), F.lit(1_000_003)) / 1_000_003
    rows = marked.where(draw < (most / n if n > most else 2)).select(html.alias("page"), F.xxhash64(id_col).alias("at"))
    return train([r[0] for r in rows.orderBy("at", "page").limit(2 * most).collect()])


def extracted(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", url_col: str = "url", model: Model | None = None) -> DataFrame:
    """id, url, text, n_chars of each page. A model can be given; else it is trained on the pages themselves."""
    model = model or fit(pages, html_col, id_col)
    schema = T.StructType([pages.schema[id_col], T.StructField(url_col, T.StringType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model.text(x.as_py() or "") for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], schema.names)

    rows = pages.select(id_col, F.col(url_col).cast("string").alias(url_col), html_col).mapInArrow(run, schema)
    return rows.withColumn("n_chars", F.length("text").cast("long"))
