"""Texts off the beaten track cost what plain ones cost, and give the libraries' ids; ids and markup of odd kinds."""

import random
import time
from decimal import Decimal

import numpy as np
import public_tokenizers
import pytest

from landmosaic.llm import decontam, html_text, piece_codec, token_files

EDGE = [
    "", " ", "  ", "   ", "a", " a", "a ", "  a  b  ", "a  ", "\n", " \n ", "▁", "a ▁ b", "  ▁", "é  ", "x" * 300 + "  y", "-" * 1000, "\xa0 a", "漢" * 500, "I'LL don't 's '' 'x it's<|endoftext|>'s", "Å B", "a\x85b c\x1cd", "   x",
]


def odd_texts(n):
    rng = random.Random(n)
    return EDGE + ["".join(rng.choice(" ab▁é漢-'s\t\n<>") for _ in range(rng.randrange(12))) for _ in range(n)]


@pytest.fixture(scope="module")
def codec():
    return piece_codec.PieceCodec(public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces_of_odd_blanks_are_the_librarys(codec):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = odd_texts(1500)
    for k in range(0, len(texts), 100):
        for t, (ids, starts, ends, decoded) in zip(texts[k : k + 100], codec.encoded(texts[k : k + 100]), strict=True):
            got = np.frombuffer(ids, "<u4")
            assert got.tolist() == [1, *lib.encode(t), 2] and decoded == lib.decode(got.tolist()), repr(t)
            a, b = codec.spans(t, got[1:-1]) if len(got) > 2 else ((), ())
            assert np.frombuffer(starts, "<u4")[1:-1].tolist() == list(a) and np.frombuffer(ends, "<u4")[1:-1].tolist() == list(b), repr(t)


def test_words_of_odd_texts_are_the_librarys():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib, ours, texts = Tokenizer.from_file(path), token_files.WordTokenizer(path), odd_texts(1500)
    for k in range(0, len(texts), 200):
        for t, ids in zip(texts[k : k + 200], ours(texts[k : k + 200]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def prose(seed, n=400):
    rng = random.Random(seed)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    return [" ".join(rng.choice(words) for _ in range(300)) + "." for _ in range(n)]


SHAPES = {
    "double blank": lambda t: t.replace(" ", "  ", 1), "outer blanks": lambda t: f" {t}  ", "tabs": lambda t: t.replace(" ", "\t", 3), "contraction": lambda t: f"{t} don't",
    "curly quotes": lambda t: f"“{t}”", "emoji": lambda t: f"{t} 😀", "unspaced script": lambda t: f"{t} 漢字かな交じり文。",
}


def cost(run):
    """CPU seconds, the least of some."""
    best = 1e9
    for _ in range(4):
        began = time.process_time()
        run()
        best = min(best, time.process_time() - began)
    return best


@pytest.mark.parametrize("shape", SHAPES)
def test_odd_texts_cost_what_plain_ones_cost(codec, shape):
    plain = prose(1)
    odd = [SHAPES[shape](t) for t in plain]
    path = public_tokenizers.path("word_bpe_49k.json")

    def pieces(texts):
        codec.known = [{}, {}]
        for k in range(0, len(texts), 50):
            codec.encoded(texts[k : k + 50])

    # 1.3 as measured on a quiet machine; the rest is for a busy one
    assert cost(lambda: pieces(odd)) < 1.8 * cost(lambda: pieces(plain)) + 0.05
    words = lambda texts: token_files.WordTokenizer(path)(texts)
    assert cost(lambda: words(odd)) < 1.8 * cost(lambda: words(plain)) + 0.05


def test_a_long_text_with_one_double_blank(codec):
    text = " ".join(prose(2, 2000))[:5_000_000]
    began = time.process_time()
    codec.encoded([f"{text[:1000]}  {text[1000:]}"])
    assert time.process_time() - began < 10


@pytest.mark.parametrize(("kind", "ids"), [("int", [7, 8]), ("string", ["x", "y"]), ("decimal(10,0)", [Decimal(7), Decimal(8)]), ("date", None)])
def test_items_with_ids_of_any_type(spark, kind, ids):
    import datetime

    ids = ids or [datetime.date(2024, 1, 1), datetime.date(2024, 1, 2)]
    passage = "the quick brown fox jumps over the lazy dog near the river bank today"
    items = spark.createDataFrame(list(zip(ids, [passage, "nothing of this kind stands anywhere in the given documents at all"], strict=True)), f"item_id {kind}, text string")
    docs = spark.createDataFrame([(1, f"before it {passage} and after"), (2, "clean text of some words that match nothing whatsoever here")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.leaks(docs, items).collect()] == [(1, ids[0])]


@pytest.mark.parametrize("tag", ["<div class=ad/>", "<div class='ad'>", '<div class="ad" />', "<div class='ad'/>", "<a href=/x/ class=ad>", "<a class='ad' href=/x/>"])
def test_a_slash_closes_nothing_but_foreign_elements(tag):
    tree = html_text.Tree(f"<body><p>before</p>{tag}buy this</{tag[1:].split()[0].strip('>')}><p>after</p></body>")
    holder = [i for i, t in enumerate(tree.tag) if t in ("div", "a")]
    assert len(holder) == 1
    said = [i for i, t in enumerate(tree.tag) if tree.parent[i] == holder[0]] or holder
    assert said and all(tree.parent[i] == holder[0] for i in said if i != holder[0])
    paragraphs = [i for i, t in enumerate(tree.tag) if t == "p"]
    assert len(paragraphs) == 2 and all(tree.tag[tree.parent[i]] == "body" for i in paragraphs)
