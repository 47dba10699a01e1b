"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters of the lower-cased text (what is not a letter counts as a space, runs of spaces as
one) are hashed to DIMS features. Document frequencies cover all labelled training rows. The classifier is fitted by
follow-the-regularised-leader (FTRL-proximal) with L1 and L2 penalties on at most about PER_LANGUAGE different texts of
each language, chosen by a hash of the text, every fifth of which sets the temperature that calibrates the scores. Ids play no
part in it, so they may be null or repeated, and however many copies a text has, it is one of the sample or none.

A text that is null or has no letter is "und" with score 0. Rows without a label teach nothing but get a prediction.
Equal texts get equal predictions. Texts of over CHUNK_CHARS characters are counted a piece at a time, with the same counts. With
no training rows all is "und"; with more than MOST_LABELS labels the fit refuses (a ValueError), since the model holds DIMS
weights for each. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released

DIMS = 1 << 14
PER_LANGUAGE = 500
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.3, 1.0, 0.02, 0.5
MOST_LABELS = 256
CHUNK_DOCS, CHUNK_CHARS = 64, 1 << 18
_shift = np.uint32(32 - 14)


def _classes() -> np.ndarray:
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            table[c] = c
    return table


_table: list[np.ndarray] = []


def codes_of(text: str) -> np.ndarray:
    """Code points of the lower-cased text; those of no letter are 32."""
    if not _table:
        _table.append(_classes())
    return _table[0][np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")]


def slots(gram: np.ndarray) -> np.ndarray:
    gram = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (gram >> _shift).astype(np.int64)


def grams(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of one, two and three that begin at each code point, not yet hashed to features."""
    one = c * np.uint32(0x9E3779B1)
    two = one[:-1] * np.uint32(31) + c[1:] * np.uint32(0x85EBCA6B)
    return one, two, two[:-1] * np.uint32(37) + c[2:] * np.uint32(0xC2B2AE35)


def pieces(text: str) -> Iterator[str]:
    """Parts of at most CHUNK_CHARS characters, cut at blanks if there are any."""
    at = 0
    while len(text) - at > CHUNK_CHARS:
        cut = text.rfind(" ", at + CHUNK_CHARS // 2, at + CHUNK_CHARS)
        cut = cut if cut > 0 else at + CHUNK_CHARS
        yield text[at:cut]
        at = cut
    yield text[at:]


def counts_in_pieces(text: str) -> np.ndarray:
    """Counts of all features of one text; the last two code points of a piece are carried over to the next."""
    total, last = np.zeros(DIMS, np.int64), np.array([32], np.uint32)
    total += np.bincount(slots(grams(last)[0]), minlength=DIMS)
    for piece in pieces(text + " "):
        c = codes_of(piece)
        c = c[(c != 32) | (np.append(last[-1], c[:-1]) != 32)]
        whole = np.append(last, c)
        for size, gram in enumerate(grams(whole), 1):
            total += np.bincount(slots(gram[max(len(last) - size + 1, 0) :]), minlength=DIMS)
        last = whole[-2:]
    return total


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, feature and count of all n-grams of some texts, by document and feature."""
    short = [i for i, t in enumerate(texts) if len(t) <= CHUNK_CHARS]
    codes = [codes_of(" " + texts[i] + " ") for i in short]
    doc = np.repeat(np.array(short, np.int64), [len(c) for c in codes])
    c = np.concatenate(codes) if codes else np.empty(0, np.uint32)
    keep = (c != 32) | np.append(True, c[:-1] != 32) | np.append(True, doc[1:] != doc[:-1]) if len(c) else np.empty(0, bool)
    c, doc = c[keep].astype(np.uint32), doc[keep]
    bins = []
    for size, gram in enumerate(grams(c)):
        of = doc[size:]
        same = of == doc[: len(of)]
        bins.append(of[same] * DIMS + slots(gram[same]))
    counts = np.bincount(np.concatenate(bins), minlength=len(texts) * DIMS)
    for i, t in enumerate(texts):
        if len(t) > CHUNK_CHARS:
            counts[i * DIMS : (i + 1) * DIMS] = counts_in_pieces(t)
    seen = np.flatnonzero(counts)
    return seen // DIMS, seen % DIMS, counts[seen]


def chunks(texts: Iterable[str]) -> Iterator[tuple[int, list[str]]]:
    """Lists of some texts, with the number of the first; only one list is held at a time."""
    start, size, part = 0, 0, []
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= CHUNK_CHARS or len(part) == CHUNK_DOCS:
            yield start, part
            start, size, part = start + len(part), 0, []
    if part:
        yield start, part


def weighted(doc: np.ndarray, feature: np.ndarray, count: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    """TF-IDF values, of length 1 for each document."""
    v = (1 + np.log(count)) * idf[feature]
    norm = np.sqrt(np.bincount(doc, v * v, minlength=n))
    return v / np.maximum(norm, 1e-12)[doc]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray  # DIMS
    weights: np.ndarray  # DIMS + 1 (the last for the constant) x languages
    temperature: float

    def logits(self, texts: list[str]) -> np.ndarray:
        doc, feature, count = features(texts)
        v = weighted(doc, feature, count, self.idf, len(texts))
        out = np.stack([np.bincount(doc, v * self.weights[feature, k], minlength=len(texts)) for k in range(len(self.languages))], axis=1)
        return out + self.weights[DIMS]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        x = self.logits(texts) / self.temperature
        p = np.exp(x - x.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        known = [any(map(str.isalpha, t)) for t in texts]
        return [self.languages[b] if k else "und" for b, k in zip(best, known, strict=True)], np.where(known, p.max(axis=1), 0.0)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> np.ndarray:
    """Weights from (features, values, class) rows; the constant feature isn't penalised."""
    z, n = np.zeros((DIMS + 1, n_classes)), np.zeros((DIMS + 1, n_classes))

    def weights(i: np.ndarray) -> np.ndarray:
        zi, free = z[i], (i == DIMS)[:, None]
        a, b = np.where(free, 0, l1), np.where(free, 0, l2)
        return np.where(np.abs(zi) <= a, 0, -(zi - np.sign(zi) * a) / ((beta + np.sqrt(n[i])) / alpha + b))

    rng = np.random.default_rng(42)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            feature, value, y = rows[r]
            i, v = np.append(feature, DIMS), np.append(value, 1.0)
            w = weights(i)
            x = v @ w
            p = np.exp(x - x.max())
            p /= p.sum()
            p[y] -= 1
            g = v[:, None] * p
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    return weights(np.arange(DIMS + 1))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The one of a fine geometric grid with the smallest negative log-likelihood."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        x = logits / t
        m = x.max(axis=1)
        return float((m + np.log(np.exp(x - m[:, None]).sum(axis=1)) - x[np.arange(len(y)), y]).mean())

    return float(min(np.geomspace(0.05, 10, 200), key=loss))


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """labelled: the training rows. Statistics cover all; the weights come from a bounded sample (see above)."""
    rows = labelled.select(F.col(label_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMS, np.int64), 0
        for batch in released(batches):
            n += batch.num_rows
            for _, part in chunks(t.as_py() for t in batch.column(0)):
                total += np.bincount(features(part)[1], minlength=DIMS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMS)), pa.array(np.append(n, total))], ["feature", "n"])

    df = np.zeros(DIMS + 1)
    for feature, n in rows.select("text").mapInArrow(frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n")).collect():
        df[feature + 1] = n
    idf = np.log((1 + df[0]) / (1 + df[1:])) + 1
    rows = rows.withColumn("draw", F.xxhash64(F.lit("sample"), "text"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.approx_count_distinct("draw")).limit(MOST_LABELS + 1).collect()}  # texts
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    languages = sorted(counts)
    if not languages:
        return Model([], idf, np.zeros((DIMS + 1, 0)), 1.0)
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, per_language / counts[k])))])[F.col("lang")]
    sample = rows.where(F.pmod("draw", F.lit(1_000_003)) / 1_000_003 < share).dropDuplicates(["lang", "draw"]).select("lang", "text", "draw")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for start, part in chunks(t.as_py() for t in batch.column(1)):
                doc, feature, count = features(part)
                v, at = weighted(doc, feature, count, idf, len(part)), np.searchsorted(doc, np.arange(len(part) + 1))
                pack = lambda x, kind: pa.array([x[a:b].astype(kind).tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())  # noqa: B023, E731
                n = len(part)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, n), batch.column(2).slice(start, n), pack(feature, "<u2"), pack(v, "<f4")], ["lang", "draw", "features", "values"])

    got = sample.mapInArrow(vectors, "lang string, draw long, features binary, values binary").collect()
    fitted, held = [], []
    for y, language in enumerate(languages):
        own = sorted((r for r in got if r[0] == language), key=lambda r: r[1])
        for i, r in enumerate(own):
            (held if i % 5 == 4 else fitted).append((np.frombuffer(r[2], "<u2").astype(np.int64), np.frombuffer(r[3], "<f4").astype(float), y))
    weights = ftrl(fitted, len(languages))
    logits = np.array([v @ weights[i] + weights[DIMS] for i, v, _ in held]).reshape(-1, len(languages))
    return Model(languages, idf, weights, temperature(logits, np.array([y for *_, y in held], int)))


def predict(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, lang_pred, score. The model's size is bounded by DIMS x languages."""
    schema = T.StructType([docs.schema[id_col], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for start, part in chunks(t.as_py() or "" for t in batch.column(1)):
                lang, score = model.predict(part)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), pa.array(lang, pa.string()), pa.array(score)], schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def identified(docs: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """id, held_out, lang_pred, score of every row; learned from the rows that aren't held out."""
    model = fit(docs.where(~held_out(id_col)), text_col, label_col)
    return predict(docs, model, text_col, id_col).withColumn("held_out", held_out(id_col))


def drop_unknown(docs: DataFrame, text_col: str = "text", label_col: str = "lang", least: float = 0.5) -> DataFrame:
    """docs without the rows in no learned language: "und", or with a score under `least`; all columns as they were. Learned from
    all labelled rows. Each row is judged by its own text, so ids may be null or repeated; where nothing was learned, no row stays."""
    model = fit(docs, text_col, label_col)

    @F.arrow_udf(T.BooleanType())
    def good(column: pa.Array) -> pa.Array:
        out = np.zeros(len(column), bool)
        for start, part in chunks(t.as_py() or "" for t in column):
            lang, score = model.predict(part)
            out[start : start + len(part)] = [k != "und" and x >= least for k, x in zip(lang, score.tolist(), strict=True)]
        return pa.array(out)

    return docs.where(good(F.col(text_col)))
