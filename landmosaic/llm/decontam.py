"""Benchmark decontamination by latent semantic retrieval.

The benchmark is cut into passages; their TF-IDF matrix (document frequencies are those among all its passages) gets a
distributed randomised SVD (its rows and terms stay in Spark tables, only RANK x RANK matrices reach the driver), which gives
every term a latent vector. The space is that of the passages and not of the corpus, whose leading directions are its common
words, and nothing in it turns on what leaked where: a passage that stands in most documents keeps its weights.

Documents are scanned once, in windows of the lengths that passages need, at every eighth of a length, over the whole text. A
window with a step on both sides is a candidate for a passage if
- it holds as many of the passage's words, and of its rarest words, as any match needs (a bound, so nothing is lost), and
- the latent vector of the passage's words that stand there has a cosine of COSINE or more with the passage's.
Words around a passage play no part in either. A candidate is a leak if the longest common subsequence of words covers at
least LCS of the passage; or at least PARAPHRASE of it while the passage's answer (its last sentence) stands there word for
word; with an answer of under MIN_WORDS words at least ANSWERED of it.

Items of 2 to MIN_WORDS - 1 words are leaks where their words stand in a row, items of one word where they are the whole text.
In scripts without spaces between words each character counts as a word. The benchmark is looked for in blocks of a bounded
number of words, so that what is broadcast is bounded. Null texts and texts without words match nothing; repeated rows give a
row each; an empty table of either kind gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from xxhash import xxh64_intdigest

from . import words
from .common import released, saved

LETTERS = words.byte_kinds(lambda b: b >= 128 or chr(b).isalnum() or b == 95)
PASSAGE, OVERLAP = 160, 80  # words
MIN_WORDS = 5
RANK, SPARE, POWERS = 64, 16, 2
LCS, PARAPHRASE, ANSWERED, COSINE = 0.8, 0.6, 0.7, 0.15
LADDER = [6, 8, 10, 12, 15, 19, 24, 30, 38, 48, 60, 75, 94, 118, 148, 185]
BLOCK_WORDS = 200_000
SCAN_BYTES = 1 << 20
#: Characters of scripts without spaces between words (South-East Asian, kana, Han), and punctuation beyond Latin-1.
UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff])|[\u2000-\u206f\u3000-\u303f\uff00-\uff0f\uff1a-\uff20]")


def spaced(text: str) -> bytes:
    """The lower-cased text in UTF-8, with characters of unspaced scripts apart."""
    text = text.lower()
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        text = UNSPACED.sub(lambda m: f" {m[1]} " if m[1] else " ", text)
    return text.encode("utf-8", "replace")


def parted(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, each text's words by number, and where each text's begin: lower-cased runs of ASCII letters, digits
    and underscores and of other characters beyond ASCII, or single characters (see UNSPACED)."""
    return words.distinct([spaced(t) for t in texts], LETTERS)


def words_of(text: str) -> list[str]:
    distinct, which, _ = parted([text])
    return [distinct[i].decode() for i in which]


def window_for(n: int) -> int:
    """The shortest window of which some position holds n words, wherever they stand."""
    return next(w for w in LADDER if w - w // 8 >= n)


def share_needed(answer: list | None) -> float:
    """The share of a passage that a match has at least."""
    return LCS if not answer else PARAPHRASE if len(answer) >= MIN_WORDS else ANSWERED


# ---------------------------------------------------------------- benchmark


@dataclass
class Block:
    """What the scan of a block of the benchmark needs: bounded by BLOCK_WORDS."""

    terms: dict[str, int]
    idf: np.ndarray
    latent: np.ndarray  # terms x rank, IDF included
    passages: list[tuple[object, list[str], list[str]]]  # item, words, answer


def passages(items: DataFrame, text_col: str = "text", id_col: str = "item_id") -> DataFrame:
    """item, passage, words, answer: each item in passages of at most PASSAGE words."""
    schema = T.StructType([T.StructField("item", items.schema[id_col].dataType), T.StructField("passage", T.LongType()), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("answer", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                said = words_of(text or "")
                sentences = [s for s in (words_of(x) for x in re.split(r"[.!?\n]+", text or "")) if s]
                for start in range(0, max(1, len(said) - OVERLAP), OVERLAP):
                    part = said[start : start + PASSAGE]
                    if part:
                        last = start + PASSAGE >= len(said)
                        rows.append((item, start, part, sentences[-1] if last and len(sentences[-1]) < len(part) else []))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, [batch.column(0).type, pa.int64(), pa.list_(pa.string()), pa.list_(pa.string())], strict=True)], schema.names)

    return items.select(id_col, text_col).mapInArrow(run, schema)


def term_weights(found: DataFrame) -> DataFrame:
    """row, term, idf, weight: the TF-IDF matrix of passages, rows of length 1."""
    cells = found.select(F.xxhash64("item", "passage").alias("row"), F.explode("words").alias("term")).groupBy("row", "term").agg(F.count("*").alias("tf"))
    n = found.agg(F.count("*").alias("_n"))
    idf = cells.groupBy("term").agg(F.count("*").alias("_df")).crossJoin(F.broadcast(n))  # one row: the number of passages
    idf = idf.select("term", (F.log((F.lit(1.0) + F.col("_n")) / (1 + F.col("_df"))) + 1).alias("idf"))
    cells = cells.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = cells.groupBy("row").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return cells.join(norms, "row").select("row", "term", "idf", (F.col("w") / F.col("norm")).alias("weight"))


def svd(cells: DataFrame, rank: int = RANK, spare: int = SPARE, powers: int = POWERS) -> DataFrame:
    """term, vector: right singular vectors of the matrix (row, term, weight), by randomised subspace iteration.

    A block of vectors over terms is multiplied by the matrix and its transpose in turn, as joins and grouped sums; it is
    made orthonormal through its small Gram matrix. Nothing longer than rank + spare squared reaches the driver."""
    k = rank + spare
    def noise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            out = [np.random.default_rng(xxh64_intdigest(f"{t}|omega")).standard_normal(k).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["term", "vector"])

    def sums(keys: pa.Array, v: np.ndarray) -> pa.RecordBatch:
        codes = keys.dictionary_encode()
        out = np.zeros((len(codes.dictionary), k))
        np.add.at(out, codes.indices.to_numpy(), v)
        return pa.RecordBatch.from_arrays([codes.dictionary, pa.array([x.tobytes() for x in out], pa.binary())], ["key", "vector"])

    def named(batch: pa.RecordBatch, name: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(batch.columns, [name, "vector"])

    def times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):  # a key's rows are added up here before they travel
            yield named(sums(batch.column(0), _matrix(batch.column(2), k) * batch.column(1).to_numpy()[:, None]), batch.schema.names[0])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last key's sum, which may go on in the next batch
        for batch in released(batches):
            keys, v = batch.column(0), _matrix(batch.column(1), k)
            if held is not None:
                keys, v = pa.concat_arrays([held.column(0), keys]), np.vstack([_matrix(held.column(1), k), v])
            out = named(sums(keys, v), batch.schema.names[0])
            held = out.slice(out.num_rows - 1)
            yield out.slice(0, out.num_rows - 1)
        if held is not None:
            yield held

    def multiplied(vectors: DataFrame, by: str, to: str) -> DataFrame:
        rows = cells.select(to, by, "weight").join(vectors, by).select(to, "weight", "vector")
        schema = f"{to} {cells.schema[to].dataType.simpleString()}, vector binary"
        return rows.mapInArrow(times, schema).repartition(to).sortWithinPartitions(to).mapInArrow(total, schema)

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((k, k))
        for batch in released(batches):
            v = _matrix(batch.column(0), k)
            g += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array([g.tobytes()], pa.binary())], ["gram"])

    def turned(vectors: DataFrame, keep: int) -> DataFrame:
        """The vectors' span, orthonormal, largest singular values first."""
        g = sum((np.frombuffer(r[0]).reshape(k, k) for r in vectors.select("vector").mapInArrow(gram, "gram binary").toLocalIterator()), np.zeros((k, k)))
        values, basis = np.linalg.eigh(g)
        order = np.argsort(-values)[:keep]
        good = order[values[order] > max(values.max(), 1e-300) * 1e-10]
        turn = basis[:, good] / np.sqrt(values[good])
        turn = np.hstack([turn, np.zeros((k, keep - len(good)))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in released(batches):
                v = _matrix(batch.column(1), k) @ turn
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in v], pa.binary())], ["term", "vector"])

        return saved(vectors.select("term", "vector").mapInArrow(run, "term string, vector binary"), "svd")

    terms = cells.select("term").distinct().mapInArrow(noise, "term string, vector binary")
    for i in range(powers):
        terms = saved(multiplied(saved(multiplied(terms, "term", "row"), "svd"), "row", "term"), "svd")
        terms = turned(terms, rank if i == powers - 1 else k)
    return terms


def _matrix(column: pa.Array, k: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column)).reshape(-1, k) if len(column) else np.zeros((0, k))


def blocks(items: DataFrame, text_col: str = "text", id_col: str = "item_id") -> Iterator[Block]:
    """The benchmark in blocks, each with about BLOCK_WORDS words, all in the latent space of the whole benchmark."""
    found = saved(passages(items, text_col, id_col), "passages")
    total = found.agg(F.sum(F.size("words"))).first()[0] or 0
    n = -(-total // BLOCK_WORDS)
    if not n:
        return
    cells = saved(term_weights(found), "cells")
    vectors = saved(svd(cells).join(cells.select("term", "idf").distinct(), "term").select("term", "idf", "vector"), "terms")
    for i in range(n):
        part = found.where(F.pmod(F.xxhash64("item", "passage"), F.lit(n)) == i)
        rows = vectors.join(part.select(F.explode("words").alias("term")).distinct(), "term").orderBy("term").toArrow()
        terms = {t: j for j, t in enumerate(rows["term"].to_pylist())}
        latent = (_matrix(rows["vector"], RANK) * rows["idf"].to_numpy()[:, None]).astype(np.float32)
        whole = sorted(((r["item"], r["words"], r["answer"]) for r in part.toArrow().to_pylist()), key=repr)
        yield Block(terms, rows["idf"].to_numpy(), latent, whole)


# ---------------------------------------------------------------- search


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, with a row of bits for each word of b."""
    places: dict = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for w in b:
        hit = row & places.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def in_a_row(part: np.ndarray, codes: np.ndarray) -> bool:
    """Whether the part stands in codes."""
    if len(part) > len(codes):
        return False
    at = np.flatnonzero(codes[: len(codes) - len(part) + 1] == part[0])
    for i in range(1, len(part)):
        at = at[codes[at + i] == part[i]]
    return bool(len(at))


class Scanner:
    def __init__(self, block: Block):
        self.block = block
        self.terms = {t.encode(): i for t, i in block.terms.items()}
        self.n = len(block.terms)
        self.latent = block.latent
        self.numbers = [np.array([block.terms[w] for w in said], np.int64) for _, said, _ in block.passages]
        self.answers = [np.array([block.terms[w] for w in answer], np.int64) for *_, answer in block.passages]
        self.needed = [int(np.ceil(share_needed(answer) * len(said) - 1e-9)) for _, said, answer in block.passages]  # words
        self.vocabulary = [dict(zip(*(c.tolist() for c in np.unique(x, return_counts=True)), strict=True)) for x in self.numbers]
        self.rare, self.rare_needed = [], []  # the rarest words of each passage, and how many of them any match has
        for x, needed in zip(self.numbers, self.needed, strict=True):
            free = len(x) - needed
            most = min(len(x), 2 * free + 1)
            self.rare.append(x[np.argsort(-block.idf[x], kind="stable")[:most]])
            self.rare_needed.append(most - free)
        self.vectors = [self.latent[x].sum(axis=0) for x in self.numbers]
        self.has = np.zeros(self.n, np.uint64)  # which of the eight passages at hand have a word, a byte for each; a window has under 256 words
        self.sizes: dict[int, list[int]] = {}
        self.short: dict[int, dict[int, list[int]]] = {}  # by length, then first word: passages of under MIN_WORDS words
        for i, x in enumerate(self.numbers):
            if len(x) >= MIN_WORDS:
                self.sizes.setdefault(window_for(len(x)), []).append(i)
            else:
                self.short.setdefault(len(x), {}).setdefault(int(x[0]), []).append(i)

    def cosine(self, p: int, there: set[int]) -> float:
        """Latent cosine of a passage and of those of its words that are there."""
        whole = self.vectors[p]
        v = self.latent[[w for w in self.numbers[p].tolist() if w in there]].sum(axis=0)
        return float(np.clip(v @ whole / max(float(np.linalg.norm(v) * np.linalg.norm(whole)), 1e-12), -1, 1))

    def leaks(self, texts: list[str]) -> Iterator[tuple[int, object, float, float, bool]]:
        """Number of the text, item, common share, cosine and answer of the best match of each item that leaks into a text."""
        distinct, which, bounds = parted(texts)
        if not len(which):
            return
        terms = self.terms
        codes = np.array([terms.get(w, self.n) for w in distinct])[which]
        best: dict[tuple, tuple] = {}
        for d, p, found in (*self.rows_of_words(codes, bounds), *self.windows(codes, bounds)):
            key = d, self.block.passages[p][0]
            best[key] = max(best.get(key, (0.0,)), found)
        yield from ((*key, *x) for key, x in sorted(best.items(), key=lambda x: (x[0][0], repr(x[0][1]))))

    def rows_of_words(self, codes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, tuple]]:
        """Text and passage of short passages that stand in a row."""
        for n, by_first in self.short.items():
            starts = np.array(sorted(by_first))
            at = np.flatnonzero(np.isin(codes, starts))
            doc = np.searchsorted(bounds, at, "right") - 1
            fits = at + n <= bounds[doc + 1] if n > 1 else bounds[doc + 1] - bounds[doc] == 1
            for a, d in zip(at[fits].tolist(), doc[fits].tolist(), strict=True):
                for p in by_first[int(codes[a])]:
                    if (codes[a : a + n] == self.numbers[p]).all():
                        yield d, p, (1.0, 1.0, False)

    def windows(self, codes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, tuple]]:
        """Text, passage and (common share, cosine, answer) of matches in windows."""
        first, lengths = bounds[:-1], np.diff(bounds)
        ours = codes < self.n
        mine, said = np.concatenate([[0], np.cumsum(ours)]), codes[ours]  # words that the benchmark knows: before each place, and which
        whole: set[tuple[int, int]] = set()  # text and passage, once all of it was found
        for size, ids in self.sizes.items():
            step = max(1, size // 8)
            n = np.where(lengths >= MIN_WORDS * PARAPHRASE, 1 + np.maximum(0, -(-(lengths - size) // step)), 0)
            doc = np.repeat(np.arange(len(lengths)), n)
            starts = first[doc] + step * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            lo, hi = np.maximum(first[doc], starts - step), np.minimum(bounds[doc + 1], starts + size + step)  # where a subsequence is looked for
            needs = np.array([self.rare_needed[p] for p in ids])
            some = np.flatnonzero(mine[hi] - mine[lo] >= min(self.needed[p] for p in ids))
            low, high = mine[lo[some]], mine[hi[some]]
            for k in range(0, len(ids), 8) if len(some) else ():
                eight = ids[k : k + 8]
                for lane, p in enumerate(eight):
                    self.has[self.rare[p]] |= np.uint64(1 << 8 * lane)
                count = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.has[said])])  # lanes overflow, but their differences don't
                count = (count[high] - count[low]).astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
                for p in eight:
                    self.has[self.rare[p]] = 0
                for g, lane in zip(*(x.tolist() for x in np.nonzero(count[:, : len(eight)] >= needs[k : k + 8])), strict=True):
                    p, g = eight[lane], int(some[g])
                    d = int(doc[g])
                    if (d, p) in whole:
                        continue
                    said_there = codes[lo[g] : hi[g]]
                    there = set(said_there.tolist())
                    if sum(n for w, n in self.vocabulary[p].items() if w in there) < self.needed[p]:  # a subsequence can't be longer
                        continue
                    cosine = self.cosine(p, there)
                    if cosine < COSINE:
                        continue
                    here = self.numbers[p].tolist()
                    share = common_subsequence(here, said_there.tolist()) / len(here)
                    if share * len(here) < self.needed[p] - 0.5:
                        continue
                    answer = self.answers[p]
                    answered = bool(len(answer)) and in_a_row(answer, said_there)
                    if share >= LCS or answered:
                        if share == 1:
                            whole.add((d, p))
                        yield d, p, (share, cosine, answered)


def leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_text_col: str = "text", item_id_col: str = "item_id") -> DataFrame:
    """id, item, common (share of the passage's words), cosine, answered: each item that leaks into a document."""
    schema = T.StructType([docs.schema[id_col], T.StructField(item_id_col, items.schema[item_id_col].dataType), T.StructField("common", T.DoubleType()), T.StructField("cosine", T.DoubleType()), T.StructField("answered", T.BooleanType())])
    out = None
    for block in blocks(items, item_text_col, item_id_col):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            scanner = Scanner(shared.value)
            for batch in released(batches):
                keys, found = [], []
                for start, part in words.batches((t.as_py() or "" for t in batch.column(1)), SCAN_BYTES):
                    for i, *x in scanner.leaks(part):
                        keys.append(start + i)
                        found.append(x)
                cols = list(zip(*found, strict=True)) or [[]] * 4
                types = [to_arrow_type(schema[item_id_col].dataType), pa.float64(), pa.float64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], schema.names)

        rows = docs.select(id_col, text_col).mapInArrow(run, schema)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return docs.sparkSession.createDataFrame([], schema)
    best = F.max_by(F.struct("common", "cosine", "answered"), F.struct("common", "cosine")).alias("best")
    return out if out is rows else out.groupBy(id_col, item_id_col).agg(best).select(id_col, item_id_col, "best.*")


def clean(text: Column, shared: Broadcast) -> Column:
    """Whether nothing of a block leaks into a text."""
    scanners: list[Scanner] = []

    @F.arrow_udf(T.BooleanType())
    def judge(column: pa.Array) -> pa.Array:
        if not scanners:
            scanners.append(Scanner(shared.value))
        good = np.ones(len(column), bool)
        for start, part in words.batches((t.as_py() or "" for t in column), SCAN_BYTES):
            for i, *_ in scanners[0].leaks(part):
                good[start + i] = False
        return pa.array(good)

    return judge(text)


def drop_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the documents into which a benchmark item leaks; all columns as they were. Each row is judged by its own
    text, so ids may be null or repeated."""
    for block in blocks(items):
        docs = docs.where(clean(F.col(text_col), docs.sparkSession.sparkContext.broadcast(block)))
    return docs
