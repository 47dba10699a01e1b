"""Removal of byte strings that already occur in an earlier document, by the order of suffixes.

Every byte covered by a LENGTH-byte string that also occurs in a document with a smaller id goes; matches never cross
documents. Strings are judged on the input.

A collection as large as a corpus is split so that equal strings meet. Of the ANCHOR-byte substrings of a LENGTH-byte
string the one with the smallest hash is its anchor, so equal strings have equal anchors, wherever they stand. Documents
are packed into segments; of each segment the anchors' short hashes go to buckets, which answer which of them occur in
several documents. Around each of those a segment sends its context (the bytes of all strings that have that anchor, at
most 2 * LENGTH - ANCHOR) to the anchor's bucket, each distinct context once, with the smallest id that has it. In a
bucket the suffixes of the contexts are put in order by column-wise construction of the collection's Burrows-Wheeler
transform: each round inserts one symbol of every context, at the place that the transform so far gives it. Neighbours in
that order with LENGTH common bytes are equal strings; a group's smallest id is the first document that has the string.
Contexts alone with their anchor need no order: their strings occur where they do.

Two departures from column-wise construction in external files. A bucket is small enough to stay in memory, so its columns are
arrays and not files: the transform of a whole collection is read and written once for every symbol of its longest text, which
no corpus allows, and files on a machine are lost with an executor. And common prefixes are taken from the finished order and
not updated in each round: only "at least LENGTH" matters, and that is one comparison per neighbour and column.

A segment sends at most one row to each bucket, and at most as many as it has anchors. There are MIN_BITS bits of buckets at
least; above that one bucket for PER_BUCKET segments where short hashes meet, and one for each segment where contexts meet.

Null texts count as empty. A null id is smaller than all others. Rows that share an id don't remove each other's bytes.
Texts shorter than LENGTH stay whole. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import new_path, saved

LENGTH, ANCHOR = 50, 25
SIDE = LENGTH - ANCHOR
CONTEXT = LENGTH + SIDE
SEGMENT_BYTES = 8 << 20
BLOCK = 128  # symbols between noted counts
PART = 1 << 20  # bytes of a text whose anchors are looked for together
MIN_BITS, PER_BUCKET = 7, 16
TASK_BYTES = 64 << 20  # of texts in a task
BASE, MIX = 0x100000001B3, np.uint64(0x9E3779B97F4A7C15)
NULL = -(1 << 63)


def packed(*arrays: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(a if isinstance(a, bytes) else a.tobytes() for a in arrays))


def unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


# ---------------------------------------------------------------- anchors


def _hashes(a: np.ndarray) -> np.ndarray:
    """A hash of the ANCHOR bytes from each place on, put together from hashes of powers of two."""
    part, size, out, done, k = a.astype(np.uint64) + np.uint64(1), 1, None, 0, ANCHOR
    while True:
        factor = np.uint64(pow(BASE, size, 1 << 64))
        if k & 1:
            if out is None:
                out = part
            else:
                n = len(a) - done - size + 1
                out = out[:n] * factor + part[done : done + n]
            done += size
        k >>= 1
        if not k:
            break
        part = part[:-size] * factor + part[size:]
        size *= 2
    out = (out ^ (out >> np.uint64(29))) * MIX
    return out ^ (out >> np.uint64(32))


def _least(h: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - width + size], h[width - size :]) if size < width else h


def anchors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all LENGTH-byte strings of a text, part by part."""
    if len(a) < PART + LENGTH:
        return _anchors(a)
    found = [(s, *_anchors(a[s : s + PART + LENGTH - 1])) for s in range(0, len(a) - LENGTH + 1, PART)]
    at, first = np.unique(np.concatenate([s + x for s, x, _ in found]), return_index=True)
    return at, np.concatenate([h for *_, h in found])[first]


def _anchors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(a) < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = _hashes(a)
    least = _least(h, SIDE + 1)
    pad = np.zeros(SIDE, np.uint64)
    most = ~_least(~np.concatenate([pad, least, pad]), SIDE + 1)  # largest of the minima of the strings around a place
    at = np.flatnonzero(h == most)
    mixed = h[at] * MIX  # anchors have small hashes; mixed ones fall into all buckets alike
    return at, mixed ^ (mixed >> np.uint64(29))


def keys_of(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and short hash within it."""
    bucket = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
    return bucket, (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)


# ---------------------------------------------------------------- segments


def segments(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """seg, docs: texts in packs of about SEGMENT_BYTES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seg = TaskContext.get().partitionId() << 24
        ids, texts, size = [], [], 0

        def flush() -> pa.RecordBatch:
            blob = packed(np.array([len(ids)], "<i8"), np.array(ids, "<i8"), np.array([len(t) for t in texts], "<i8"), b"".join(texts))
            return pa.RecordBatch.from_arrays([pa.array([seg], pa.int64()), pa.array([blob], pa.binary())], ["seg", "docs"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(NULL if i is None else i)
                texts.append((text.as_py() or "").encode())
                size += len(texts[-1])
                if size >= SEGMENT_BYTES:
                    yield flush()
                    ids, texts, size, seg = [], [], 0, seg + 1
        if ids:
            yield flush()

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "seg long, docs binary")


def unpack_segment(blob: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    data = unpacked(blob)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    ids, lengths = np.frombuffer(data, "<i8", n, 8), np.frombuffer(data, "<i8", n, 8 + 8 * n)
    ends = np.cumsum(lengths) + 8 + 16 * n
    return ids, [np.frombuffer(data, np.uint8, s, e - s) for e, s in zip(ends.tolist(), lengths.tolist(), strict=True)]


# ---------------------------------------------------------------- which anchors several documents have


def _by_bucket(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[int, list[list]]]:
    """Rows of each bucket of a partition that is sorted by bucket (first column)."""
    now, held = None, [[] for _ in range(columns)]
    for batch in batches:
        for j in range(batch.num_rows):
            bucket, *row = (batch.column(i)[j].as_py() for i in range(columns + 1))
            if bucket != now:
                if held[0]:
                    yield now, held
                now, held = bucket, [[] for _ in range(columns)]
            for h, x in zip(held, row, strict=True):
                h.append(x)
    if held[0]:
        yield now, held


def repeated_anchors(segs: DataFrame, bits: int, tasks: int) -> DataFrame:
    """seg, bucket, found: the short hashes of a segment's anchors that occur in several documents."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seg, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, texts = unpack_segment(blob.as_py())
                seen = [np.unique(anchors(t)[1]) for t in texts]
                h = np.concatenate(seen) if seen else np.empty(0, np.uint64)
                if not len(h):
                    continue
                order = np.argsort(h, kind="stable")
                h, doc = h[order], np.repeat(ids, [len(s) for s in seen])[order]
                first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
                h = h[first]
                bucket, short = keys_of(h, bits)
                cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                ends = [*cuts[1:].tolist(), len(h)]
                spans = list(zip(cuts.tolist(), ends, strict=True))
                cols = [pa.array(bucket[cuts]), pa.array([seg] * len(cuts), pa.int64()), pa.array([short[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([np.packbits(several[a:b]).tobytes() for a, b in spans], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["bucket", "seg", "short", "several"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, (segs, shorts, severals) in _by_bucket(batches, 3):
            shorts = [np.frombuffer(s, np.uint32) for s in shorts]
            several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(s)) for x, s in zip(severals, shorts, strict=True)])
            short, of = np.concatenate(shorts), np.repeat(np.arange(len(segs)), [len(s) for s in shorts])
            order = np.argsort(short, kind="stable")
            short, of, several = short[order], of[order], several[order]
            first = np.flatnonzero(np.append(True, short[1:] != short[:-1]))
            counts = np.diff(np.append(first, len(short)))
            good = np.repeat((np.add.reduceat(several.astype(np.int64), first) > 0) | (counts > 1), counts)
            short, of = short[good], of[good]
            order = np.argsort(of, kind="stable")
            short, of = short[order], of[order]
            cuts = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else []
            cols = [pa.array([segs[of[a]] for a in cuts], pa.int64()), pa.array([bucket] * len(cuts), pa.int64()), pa.array([short[a:b].tobytes() for a, b in zip(cuts, [*cuts[1:], len(of)], strict=True)] if len(cuts) else [], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["seg", "bucket", "found"])

    sent = segs.select("seg", "docs").mapInArrow(send, "bucket long, seg long, short binary, several binary")
    return sent.repartition(tasks, "bucket").sortWithinPartitions("bucket", "seg").mapInArrow(answer, "seg long, bucket long, found binary")


# ---------------------------------------------------------------- contexts


class Contexts:
    """The distinct contexts of a segment's repeated anchors, numbered in the order of their first place, and their places."""

    def __init__(self, blob: bytes, found: list[dict] | None, short_bits: int, bits: int):
        self.ids, self.texts = unpack_segment(blob)
        found = found or []
        keys = np.concatenate([np.uint64(f["bucket"] << 32) | np.frombuffer(f["found"], np.uint32).astype(np.uint64) for f in found]) if found else np.empty(0, np.uint64)
        keys.sort()
        number: dict[tuple[int, bytes], int] = {}
        self.left, self.bytes, self.bucket, self.doc = [], [], [], []
        self.places: list[tuple[np.ndarray, np.ndarray]] = []  # of each text: starts of contexts, their numbers
        for i, t in zip(self.ids.tolist(), self.texts, strict=True):
            at, h = anchors(t)
            bucket, short = keys_of(h, short_bits)
            key = (bucket.astype(np.uint64) << np.uint64(32)) | short
            hit = keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key if len(keys) and len(key) else np.zeros(len(key), bool)
            at, bucket = at[hit], keys_of(h[hit], bits)[0].tolist()
            start, data, which = np.maximum(at - SIDE, 0), t.tobytes() if len(at) else b"", []
            for p, s, b in zip(at.tolist(), start.tolist(), bucket, strict=True):
                c = data[s : p + LENGTH]
                k = number.get((p - s, c))
                if k is None:
                    k = number[p - s, c] = len(self.bytes)
                    self.left.append(p - s)
                    self.bytes.append(c)
                    self.bucket.append(b)
                    self.doc.append(i)
                elif i < self.doc[k]:
                    self.doc[k] = i
                which.append(k)
            self.places.append((start, np.array(which, np.int64)))
        self.order = np.argsort(np.array(self.bucket, np.int64), kind="stable")

    def packed_places(self) -> bytes:
        runs = [(b, len(w)) for b, w in self.by_bucket()]
        head = np.array([len(self.bytes), len(self.places), sum(len(w) for _, w in self.places), len(runs)], "<i8")
        return packed(
            head, np.array([len(b) for b in self.bytes], np.uint8), self.order.astype("<u4"), np.array(runs, "<i8"), np.array([len(w) for _, w in self.places], "<i8"),
            *[s.astype("<u4") for s, _ in self.places], *[w.astype("<u4") for _, w in self.places],
        )

    def by_bucket(self) -> Iterator[tuple[int, np.ndarray]]:
        bucket = np.array(self.bucket, np.int64)[self.order]
        cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []
        for a, b in zip(cuts, [*cuts[1:], len(bucket)], strict=True) if len(cuts) else ():
            yield int(bucket[a]), self.order[a:b]


class Places:
    """What packed_places() holds: lengths of contexts, their order by bucket, and the places of each text."""

    def __init__(self, blob: bytes):
        data = unpacked(blob)
        n, n_texts, n_places, n_runs = np.frombuffer(data, "<i8", 4).tolist()
        at = 32

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.strings = take("u1", n).astype(np.int64) - LENGTH + 1
        self.order = take("<u4", n).astype(np.int64)
        self.runs = take("<i8", 2 * n_runs).reshape(-1, 2)
        cuts = np.append(0, np.cumsum(take("<i8", n_texts))).tolist()
        start, which = take("<u4", n_places).astype(np.int64), take("<u4", n_places).astype(np.int64)
        self.texts = [(start[a:b], which[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]

    def by_bucket(self) -> Iterator[tuple[int, np.ndarray]]:
        at = 0
        for bucket, n in self.runs.tolist():
            yield bucket, self.order[at : at + n]
            at += n


def suffix_groups(texts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, offset and group of all LENGTH-byte strings of a collection (rows of texts, flush right), equal strings in
    one group, in the order of the suffixes that they begin.

    Each round inserts one symbol of every text into the collection's Burrows-Wheeler transform. A suffix that grows by
    the symbol c goes to: the suffixes that start with less, then those with c whose rest comes before its own. Symbols
    are counted every BLOCK places, the rest of a count is taken within the block.
    """
    n, width = texts.shape
    used, codes = np.unique(texts, return_inverse=True)
    codes = (codes.reshape(n, width) + 1).astype(np.uint8 if len(used) < 255 else np.uint16)  # 0: before a text's start
    k = len(used) + 2
    inside = np.arange(BLOCK, dtype=np.uint8)
    bwt = codes[:, -1].copy()
    at = np.arange(n)  # of each text's last inserted suffix
    active = np.arange(n)

    def noted(bwt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        blocks = len(bwt) // BLOCK + 1
        rows = np.full(blocks * BLOCK, k - 1, bwt.dtype)
        rows[: len(bwt)] = bwt
        rows = rows.reshape(blocks, BLOCK)
        counts = np.bincount((rows + (np.arange(blocks) * k)[:, None]).ravel(), minlength=blocks * k).reshape(blocks, k)
        total = counts.sum(axis=0)
        total[0] = total[k - 1] = 0
        return rows, np.cumsum(counts, axis=0) - counts, n + np.cumsum(total) - total

    def moved(places: np.ndarray, symbols: np.ndarray, rows: np.ndarray, before: np.ndarray, base: np.ndarray) -> np.ndarray:
        block, rest = places // BLOCK, (places % BLOCK).astype(np.uint8)
        out = base[symbols] + before[block, symbols]
        for s in range(0, len(places), 1 << 12):  # what is looked at stays in the cache
            e = slice(s, s + (1 << 12))
            hit = (rows[block[e]] == symbols[e, None]) & (inside < rest[e, None])
            eights = hit.view(np.uint64).sum(axis=1)  # eight counts of one byte each, together less than BLOCK
            out[e] += ((eights * np.uint64(0x0101010101010101)) >> np.uint64(56)).astype(np.int64)
        return out

    for round_ in range(1, width + 1):
        active = active[lengths[active] >= round_]
        if not len(active):
            break
        to = moved(at[active], codes[active, width - round_], *noted(bwt))
        new = np.empty(len(bwt) + len(active), bwt.dtype)
        old = np.ones(len(new), bool)
        old[to] = False
        new[old] = bwt
        new[to] = np.where(lengths[active] > round_, codes[active, width - round_ - 1] if round_ < width else 0, 0)
        at[active], bwt = to, new

    # walk once through the finished transform: where does each suffix stand?
    order = np.argsort(bwt, kind="stable")
    lf = np.empty(len(bwt), np.int64)
    lf[order] = np.arange(len(bwt)) - int((bwt == 0).sum()) + n
    of, size = np.full(len(bwt), -1, np.int64), np.zeros(len(bwt), np.int16)
    here, live = np.arange(n), np.arange(n)
    for round_ in range(1, width + 1):
        keep = lengths[live] >= round_
        live, here = live[keep], lf[here[keep]]
        if round_ >= LENGTH:
            of[here], size[here] = live, round_
    at = np.flatnonzero(of >= 0)
    text, offset = of[at], width - size[at].astype(np.int64)
    flat, start = texts.ravel(), of[at] * width + offset
    same = np.flatnonzero(np.ones(max(0, len(at) - 1), bool))
    for i in range(LENGTH):  # common prefixes of neighbours
        same = same[flat[start[same] + i] == flat[start[same + 1] + i]]
    new = np.ones(len(at), bool)
    new[same + 1] = False
    return text, offset, np.cumsum(new) - 1


def first_documents(data: bytes, left: np.ndarray, length: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For all strings of some contexts (in turn): the smallest document that has it."""
    n, total = len(doc), len(data)
    at = np.cumsum(length) - length
    place = np.arange(n) * CONTEXT + SIDE - left
    rows = np.zeros(n * CONTEXT, np.uint8)
    rows[np.repeat(place - at, length) + np.arange(total)] = np.frombuffer(data, np.uint8)
    rows = rows.reshape(n, CONTEXT)
    keyed = np.hstack([rows[:, SIDE:LENGTH], rows[:, :SIDE], rows[:, LENGTH:], left[:, None].astype(np.uint8), length[:, None].astype(np.uint8)])
    _, pick, which = np.unique(np.ascontiguousarray(keyed).view(f"V{CONTEXT + 2}").ravel(), return_index=True, return_inverse=True)
    least = np.full(len(pick), np.iinfo(np.int64).max)
    np.minimum.at(least, which, doc)
    anchor = keyed[pick, :ANCHOR]
    new = np.append(True, (anchor[1:] != anchor[:-1]).any(axis=1))
    group = np.cumsum(new) - 1
    strings = length[pick] - LENGTH + 1
    base = np.cumsum(strings) - strings
    firsts = np.repeat(least, strings)
    shared = np.flatnonzero(np.bincount(group)[group] > 1)  # a context alone with its anchor shares no string
    if len(shared):
        size, where = length[pick[shared]], pick[shared]
        right = np.zeros((len(shared), CONTEXT), np.uint8)  # flush right
        source, target = where * CONTEXT + SIDE - left[where], np.arange(len(shared)) * CONTEXT + CONTEXT - size
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        right.ravel()[np.repeat(target, size) + step] = rows.ravel()[np.repeat(source, size) + step]
        text, offset, equal = suffix_groups(right, size)
        smallest = np.full(int(equal[-1]) + 1, np.iinfo(np.int64).max)
        np.minimum.at(smallest, equal, least[shared[text]])
        firsts[base[shared[text]] + offset - (CONTEXT - size[text])] = smallest[equal]
    n_strings = length - LENGTH + 1
    return firsts[np.repeat(base[which], n_strings) + np.arange(n_strings.sum()) - np.repeat(np.cumsum(n_strings) - n_strings, n_strings)]


def verdicts(held: DataFrame, short_bits: int, bits: int, tasks: int) -> DataFrame:
    """seg, bucket, firsts: for the contexts that a segment sends to a bucket, in turn, each string's first document; and,
    under the bucket -1, the places of the segment's contexts."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                seg, c = batch.column(0)[i].as_py(), Contexts(batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), short_bits, bits)
                rows = [(b, packed(np.array([len(w)], "<i8"), np.array([c.doc[k] for k in w], "<i8"), np.array([c.left[k] for k in w], np.uint8), np.array([len(c.bytes[k]) for k in w], np.uint8), b"".join([c.bytes[k] for k in w]))) for b, w in c.by_bucket()]
                if rows:  # the places only pass through, each segment's to another task
                    rows.append((-1 - seg, c.packed_places()))
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int64()), pa.array([seg] * len(rows), pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "seg", "contexts"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, (segs, blobs) in _by_bucket(batches, 2):
            if bucket < 0:
                yield pa.RecordBatch.from_arrays([pa.array(segs, pa.int64()), pa.array([-1] * len(segs), pa.int64()), pa.array(blobs, pa.binary())], ["seg", "bucket", "firsts"])
                continue
            docs, lefts, lengths, texts = [], [], [], []
            for blob in map(unpacked, blobs):
                n = int(np.frombuffer(blob, "<i8", 1)[0])
                docs.append(np.frombuffer(blob, "<i8", n, 8))
                lefts.append(np.frombuffer(blob, np.uint8, n, 8 + 8 * n))
                lengths.append(np.frombuffer(blob, np.uint8, n, 8 + 9 * n))
                texts.append(blob[8 + 10 * n :])
            length = np.concatenate(lengths).astype(np.int64)
            firsts = first_documents(b"".join(texts), np.concatenate(lefts).astype(np.int64), length, np.concatenate(docs))
            ends = np.cumsum([int((x.astype(np.int64) - LENGTH + 1).sum()) for x in lengths]).tolist()
            out = [packed(firsts[a:b].astype("<i8")) for a, b in zip([0, *ends], ends, strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(segs, pa.int64()), pa.array([bucket] * len(segs), pa.int64()), pa.array(out, pa.binary())], ["seg", "bucket", "firsts"])

    sent = held.mapInArrow(send, "bucket long, seg long, contexts binary")
    return sent.repartition(tasks, "bucket").sortWithinPartitions("bucket", "seg").mapInArrow(judge, "seg long, bucket long, firsts binary")


# ---------------------------------------------------------------- operator


def runs(begin: np.ndarray, size: int) -> np.ndarray:
    """Starts and ends, in turn, of the maximal runs that LENGTH-byte strings from these places on cover in a text."""
    if not len(begin):
        return np.empty(0, np.int64)
    there = np.zeros(size, bool)
    there[begin] = True
    begin = np.flatnonzero(there)
    new = np.flatnonzero(np.diff(begin) > LENGTH)
    return np.stack([begin[np.append(0, new + 1)], begin[np.append(new, len(begin) - 1)] + LENGTH], axis=1).ravel()


def cut(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, n_bytes, kept (the bytes that stay, joined), spans (start and end of each maximal run of
    removed bytes, packed as little-endian signed 64-bit integers). Ids are longs.

    Segments are kept in the shared folder, bucketed by segment, so that answers come to them without moving texts again. Tasks
    grow in number with the texts' bytes, and not in size.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    name = f"landmosaic_segments_{uuid.uuid4().hex}"
    segments(docs, text_col, id_col).write.bucketBy(tasks, "seg").format("parquet").option("compression", "none").option("path", new_path(spark, "segments")).saveAsTable(name)
    segs = spark.table(name)
    n = max(1, segs.count())
    short_bits, bits = (max(MIN_BITS, int(np.ceil(np.log2(k)))) for k in (n / PER_BUCKET, n))

    def gathered(answers: DataFrame, column: str) -> DataFrame:
        return answers.groupBy("seg").agg(F.collect_list(F.struct("bucket", column)).alias(column))

    found = gathered(saved(repeated_anchors(segs, short_bits, tasks), "anchors"), "found")
    held = segs.join(found, "seg", "left").select("seg", "docs", "found")
    firsts = gathered(saved(verdicts(held, short_bits, bits, tasks), "firsts"), "firsts")
    held = segs.join(firsts, "seg", "left").select("docs", "firsts")
    spark.sql(f"DROP TABLE {name}")  # its files stay in the shared folder, like other intermediates
    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("kept", T.BinaryType()), T.StructField("spans", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, texts = unpack_segment(batch.column(0)[i].as_py())
                given = {f["bucket"]: f["firsts"] for f in batch.column(1)[i].as_py() or ()}
                c = Places(given[-1]) if given else None
                if c:
                    strings = c.strings
                    base = np.cumsum(strings) - strings
                    firsts = np.zeros(int(strings.sum()), np.int64)
                    for bucket, which in c.by_bucket():
                        x, m = np.frombuffer(unpacked(given[bucket]), "<i8"), strings[which]
                        firsts[np.repeat(base[which], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)] = x
                rows = []
                none = np.empty(0, np.int64)
                for doc, t, (start, which) in zip(ids.tolist(), texts, c.texts if c else [(none, none)] * len(texts), strict=True):
                    if not len(which):
                        rows.append((None if doc == NULL else doc, len(t), t.tobytes(), b""))
                        continue
                    m = strings[which]
                    step = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                    begin = (np.repeat(start, m) + step)[firsts[np.repeat(base[which], m) + step] < doc]
                    edges = runs(begin, len(t))
                    data, cuts = t.tobytes(), [0, *edges.tolist(), len(t)]
                    rows.append((None if doc == NULL else doc, len(t), b"".join([data[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)]), edges.astype("<i8").tobytes()))
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], schema.names)

    return held.mapInArrow(run, schema)


def digests(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 of rows of cut()."""
    return rows.select(id_col, "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.expr("length(spans) div 16").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
