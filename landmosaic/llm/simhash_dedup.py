"""SimHash fingerprints, linked through BK-trees.

Distinct fingerprints are dealt to buckets: the 64 bits are cut into BANDS parts, and two fingerprints that differ in at
most RADIUS bits agree in at least BANDS - RADIUS parts, so they share the bucket of such a choice of parts. Each bucket
is a shard with a BK-tree of its own (children keyed by their Hamming distance to the parent); a search follows only the
edges within the radius of its distance to a node. A tree over the whole corpus has no bounded size, and a search in it
visits nearly all of it, so shards are sent to tasks by the shuffle and not broadcast. Buckets of over BUCKET
fingerprints are dealt again, by RADIUS + 1 parts of their other bits, with the same guarantee, until none is left; with LEVELS
rounds a key has so many bits that a bucket can't hold more. Trees of all the buckets in a
batch are built and searched together, level by level. From each batch a spanning forest of its links leaves the task:
no link between components is lost, and large groups don't give all their pairs.

A null text counts as empty. Texts without words have fingerprint zero and are linked like any other. Equal texts have
equal fingerprints. Repeated ids keep a row each. A null id is passed over where the smallest of a component is taken; a
component of null ids only has a null component_id. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import attach, saved
from .components import components

SHINGLE, SEED, RADIUS, BANDS = 3, 42, 3, 6
BUCKET = 20_000
LEVELS = 4  # of dealing hot buckets again
PART_HASHES = 1 << 16  # of a text, counted together
PAIRS = 1 << 21  # of query and node, looked at together


# ---------------------------------------------------------------- fingerprints


def hashes(text: str, k: int = SHINGLE) -> np.ndarray:
    """XXH64 of each k-word shingle, repeats included; of the whole sequence if it has fewer words."""
    from xxhash import xxh64_intdigest as xx

    words = text.encode().lower().split()  # bytes: lower() changes A-Z only, split() knows ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xx(joined, SEED)], np.uint64)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-k])]
    return np.array([xx(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :], strict=True)], np.uint64)


def fingerprint(h: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    n = len(h)
    if not n:
        return 0
    if n > PART_HASHES:
        counts = sum(bit_counts(h[i : i + PART_HASHES]) for i in range(0, n, PART_HASHES))
    else:
        counts = bit_counts(h)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def bit_counts(h: np.ndarray) -> np.ndarray:
    """In how many of the hashes each bit is set, the highest first."""
    n = len(h)
    bits = np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(n, 64)
    if n > 255:  # eight counters of one byte to a lane, 255 hashes to a sum
        whole = n // 255 * 255
        lanes = np.ascontiguousarray(bits[:whole]).view(np.uint64).reshape(-1, 255, 8).sum(axis=1)
        return lanes.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.int64)
    return bits.sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", k: int = SHINGLE) -> DataFrame:
    """id, fp (the fingerprint's 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.array([fingerprint(hashes(t.as_py() or "", k)) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], [id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType([docs.schema[id_col], T.StructField("fp", T.LongType())]))


# ---------------------------------------------------------------- BK-trees


class Forest:
    """BK-trees over fingerprints, one for each bucket; buckets are runs of equal, ascending numbers."""

    def __init__(self, fps: np.ndarray, bucket: np.ndarray):
        n = len(fps)
        self.fps = fps
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if n else np.empty(0, np.int64)
        self.sizes = np.diff(np.append(first, n))
        self.roots = np.repeat(first, self.sizes)
        moving = np.setdiff1d(np.arange(n), first, assume_unique=True)
        node = self.roots[moving]
        edges, children = [], []
        while len(moving):  # all items go down one level; the first to take a new edge stays there
            edge = node * 65 + np.bitwise_count(fps[moving] ^ fps[node])
            order = np.argsort(edge, kind="stable")
            moving, edge = moving[order], edge[order]
            new = np.concatenate([[True], edge[1:] != edge[:-1]])
            edges.append(edge[new])
            children.append(moving[new])
            node = np.repeat(moving[new], np.diff(np.append(np.flatnonzero(new), len(edge))))[~new]
            moving = moving[~new]
        edges, children = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (edges, children))
        order = np.argsort(edges)
        self.edges, self.children = edges[order], children[order]  # an edge is parent * 65 + distance

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, other), query < other, of items of a bucket within the radius; queries are items."""
        q, node = queries, self.roots[queries]
        while len(q):
            d = np.bitwise_count(self.fps[q] ^ self.fps[node]).astype(np.int64)
            near = (d <= radius) & (q < node)
            yield q[near], node[near]
            lo = np.searchsorted(self.edges, node * 65 + np.maximum(d - radius, 1))
            hi = np.searchsorted(self.edges, node * 65 + np.minimum(d + radius, 64), "right")
            n = hi - lo
            q = np.repeat(q, n)
            node = self.children[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]

    def spanning(self, radius: int) -> np.ndarray:
        """For each item the smallest item that links within its bucket lead to."""
        parent = np.arange(len(self.fps))
        size = np.repeat(self.sizes, self.sizes)
        todo = np.flatnonzero(size > 1)
        block = np.cumsum(size[todo]) // PAIRS
        for queries in np.split(todo, np.flatnonzero(np.diff(block)) + 1) if len(todo) else ():
            for a, b in self.search(queries, radius):
                while len(a):
                    a, b = parent[a], parent[b]
                    open_ = a != b
                    a, b = a[open_], b[open_]
                    np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
                    while (up := parent[parent]).tobytes() != parent.tobytes():
                        parent = up
        return parent


def bands(bits: int, parts: int) -> list[int]:
    """Masks of the parts of the lowest bits."""
    cuts = [bits * i // parts for i in range(parts + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def parted(mask: int, parts: int) -> list[int]:
    """The mask with each of the parts of the bits that it leaves free."""
    free = [1 << i for i in range(64) if not mask >> i & 1]
    return [mask | sum(free[len(free) * j // parts : len(free) * (j + 1) // parts]) for j in range(parts)]


def keyed(nodes: DataFrame, radius: int, parts: int, most: int, levels: int = LEVELS) -> DataFrame:
    """choice, key, fp: each fingerprint in each of its buckets."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    masks = dict(enumerate(sum(c) for c in combinations(bands(64, parts), parts - radius)))
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in masks.items()])
    rows, out = nodes.select(F.explode(keys).alias("k"), "fp").select("k.*", "fp"), []
    for _ in range(levels):
        hot = saved(rows.groupBy("choice", "key").count().where(F.col("count") > most).select("choice", "key", F.lit(True).alias("hot")), "hot")
        if hot.isEmpty():
            break
        split = rows.join(hot, ["choice", "key"], "left")
        out.append(split.where("hot IS NULL").select("choice", "key", "fp"))
        # one of radius + 1 parts of the other bits is equal too: with it in the key, buckets are smaller and as whole
        base = max(masks) + 1  # numbers of choices are never used again
        finer = {base + k: (i, m) for k, (i, m) in enumerate((i, m) for i, mask in masks.items() for m in parted(mask, radius + 1))}
        masks = {k: m for k, (_, m) in finer.items()}
        table = nodes.sparkSession.createDataFrame([(i, k, signed(m)) for k, (i, m) in finer.items()], "choice int, next int, mask long")  # at most 20 * 4**levels rows
        again = split.where("hot").select("choice", "fp").join(F.broadcast(table), "choice")
        rows = saved(again.select(F.col("next").alias("choice"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp"), "dealt")
    for more in out:
        rows = rows.unionByName(more)
    return rows


def link(nodes: DataFrame, radius: int = RADIUS, parts: int = BANDS, most: int = BUCKET) -> DataFrame:
    """a, b: links that join all distinct fingerprints (fp of nodes) within the radius."""
    rows = keyed(nodes, radius, parts, most).repartition("choice", "key").sortWithinPartitions("choice", "key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # pieces of the bucket at hand

        def work(pieces: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            choice, key, fp = (np.concatenate(x) for x in zip(*pieces, strict=True))
            new = np.concatenate([[True], (choice[1:] != choice[:-1]) | (key[1:] != key[:-1])]) if len(key) else np.empty(0, bool)
            alone = new & np.append(new[1:], True) if len(key) else new
            bucket, fp = np.cumsum(new)[~alone], fp[~alone]
            if len(fp):
                to = Forest(fp.view(np.uint64), bucket).spanning(radius)
                moved = np.flatnonzero(to != np.arange(len(to)))
                yield pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[to[moved]])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)]
            first = held[0] if held else now
            if (first[0][0], first[1][0]) != (now[0][-1], now[1][-1]):  # a bucket has ended
                last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
                cut = int(last[-1]) + 1 if len(last) else 0
                yield from work([*held, [x[:cut] for x in now]])
                held, now = [], [x[cut:] for x in now]
            held.append(now)
        if held:
            yield from work(held)

    return rows.mapInArrow(run, "a long, b long")


# ---------------------------------------------------------------- operator


def near_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", k: int = SHINGLE, radius: int = RADIUS, parts: int = BANDS) -> DataFrame:
    """One row per document: id, fp, component_id (the smallest id that links lead to, its own included)."""
    rows = saved(fingerprints(docs, text_col, id_col, k), "fps")
    nodes = saved(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "nodes")
    found = components(link(nodes, radius, parts))
    rooted = saved(nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    named = attach(rooted, "root", "fp", rooted.groupBy("root").agg(F.min("least").alias("component_id"))).select("fp", "component_id")
    return attach(rows, "fp", id_col, named).select(id_col, "fp", "component_id")
