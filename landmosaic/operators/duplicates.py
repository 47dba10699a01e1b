"""Near-duplicates by hash: groups of equal hashes, near groups by multi-index probing, and the greedy choice in rounds.

Rows: object_id, seq (the order), ahash (64 bits), sharpness. Rows without an object or a hash are nobody's near-duplicate;
an unknown sharpness is the least.

The greedy choice goes through an object's rows in order: a row that hasn't lost is compared with all later ones that
haven't, and of a near pair the less sharp loses, the later one on ties; a row that loses still finishes its comparisons.
What decides is little of all pairs:

- A row is *active* when its turn comes unless an earlier active one, near and at least as sharp, has beaten it. So only rows
  that are sharper than all earlier ones of the same hash (its *records*) can be active: what beats an earlier one beats the
  later, less sharp one of the same hash as well.
- Of a hash only the first of the sharpest can be left, and it loses in its own turn if a later, sharper row of a near hash
  hasn't been beaten by then.

Whether records are active is a fixpoint: one is once no earlier, near, sharper one is left undecided. It is found in rounds
of joins over the undecided pairs, written between rounds; when at most LAST pairs are left they are gone through in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import hamming
from ..sources.tables import kept

SALTS, LAST, MASKS = 64, 200_000, 3_000


def _parts(n: int) -> list[tuple[int, int]]:
    return [(64 * i // n, 64 * (i + 1) // n) for i in range(n)]


def plan(near: int, hashes: int) -> tuple[int, int]:
    """Into how many parts to cut, and in how many bits a part may differ, for the least work on so many different hashes: two
    hashes within `near` bits agree in a part up to near // parts. No parts: all pairs of an object's hashes."""
    choices = {(0, 0): float(hashes)} if hashes <= 64 else {}
    for n in range(1, near + 2):
        radius, bits = near // n, 64 // n
        probes = sum(comb(bits + (64 % n > 0), k) for k in range(radius + 1))
        if probes <= MASKS:
            choices[n, radius] = n * probes * (1 + hashes / 2.0**bits)
    return min(choices, key=choices.get)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def near_groups(groups: DataFrame, near: int) -> DataFrame:
    """object_id, ga, gb (ga < gb): pairs of an object's different hashes (object_id, ahash, one row each) within `near` bits."""
    most = groups.groupBy("object_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]
    n, radius = plan(near, most)
    close = (F.col("ga") < F.col("gb")) & (hamming(F.col("ga"), F.col("gb")) <= near)
    if n == 0:
        b = groups.select(F.col("object_id").alias("_of"), F.col("ahash").alias("gb"))
        return groups.withColumnRenamed("ahash", "ga").join(b, (F.col("object_id") == F.col("_of")) & close).select("object_id", "ga", "gb")
    cuts = _parts(n)
    masks = [_signed((1 << b) - (1 << a)) for a, b in cuts]
    own = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("ahash").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(masks)]))
    held = groups.select("object_id", F.col("ahash").alias("gb"), own.alias("p")).select("object_id", "gb", "p.*")
    flips = [(i, _signed(sum(1 << x for x in some))) for i, (a, b) in enumerate(cuts) for k in range(radius + 1) for some in combinations(range(a, b), k)]
    spread = groups.sparkSession.createDataFrame(flips, "i int, flip long").join(F.broadcast(groups.sparkSession.createDataFrame(list(enumerate(masks)), "i int, mask long")), "i")
    probes = groups.withColumnRenamed("ahash", "ga").crossJoin(F.broadcast(spread))  # at most MASKS * parts, by the plan
    probes = probes.select("object_id", "ga", "i", F.col("ga").bitwiseXOR(F.col("flip")).bitwiseAND(F.col("mask")).alias("v"))
    met = held.join(probes, ["object_id", "i", "v"]).where(close)
    apart = lambda m: F.bit_count(F.col("ga").bitwiseXOR(F.col("gb")).bitwiseAND(F.lit(m)))
    first = F.coalesce(*[F.when(apart(m) <= radius, F.lit(i)) for i, m in enumerate(masks)])  # a pair comes from one part only
    return met.where(F.col("i") == first).select("object_id", "ga", "gb")


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("object_id", F.col("ga").alias("g"), F.col("gb").alias("h")).unionByName(pairs.select("object_id", F.col("gb").alias("g"), F.col("ga").alias("h")))


def representatives(crops: DataFrame, near: int) -> tuple[DataFrame, DataFrame]:
    """Groups of equal hashes with their membership (object_id, seq, rep: the group's least seq, n: its rows), and the near pairs
    of representatives (object_id, a, b, distance). Equal rows aren't expanded to pairs: 1e5 of them are 1e5 rows."""
    rows = crops.where("object_id IS NOT NULL AND ahash IS NOT NULL").select("object_id", "seq", "ahash")
    groups = rows.groupBy("object_id", "ahash").agg(F.min("seq").alias("rep"), F.count("*").alias("n"))
    groups = kept(groups, "groups")
    pairs = near_groups(groups.select("object_id", "ahash"), near)
    of = lambda h, name: groups.select("object_id", F.col("ahash").alias(h), F.col("rep").alias(name))
    ends = pairs.join(of("ga", "x"), ["object_id", "ga"]).join(of("gb", "y"), ["object_id", "gb"])
    ends = ends.select("object_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), hamming(F.col("ga"), F.col("gb")).alias("distance"))
    return rows.join(groups, ["object_id", "ahash"]).select("object_id", "seq", "rep", "n"), ends


def _records(rows: DataFrame) -> DataFrame:
    """Rows that are sharper than all earlier ones of their hash: within salted parts first, so that no part has a whole hash."""
    before = lambda *by: F.max("sharp").over(Window.partitionBy("object_id", "ahash", *by).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    for by in (["_salt"], []):
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("seq"), F.lit(SALTS))).withColumn("_before", before(*by)).where("_before IS NULL OR sharp > _before")
    return rows.drop("_salt", "_before")


def _beaten(pairs: DataFrame, last: int) -> tuple[DataFrame, int]:
    """object_id, seq of records that are not active, and the number of rounds. pairs: object_id, a, b: a, if active, beats b."""
    spark, schema = pairs.sparkSession, "object_id {}, seq long"
    schema = schema.format(pairs.schema["object_id"].dataType.simpleString())
    pairs, found, rounds = kept(pairs, "undecided"), [], 0
    end = lambda df, c: df.select("object_id", F.col(c).alias("seq")).distinct()
    off = lambda df, c, gone, how: df.join(gone.withColumnsRenamed({"object_id": "_of", "seq": "_seq"}), (F.col("object_id") == F.col("_of")) & (F.col(c) == F.col("_seq")), how)
    while (n := pairs.count()) > last:
        rounds += 1
        undecided = end(pairs, "b")  # those that might yet be beaten
        beaten = kept(end(off(pairs, "a", undecided, "left_anti"), "b"), "beaten")  # by one that can't be any more
        found.append(beaten)
        pairs = kept(off(off(pairs, "b", beaten, "left_anti"), "a", beaten, "left_anti"), "undecided")

    def through(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lost: set = set()
        for f in frames:
            for o, a, b in zip(f["object_id"], f["a"], f["b"], strict=True):
                if (o, a) not in lost:
                    lost.add((o, b))
        yield pd.DataFrame([*lost], columns=["object_id", "seq"])

    if n:  # at most `last` pairs in all: in order of the earlier row, so that it is decided when it is looked at
        found.append(pairs.coalesce(1).sortWithinPartitions("object_id", "a", "b").mapInPandas(through, schema))
    out = spark.createDataFrame([], schema)
    for part in found:
        out = out.unionByName(part)
    return kept(out, "beaten"), rounds


def greedy_losers(crops: DataFrame, near: int, last: int = LAST) -> DataFrame:
    """object_id, seq of those that lose; see the module's text."""
    rows = crops.where("object_id IS NOT NULL AND ahash IS NOT NULL AND seq IS NOT NULL").select("object_id", "seq", "ahash", F.coalesce(F.col("sharpness").cast("double"), F.lit(float("-inf"))).alias("sharp"))
    rows = kept(rows, "rows")
    best = F.max_by(F.struct("seq", "sharp"), F.struct("sharp", -F.col("seq"))).alias("m")
    groups = kept(rows.groupBy("object_id", "ahash").agg(best).select("object_id", "ahash", F.col("m.seq").alias("seq"), F.col("m.sharp").alias("sharp")), "groups")
    near_ones = kept(_both_ways(near_groups(groups.select("object_id", "ahash"), near)), "near")
    records = kept(_records(rows).distinct(), "records")
    as_ = lambda df, h, **names: df.select("object_id", F.col("ahash").alias(h), *[F.col(c).alias(n) for c, n in names.items()])
    linked = near_ones.join(as_(records, "g", seq="a", sharp="sa"), ["object_id", "g"])
    pairs = linked.join(as_(records, "h", seq="b", sharp="sb"), ["object_id", "h"]).where((F.col("a") < F.col("b")) & (F.col("sa") >= F.col("sb")))
    beaten, _ = _beaten(pairs.select("object_id", "a", "b"), last)
    active = records.join(beaten.withColumnRenamed("seq", "_seq").withColumnRenamed("object_id", "_of"), (F.col("object_id") == F.col("_of")) & (F.col("seq") == F.col("_seq")), "left_anti")
    # when a hash's sharpest row is beaten, if it is, by one of another hash
    tops = as_(groups, "h", seq="top", sharp="st")
    killers = near_ones.join(as_(active, "g", seq="a", sharp="sa"), ["object_id", "g"]).join(tops, ["object_id", "h"])
    killed = killers.where(F.col("sa") >= F.col("st")).groupBy("object_id", "h").agg(F.min("a").alias("killed"))
    winners = groups.join(active.select("object_id", F.col("seq").alias("_seq")).withColumnRenamed("object_id", "_of"), (F.col("object_id") == F.col("_of")) & (F.col("seq") == F.col("_seq")), "left_semi")
    rivals = near_ones.join(as_(winners, "g", seq="x", sharp="sx"), ["object_id", "g"]).join(tops, ["object_id", "h"]).where((F.col("top") > F.col("x")) & (F.col("st") > F.col("sx")))
    rivals = rivals.join(killed, ["object_id", "h"], "left").where(F.col("killed").isNull() | (F.col("killed") > F.col("x")))
    left = winners.join(rivals.select(F.col("object_id").alias("_of"), F.col("x").alias("_seq")), (F.col("object_id") == F.col("_of")) & (F.col("seq") == F.col("_seq")), "left_anti")
    left = left.select(F.col("object_id").alias("_of"), F.col("seq").alias("_seq"))
    return rows.join(left, (F.col("object_id") == F.col("_of")) & (F.col("seq") == F.col("_seq")), "left_anti").select("object_id", "seq").distinct()


def near_pairs(crops: DataFrame, near: int) -> DataFrame:
    """object_id, a, b (seq, a < b): all near pairs of an object's rows, equal ones too, written out. For reports on small
    objects; representatives() says the same without the square of equal rows."""
    rows = crops.where("object_id IS NOT NULL AND ahash IS NOT NULL").select("object_id", "seq", "ahash")
    groups = kept(rows.select("object_id", "ahash").distinct(), "hashes")
    pairs = _both_ways(near_groups(groups, near)).unionByName(groups.select("object_id", F.col("ahash").alias("g"), F.col("ahash").alias("h")))
    a = rows.select("object_id", F.col("ahash").alias("g"), F.col("seq").alias("a"))
    b = rows.select("object_id", F.col("ahash").alias("h"), F.col("seq").alias("b"))
    return pairs.join(a, ["object_id", "g"]).join(b, ["object_id", "h"]).where("a < b").select("object_id", "a", "b").distinct()

