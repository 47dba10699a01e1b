"""Near-duplicates against the plain loop, and in sizes that pairs would not bear."""

import random

import pytest
from pyspark.sql import functions as F

from landmosaic.operators import duplicates

COLUMNS = "object_id string, seq long, ahash long, sharpness double"


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def by_loop(rows, near):
    lost, of = set(), {}
    for o, s, h, q in sorted(rows, key=lambda r: r[1]):
        if o is not None and h is not None:
            of.setdefault(o, []).append((s, h, float("-inf") if q is None else q))
    for o, crops in of.items():
        gone = set()
        for i, (a, ha, sa) in enumerate(crops):
            if a in gone:
                continue
            for b, hb, sb in crops[i + 1 :]:
                if b not in gone and ((ha ^ hb) & (2**64 - 1)).bit_count() <= near:
                    gone.add(a if sa < sb else b)
        lost |= {(o, s) for s in gone}
    return lost


def made_up(rng, objects, n, bases, flips, levels):
    base = [[rng.getrandbits(64) for _ in range(bases)] for _ in range(objects)]
    out = []
    for i in range(n):
        o = rng.randrange(objects)
        h = rng.choice(base[o])
        for b in rng.sample(range(64), rng.randrange(flips + 1)):
            h ^= 1 << b
        out.append((f"o{o}", i, signed(h), float(rng.randrange(levels))))
    return out


@pytest.mark.parametrize(("near", "flips", "levels", "last"), [(4, 3, 5, 0), (4, 2, 50, 0), (4, 3, 3, 10**6), (0, 1, 4, 0), (10, 6, 8, 5), (24, 9, 6, 0)])
def test_losers_are_those_of_the_loop(spark, near, flips, levels, last):
    rng = random.Random(near * 100 + levels)
    rows = made_up(rng, 6, 400, 3, flips, levels) + [(None, 9000, 0, 1.0), ("o0", 9001, None, 1.0), ("o0", 9002, 5, None), ("o0", 9003, 5, None)]
    got = {(r.object_id, r.seq) for r in duplicates.greedy_losers(spark.createDataFrame(rows, COLUMNS).repartition(3), near, last).collect()}
    assert got == by_loop(rows, near)


@pytest.mark.parametrize("last", [0, 10**6])
def test_a_chain_of_ever_blurrier_neighbours(spark, last):
    rows, h = [], 0
    for i in range(40):  # each is near to the next two only
        h ^= (1 << (i % 32)) | (1 << (32 + i % 32))
        rows.append(("o", i, signed(h), float(-i)))
    got = {(r.object_id, r.seq) for r in duplicates.greedy_losers(spark.createDataFrame(rows, COLUMNS), 4, last).collect()}
    assert got == by_loop(rows, 4)


def test_an_object_with_a_hundred_thousand_rows(spark):
    n = 100_000
    rows = spark.range(n).select(F.lit("o").alias("object_id"), F.col("id").alias("seq"), F.when(F.col("id") % 2 == 0, 1).otherwise(1 << 40).cast("long").alias("ahash"), (F.col("id") * 7919 % 10007).cast("double").alias("sharpness"))
    got = duplicates.greedy_losers(rows, 4)
    best = max(range(n), key=lambda i: (i * 7919 % 10007, -i))
    assert got.count() == n - 1 and got.where(F.col("seq") == best).isEmpty()
    members, pairs = duplicates.representatives(rows, 4)
    assert members.count() == n and [tuple(r) for r in pairs.collect()] == [("o", 0, 1, 2)]


@pytest.mark.parametrize("near", [0, 3, 4, 10, 24])
def test_near_groups_against_brute_force(spark, near):
    rng = random.Random(near)
    hashes = {(o, h) for o, _, h, _ in made_up(rng, 2, 260, 4, 7, 2)}
    got = [tuple(r) for r in duplicates.near_groups(spark.createDataFrame(sorted(hashes), "object_id string, ahash long"), near).collect()]
    want = {(o, a, b) for o, a in hashes for p, b in hashes if o == p and a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= near}
    assert set(got) == want and len(got) == len(want)


def test_the_plan_probes_more_when_hashes_are_many():
    assert duplicates.plan(24, 8) == (0, 0) and duplicates.plan(4, 50) == (5, 0)
    assert duplicates.plan(4, 5_000) == (5, 0)
    parts, radius = duplicates.plan(4, 10**8)
    assert parts < 5 and radius == 4 // parts


def test_empty_tables(spark):
    none = spark.createDataFrame([], COLUMNS)
    assert duplicates.greedy_losers(none, 4).count() == 0 and duplicates.representatives(none, 4)[1].count() == 0
