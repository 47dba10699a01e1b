"""Near-dedup: SimHash links first, and large groups of near copies don't give all their pairs."""

import random

import pytest

pytest.importorskip("xxhash")

from landmosaic.llm import common, components, near_copies


def test_f5_fingerprints_within_three_bits_are_linked(spark):
    fps = [0b0, 0b111, 0b1111000, 0b1111111, (1 << 60) - 1, 0b0]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "node long, fp long")
    pairs = {(r.a, r.b) for r in near_copies.fingerprint_pairs(df).collect()}
    assert (0, 5) in pairs and (0, 1) in pairs and (2, 3) in pairs and not any(4 in p for p in pairs)


def test_a_group_of_near_copies_gives_few_pairs(spark, monkeypatch):
    """Copies that are similar to their original only: two of them rarely are similar."""
    r, n = random.Random(5), 120
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words)]
    for i in range(n):
        v = list(words)
        for j in range(4):
            v[50 * j + r.randrange(45)] = f"x{i}y{j}"
        texts.append(" ".join(v))
    looked_at, verified = [], near_copies.verified

    def counted(pairs, *rest):
        looked_at.append(pairs.distinct().count())
        return verified(pairs, *rest)

    monkeypatch.setattr(near_copies, "verified", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [x.doc_id for x in near_copies.drop_near_copies(df).collect()] == [0]
    assert max(looked_at) <= 10 * n


def test_links_that_are_stars_take_no_round(spark, monkeypatch):
    tables, saved = [], components.saved
    monkeypatch.setattr(components, "saved", lambda df, kind="table": tables.append(kind) or saved(df, kind))
    got = {r.node: r.root for r in components.components(spark.createDataFrame([(1, 2), (3, 1), (8, 7), (7, 8)], "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 8: 7} and len(tables) == 1
    tables.clear()
    got = {r.node: r.root for r in components.components(spark.createDataFrame([(1, 2), (2, 3), (8, 7), (9, 8)], "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 8: 7, 9: 7} and len(tables) == 2


def test_a_process_keeps_one_model_at_a_time(monkeypatch):
    monkeypatch.setattr(common, "_models", {})
    first = common.model("a", lambda: [1])
    assert common.model("a", lambda: [2]) is first
    assert common.model("b", lambda: [3]) == [3] and list(common._models) == ["b"]
    assert list(common.released(iter([]))) == [] and list(common._models) == ["b"]
    assert list(common.released(iter([]), alone=True)) == [] and not common._models
