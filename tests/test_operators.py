import pytest
from pyspark.sql import functions as F

from landmosaic.operators import joins, metrics, quality, ranking


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(1000).select(F.col("id").alias("key"), F.when(F.col("id") % 10 < 7, "a").when(F.col("id") % 10 < 9, "b").otherwise("c").alias("cls"))


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_ranks_do_not_depend_on_partitions(rows, parts):
    want = {r.key: r.rank for r in ranking.exact_rank(rows, ["cls"], "key", "s").collect()}
    got = {r.key: r.rank for r in ranking.exact_rank(rows.repartition(parts), ["cls"], "key", "s").collect()}
    assert got == want
    assert sorted(v for k, v in got.items() if k % 10 == 9) == list(range(1, 101))


def test_split_has_no_leak_and_keeps_one_in_train(spark):
    objects = spark.createDataFrame([(i, "x" if i else "lone") for i in range(11)], "o int, cls string")
    split = ranking.stratified_split(objects, "cls", "o", 0.2).groupBy("cls", "split").count().collect()
    assert {(r.cls, r.split): r["count"] for r in split} == {("x", "val"): 2, ("x", "train"): 8, ("lone", "train"): 1}


@pytest.mark.parametrize(("target", "exact"), [(50, False), (250, False), (250, True), (333, True)])
def test_copies_reach_the_target(rows, target, exact):
    n = {r.cls: r["count"] for r in ranking.copies_to(rows, "cls", "key", target, "s", exact).groupBy("cls").count().collect()}
    assert n == {c: target if exact else max(target, k) for c, k in (("a", 700), ("b", 200), ("c", 100))}


def test_weights_of_an_image_add_up_to_one(rows):
    w = ranking.duplicate_weight(rows.withColumn("path", F.col("key") % 17), "path").groupBy("path").agg(F.round(F.sum("sample_weight"), 9).alias("w"))
    assert {r.w for r in w.collect()} == {1.0}


def test_first_per_class_and_sample(rows):
    got = ranking.first_per_class(rows, "cls", "key", 3).collect()
    assert sorted(r.key for r in got if r.cls == "c") == [9, 19, 29]
    assert ranking.per_class_sample(rows, "cls", "key", 35, "s").count() == 105


def test_index_is_the_global_order(rows):
    got = ranking.indexed(rows.repartition(9), ["cls", "key"]).orderBy("idx").collect()
    assert [r.idx for r in got] == list(range(1000))
    assert [(r.cls, r.key) for r in got] == sorted((r.cls, r.key) for r in got)


def test_empty_tables(rows):
    none = rows.where("false")
    assert ranking.exact_rank(none, ["cls"], "key", "s").count() == 0
    assert ranking.stratified_split(none, "cls", "key").count() == 0
    assert ranking.copies_to(none, "cls", "key", 5, "s").count() == 0


def test_merge_copies_and_weights(spark):
    base = spark.createDataFrame([(1, 0.5), (2, None)], "k int, sample_weight double")
    more = spark.createDataFrame([(3,)], "k int")
    got = sorted((r.k, r.sample_weight) for r in ranking.merged_sources(base, [(more, 2), (more, 0)]).collect())
    assert got == [(1, 0.5), (2, 1.0), (3, 1.0), (3, 1.0)]


def test_upsert_last_wins_and_blanks(spark):
    cols = "parcel_key string, class_ui string, subclass_ui string, class_corrected_ui string, subclass_corrected_ui string, photos_ui string, panorama_status_ui string"
    parcels = spark.createDataFrame([("a", *"12345", "ok"), ("b", *"12345", "ok")], cols)
    edits = spark.createDataFrame([("a", "x", None, "y", None, "z", None, 1), ("a", "n", None, "m", None, "l", None, 2), ("zz", *"12345", "s", 3)], f"{cols}, seq int")
    got = {r.parcel_key: tuple(r)[1:] for r in joins.upserted(parcels, edits).select(*parcels.columns).collect()}
    assert got == {"a": ("n", "", "m", "", "l", "ok"), "b": (*"12345", "ok")}


def test_radius_join_finds_what_brute_force_finds(spark):
    import random

    random.seed(3)
    pts = [(i, 55 + random.random() / 500, 37 + random.random() / 500) for i in range(150)]
    o = spark.createDataFrame([(f"o{i}", a, b) for i, a, b in pts[:60]] + [("none", None, 1.0)], "object_id string, lat double, lon double")
    p = spark.createDataFrame(pts[60:], "pano_id int, lat double, lon double")
    from math import asin, cos, radians, sin, sqrt

    d = lambda a, b: 2 * 6371000 * asin(sqrt(sin(radians(b[1] - a[1]) / 2) ** 2 + cos(radians(a[1])) * cos(radians(b[1])) * sin(radians(b[2] - a[2]) / 2) ** 2))
    want = {(f"o{a[0]}", b[0]) for a in pts[:60] for b in pts[60:] if d(a, b) <= 40}
    got = joins.nearby(o, p, 40.0).collect()
    assert {(r.object_id, r.pano_id) for r in got} == want and len(got) == len(want)


def test_greedy_losers_finish_their_loop(spark):
    # 0 loses to 1 but still takes 2 with it
    rows = spark.createDataFrame([("o", 0, 0, 1.0), ("o", 1, 1, 2.0), ("o", 2, 2, 0.5), ("o", 3, 1 << 40 | 0xFFFF, 9.0), ("p", 4, 0, 1.0)], "object_id string, seq long, ahash long, sharpness double")
    assert {r.seq for r in quality.greedy_losers(rows, 4).collect()} == {0, 2}


@pytest.mark.parametrize("near", [0, 3, 10])
def test_near_pairs_against_brute_force(spark, near):
    import random

    random.seed(1)
    base = [random.getrandbits(63) for _ in range(5)]
    data = [(f"o{i % 2}", i, base[i % 5] ^ sum(1 << b for b in random.sample(range(63), random.randrange(6)))) for i in range(60)]
    got = {(r.a, r.b) for r in quality.near_pairs(spark.createDataFrame(data, "object_id string, seq long, ahash long"), near).collect()}
    assert got == {(a[1], b[1]) for a in data for b in data if a[0] == b[0] and a[1] < b[1] and (a[2] ^ b[2]).bit_count() <= near}


def test_votes(spark):
    v = spark.createDataFrame([("p", 1, "a", 0.5), ("p", 2, "b", 0.5), ("p", 3, "b", 0.1), ("q", 1, "a", 0.2), ("t", 1, "x", 0.4), ("t", 2, "y", 0.4)] + [("p", 10 + i, "c", 1.0) for i in range(3)], "parcel_key string, view_index int, class_key string, confidence double")
    got = {r.parcel_key: (r.class_key, r.confidence) for r in metrics.voted(v, max_views=3).collect()}
    assert got == {"p": ("b", 0.3), "q": (None, None), "t": ("x", 0.4)}


def test_scores_count_absent_classes(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "t long, p long")
    s = metrics.class_scores(metrics.confusion(rows, "t", "p"), spark.range(4).withColumnRenamed("id", "class_id"))
    assert metrics.macro(s).first().macro_f1 == pytest.approx((2 / 3 + 2 / 3) / 4, abs=1e-6)


def test_providers_first_wins(spark):
    a, b = (spark.createDataFrame(x, "point_id int, url string") for x in ([(1, "u"), (1, " ")], [(1, "u"), (1, "v"), (2, None)]))
    assert {(r.point_id, r.url, r.priority) for r in joins.first_provider([a, b]).collect()} == {(1, "u", 0), (1, "v", 1)}


def test_null_classes_and_keys_keep_their_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, None), (None, "a")], "key int, cls string")
    assert ranking.copies_to(rows, "cls", "key", 1, "s").count() == 4
    split = ranking.stratified_split(rows, "cls", "key", 0.5).collect()
    assert sorted((str(r.cls), r.split) for r in split) == [("None", "train"), ("None", "val"), ("a", "train"), ("a", "val")]
    assert ranking.copies_by_ratio(rows, "cls").count() == 4
    assert sorted(r.sample_weight for r in ranking.duplicate_weight(rows, "cls").collect()) == [0.5] * 4


def test_leaks_raise(spark):
    rows = spark.createDataFrame([(1, "train"), (1, "val"), (2, "val")], "object_id int, split string")
    with pytest.raises(ValueError, match="more than one split: 1"):
        joins.without_leak(rows, "object_id")
    assert joins.without_leak(rows.where("object_id = 2"), "object_id").count() == 1


def test_links_only_where_asked(spark):
    p = spark.createDataFrame([(i, f"p{i}", "" if i % 2 else "there") for i in range(10)], "oid int, parcel_key string, photos_ui string")
    got = {r.oid: r.photos_ui for r in joins.linked(p, F.lit("new"), p.where("oid > 2"), 2).collect()}
    assert got == {i: "new" if i in (3, 5) else "" if i % 2 else "there" for i in range(10)}


def test_best_runs(spark):
    runs = spark.createDataFrame([(1, 6, 0.5, None, 0.9), (2, 6, 0.7, 0.5, 0.1), (3, 3, 0.9, None, 0.2), (4, 3, 0.9, None, 0.3)], "run int, n_classes int, val_acc double, val_macro_f1 double, val_balanced_f1 double")
    assert [metrics.best_run(runs, "checkpoint", k).first().run for k in (6, 3)] == [1, 3]
    assert metrics.best_run(runs.where("false"), "checkpoint", 6).count() == 0


def test_first_eligible_counts_rows_without_a_place_and_repeated_ones(spark):
    rows = spark.createDataFrame([(None, 1), (1, 1), (2, 1), (2, 1), (0, 0)], "oid int, ok int")
    for most, want in ((1, [None]), (2, [None, 1]), (3, [None, 1, 2]), (9, [None, 1, 2, 2])):
        got = ranking.first_eligible(rows, F.col("ok") == 1, "oid", most).collect()
        assert len(got) == 5 and sorted([r.oid for r in got if r.selected], key=lambda x: (x is not None, x or 0)) == want


def test_index_over_many_partitions_and_ties(spark):
    rows = spark.range(5000).select((F.col("id") % 7).alias("k"), "id").repartition(13)
    got = ranking.indexed(rows, ["k"]).orderBy("idx").collect()
    assert [r.idx for r in got] == list(range(5000)) and [r.k for r in got] == sorted(r.k for r in got)
    assert ranking.indexed(rows.limit(0), ["k"]).count() == 0
