"""What a reviewer found in round 3: issues without rows, answers that share a crop, labels that share a path, full places."""

import random

from pyspark.sql import functions as F

from landmosaic.functions import geo
from landmosaic.operators import joins, metrics
from landmosaic.plans import jobs
from landmosaic.plans import job_queries as _jobs  # noqa: F401  (registers its queries)
from landmosaic.plans.queries import QUERIES
from landmosaic.sources.tables import work_path
from landmosaic.streaming import jobs as streams


def test_f1_an_issue_without_rows_is_listed(spark):
    rows = [(1, "a", "o1", 1.0, 9.0, "p", "s", True, True), (2, "a", "o2", None, 9.0, "q", "s", True, True)]
    df = spark.createDataFrame(rows, "seq long, class_name string, object_id string, bearing double, distance_m double, image_path string, source_path string, source_there boolean, crop_there boolean")
    got = {(r.kind, r.key): (r.n, r.first) for r in metrics.sample_audit(df).collect()}
    assert got == {("issue", "null_bearing"): (1, "o2"), ("issue", "close_target_m"): (0, None), ("issue", "missing_source"): (0, None), ("issue", "missing_crop"): (0, None), ("class", "a"): (2, None)}


def test_f3_every_answer_of_a_crop_is_labelled_once(spark):
    source, path, first, second = (work_path(spark, k) for k in ("answers", "labels", "one", "two"))
    schema = "image_path string, raw string"

    def run(rows, checkpoint):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        streams.ingest_answers(spark.readStream.schema(schema).parquet(source), path, checkpoint, every=True)
        return sorted((r.image_path, r.vlm_label) for r in streams.ingested(spark, path).collect())

    want = [("a", "active_urban"), ("a", "natural_areas"), ("b", "active_urban")]
    assert run([("a", "natural_areas"), ("a", "active_urban"), ("b", "active_urban"), ("a", "natural_areas")], first) == want
    assert run([("a", "active_urban"), ("b", "natural_areas")], first) == [*want, ("b", "natural_areas")]
    assert run([("c", "active_urban")], second) == sorted([*want, ("b", "natural_areas"), ("c", "active_urban")])  # sees all again


def test_f4_the_last_label_of_an_objects_first_path_is_its_class(spark):
    names = ("natural_areas", "active_urban")
    crops = spark.createDataFrame([(i, f"o{i:02}", "x", f"p{i:02}", "train") for i in range(40)], "seq long, object_id string, class_name string, image_path string, split string")
    rows = [(k * 40 + i, f"p{i:02}", names[(i + k) % 2], True) for k in (0, 1) for i in range(40)]
    for seed in (1, 2, 3):
        random.Random(seed).shuffle(rows)
        labels = spark.createDataFrame(rows, "line long, image_path string, vlm_label string, vlm_confident boolean").repartition(5)
        got = jobs.strong_build(crops, labels, 100, line="line").where("split = 'val'").select("object_id").distinct()
        val = {r.object_id for r in got.collect()}
        last = {f"o{i:02}": names[(i + 1) % 2] for i in range(40)}
        want = spark.createDataFrame(list(last.items()), "object_id string, class_name string").withColumn("image_path", F.col("object_id"))
        from landmosaic.operators import ranking

        assert val == {r.object_id for r in ranking.minimum_split(want, "class_name", "object_id", "image_path").where("split = 'val'").collect()}


def places(spark, n_objects, n_panoramas):
    o = spark.range(n_objects).select(F.concat(F.lit("o"), "id").alias("object_id"), (F.lit(55.0) + F.col("id") % 2 / 1e3).alias("lat"), F.lit(37.0).alias("lon"))
    p = spark.range(n_panoramas).select(F.col("id").alias("pano_id"), (F.lit(55.0) + F.col("id") % 2 / 1e3 + F.col("id") % 3 / 1e5).alias("lat"), F.lit(37.0).alias("lon"), F.timestamp_seconds(F.col("id") % 7).alias("ts"), F.concat(F.lit("s"), (F.col("id") % 5).cast("string")).alias("season"))
    return o, p


def written(df, spark):
    """Rows that each shuffle of the plan wrote."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if node.nodeName().endswith("QueryStage"):
            return walk(node.plan())
        if node.nodeName() == "Exchange":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(plan)
    return found


def test_f6_f7_pairs_of_full_places_are_never_shuffled(spark):
    o, p = places(spark, 300, 600)
    near = joins.nearby(o, p, 5.0)
    assert near.count() == 300 * 300 and max(written(near, spark)) <= 600
    picks = joins.season_picks(o, p, 5.0)
    assert max(written(picks, spark)) <= 300 * 5
    pairs = joins.nearby(o, p, 5.0, digits=6).join(p, "pano_id").collect()
    want = {}
    for r in sorted(pairs, key=lambda r: (r.distance_m, -r.ts.timestamp(), r.pano_id)):
        want.setdefault(r.object_id, {}).setdefault(r.season, (r.distance_m, r.pano_id))
    want = {(k, s, p) for k, v in want.items() for s, (d, p) in sorted(v.items(), key=lambda x: (x[1][0], x[0]))[:4]}
    assert {(r.object_id, r.season, r.pano_id) for r in picks.collect()} == want and picks.count() == len(want)


def test_f8_f9_heavy_rows_are_spread(spark):
    for name in ("f21_boundary_points", "f23_chosen_points", "f24_one_view_point", "f25_nearest_edge"):
        df = QUERIES[name](spark, "/root/testdata/sf0.001")
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        below = plan[plan.index("RepartitionByExpression") :]
        assert df.rdd.getNumPartitions() >= 4 and "Join" not in plan and "Aggregate" not in plan and "aggregate(" not in below and "transform(" not in below, name


def test_f9_the_first_of_equal_edges_is_nearest(spark):
    ring = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0))])
    at = lambda lat, lon, of=ring: spark.range(1).select(geo.nearest_edge(of, F.lit(lat), F.lit(lon)).alias("i")).first()[0]
    assert [at(-3.0, 0.5), at(0.5, 3.0), at(5.0, 0.5), at(0.5, -3.0), at(0.5, 0.5, F.slice(ring, 1, 1))] == [0, 1, 2, 3, None]
    assert at(0.0, 0.0, F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(0.0).alias("lat")) for x in (-1.0, 1.0, -1.0)])) == 0
