"""Streams: repeated, late and restarted batches, and new checkpoints on old folders."""

import pytest
from pyspark.sql import functions as F

from landmosaic.operators.joins import EDITED
from landmosaic.sources.tables import folders, work_path
from landmosaic.streaming import jobs

ANSWER = "image_path string, raw string"
FIX = f"parcel_key string, {', '.join(f'{c} string' for c in EDITED)}, panorama_status_ui string, seq long"


def arrived(spark, source, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    return spark.readStream.schema(schema).parquet(source)


def labels(spark, path):
    return sorted((r.image_path, r.vlm_label) for r in jobs.ingested(spark, path).collect())


def test_crops_are_labelled_once(spark):
    source, path, first, second = (work_path(spark, k) for k in ("answers", "labels", "one", "two"))
    jobs.ingest_answers(arrived(spark, source, [("a", "natural_areas"), ("b", "active_urban"), ("a", "natural_areas"), (None, "active_urban")], ANSWER), path, first)
    jobs.ingest_answers(arrived(spark, source, [("a", "active_urban"), ("c", "active_urban")], ANSWER), path, first)
    want = [("a", "natural_areas"), ("b", "active_urban"), ("c", "active_urban")]
    assert labels(spark, path) == want
    jobs.ingest_answers(arrived(spark, source, [("c", "natural_areas"), ("d", "natural_areas")], ANSWER), path, second)  # sees all again
    assert labels(spark, path) == [*want, ("d", "natural_areas")]


def test_a_batch_looks_up_its_own_keys_only(spark):
    source, path, checkpoint = (work_path(spark, k) for k in ("answers", "labels", "one"))
    jobs.ingest_answers(arrived(spark, source, [(f"p{i}", "active_urban") for i in range(20_000)], ANSWER), path, checkpoint)
    stream = jobs.ingest_answers(arrived(spark, source, [("p1", "active_urban"), ("new", "active_urban")], ANSWER), path, checkpoint)
    seen = [p for p in stream.recentProgress if p.numInputRows]
    assert [p.numInputRows for p in seen] == [2]  # the new rows: no label that was written is read
    (state,) = seen[0].stateOperators
    assert state.numRowsTotal == 20_001 and state.numRowsUpdated == 1 and "rocksdb" in " ".join(state.customMetrics).lower()


def fix(key, seq, value):
    return (key, *[f"{value}{seq}"] * len(EDITED), None, seq)


def parcels(spark, keys):
    return spark.createDataFrame([(k, *["old"] * len(EDITED), "ok") for k in keys], FIX.rpartition(",")[0])


def found(spark, folder, keys="abcdef"):
    return {r.parcel_key: r.class_ui for r in jobs.latest(parcels(spark, keys), folder).collect()}


def test_late_repeated_and_restarted_batches(spark):
    source, folder, one, two = (work_path(spark, k) for k in ("fixes", "folder", "one", "two"))
    run = lambda rows, checkpoint, most=8: jobs.upsert_corrections(arrived(spark, source, rows, FIX), folder, checkpoint, 4, most)
    run([fix("a", 5, "x"), fix("b", 1, "x")], one)
    run([fix("a", 2, "late"), fix("c", 3, "x"), fix("c", 4, "x")], one)
    want = {"a": "x5", "b": "x1", "c": "x4", "d": "old", "e": "old", "f": "old"}
    assert found(spark, folder) == want
    run([fix("d", 1, "y")], two)  # a new checkpoint on the old folder, which sees all again
    want["d"] = "y1"
    assert found(spark, folder) == want
    (batch,) = folders(spark, f"{folder}/changes/run={jobs._run_of(spark, two)}/batch=0")
    kept = spark.read.parquet(batch).select(*[F.col(c) for c in [*[x.split()[0] for x in FIX.split(", ")], "bucket"]]).collect()
    jobs.upsert_corrections(arrived(spark, source, [(None, *["n"] * (len(EDITED) + 1), 9)], FIX), folder, two, 4)
    assert kept and found(spark, folder) == want


def test_only_full_buckets_are_merged(spark):
    source, folder, checkpoint = (work_path(spark, k) for k in ("fixes", "folder", "one"))
    key_of = {}
    for r in spark.createDataFrame([(f"k{i}",) for i in range(40)], "parcel_key string").withColumn("b", jobs._bucket(4)).collect():
        key_of.setdefault(r.b, r.parcel_key)
    wrote = []
    for i in range(4):
        wrote += jobs.upsert_corrections(arrived(spark, source, [fix(key_of[0], i, "x")] + ([fix(key_of[1], 1, "y")] if not i else []), FIX), folder, checkpoint, 4, 2)
    assert [w.rpartition("/")[2] for w in wrote] == ["bucket=0"]
    left = [p.rpartition("/")[2] for p in folders(spark, f"{folder}/changes/run=*/batch=*/bucket=*")]
    assert sorted(left) == ["bucket=0", "bucket=1"]
    assert found(spark, folder, [key_of[0], key_of[1]]) == {key_of[0]: "x3", key_of[1]: "y1"}


def test_merging_again_changes_nothing(spark):
    source, folder, checkpoint = (work_path(spark, k) for k in ("fixes", "folder", "one"))
    stream = arrived(spark, source, [fix(k, s, "x") for k in "abc" for s in range(5)], FIX)
    jobs.upsert_corrections(stream, folder, checkpoint, 2, 8)
    before = found(spark, folder)
    for _ in range(2):
        jobs.merged(spark, folder, stream.select("parcel_key", *jobs.CORRECTION, "seq").schema, 0)
        assert found(spark, folder) == before == {"a": "x4", "b": "x4", "c": "x4", "d": "old", "e": "old", "f": "old"}
    assert found(spark, work_path(spark, "none")) == {k: "old" for k in "abcdef"}


def test_a_cluster_must_name_the_shared_folder():
    class Unset:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Unset(), Context()

    with pytest.raises(ValueError, match="must name a folder"):
        work_path(Session(), "x")
