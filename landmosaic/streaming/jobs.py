"""Incremental labels and corrections. Checkpoints make them resumable; each runs on what has arrived and ends.

Both keep what they have seen by key, so that a batch costs what its own keys cost, however long the history is: labels in
the stream's state store, corrections as change files in buckets of keys that are merged now and then.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.rules import is_confident, parsed_class
from ..operators.joins import EDITED, upserted
from ..sources.tables import folders, removed

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
LABELS = "image_path string, vlm_label string, vlm_confident boolean, answer string"


def _run_of(spark: SparkSession, checkpoint: str) -> str:
    """The name that a stream keeps as long as it has this checkpoint."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0])["id"]


def ingest_answers(answers: DataFrame, path: str, checkpoint: str, every: bool = False) -> StreamingQuery:
    """A stream of (image_path, raw) to parsed labels; each crop is labelled once, over all runs into this folder, or, with every,
    each of a crop's different answers is.

    The crops that a checkpoint has seen are keys in its state store (RocksDB, of which changes are saved): a batch looks up its
    own keys there and reads none of the labels that were written. Only where the folder has labels of other checkpoints
    are those compared, too. A batch writes under the stream's name and its number, so one that is tried again replaces its own
    labels. Of several answers for a crop the first batch's counts, within a batch any. Answers without a path are passed over.
    With every, answers are told apart by path and SHA-256 of their text, which is written as answer, and those are the keys."""
    spark = answers.sparkSession
    spark.createDataFrame([], LABELS).write.mode("ignore").parquet(f"{path}/run=none/batch=-1")
    runs = {p.rpartition("run=")[2] for p in folders(spark, f"{path}/run=*")} - {"none"}
    known: dict[str, str] = {}

    def apply(batch: DataFrame, number: int) -> None:
        run = known.setdefault("run", _run_of(spark, checkpoint))
        rows = batch.select("image_path", parsed_class(F.col("raw")).alias("vlm_label"), is_confident(F.col("raw")).alias("vlm_confident"), "answer")
        if others := sorted(runs - {run}):
            there = ingested(spark, path).where(F.col("run").isin(others)).select(F.col("image_path").alias("_there"), F.col("answer").alias("_answer"))
            same = F.col("image_path") == F.col("_there")
            rows = rows.join(there, same & F.col("answer").eqNullSafe(F.col("_answer")) if every else same, "left_anti")
        rows.write.mode("overwrite").parquet(f"{path}/run={run}/batch={number}")

    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        fresh = answers.where("image_path IS NOT NULL").withColumn("answer", F.sha2("raw", 256))
        fresh = fresh.dropDuplicates(["image_path", "answer"] if every else ["image_path"])
        stream = fresh.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        stream.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return stream


def ingested(spark: SparkSession, path: str) -> DataFrame:
    """All labels, with the stream and the number of the batch that wrote them."""
    return spark.read.schema(f"{LABELS}, run string, batch long").parquet(path)


CORRECTION = [*EDITED, "panorama_status_ui"]
BUCKETS, MOST_CHANGES = 64, 8


def _newest(rows: DataFrame) -> DataFrame:
    """The row with the highest seq of each parcel (of equal ones the greatest), bucket and all. Merging merged rows again, or
    some rows twice, changes nothing."""
    last = F.max(F.struct("seq", *CORRECTION)).alias("c")
    return rows.groupBy("bucket", "parcel_key").agg(last).select("bucket", "parcel_key", *[F.col(f"c.{c}").alias(c) for c in CORRECTION], "c.seq")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("parcel_key"), F.lit(buckets)).cast("int")


def upsert_corrections(corrections: DataFrame, folder: str, checkpoint: str, buckets: int = BUCKETS, most: int = MOST_CHANGES) -> list[str]:
    """A stream of corrections into the newest one (by seq) of each parcel, however late or out of order they come. Returns the
    folders of merged buckets that were written.

    A batch writes its own rows only, as change files of the buckets of its keys, under the stream's name and its number: one
    that is tried again replaces its own files, and a new checkpoint on an old folder adds to it. Buckets with more than `most`
    change files are merged into one file each; no other bucket is read or written. What was merged is deleted last: since
    rows may be merged twice without harm, a run that ends anywhere between leaves a folder that reads the same."""
    spark, wrote = corrections.sparkSession, []
    schema = StructType([f for f in corrections.select("parcel_key", *CORRECTION, "seq").schema.fields])
    known: dict[str, str] = {}

    def apply(batch: DataFrame, number: int) -> None:
        run = known.setdefault("run", _run_of(spark, checkpoint))
        rows = batch.where("parcel_key IS NOT NULL").select(*schema.names).withColumn("bucket", _bucket(buckets))
        _newest(rows).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/changes/run={run}/batch={number}")
        wrote.extend(merged(spark, folder, schema, most))

    corrections.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return wrote


def _by_bucket(paths: list[str]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for p in paths:
        out.setdefault(p.rpartition("bucket=")[2], []).append(p)
    return out


def merged(spark: SparkSession, folder: str, schema: StructType, most: int = MOST_CHANGES) -> list[str]:
    """Merges the buckets that have more than `most` change files. Returns the new folders."""
    changes = _by_bucket(folders(spark, f"{folder}/changes/run=*/batch=*/bucket=*"))
    full = {b: paths for b, paths in changes.items() if len(paths) > most}
    if not full:
        return []
    older = _by_bucket(folders(spark, f"{folder}/merged/version=*/bucket=*"))
    old = [p for b, paths in full.items() for p in [*paths, *older.get(b, [])]]
    bucket = F.regexp_extract(F.col("_metadata.file_path"), r"/bucket=(\d+)/[^/]*$", 1).cast("int")
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*old).withColumn("bucket", bucket)
    version = f"{folder}/merged/version={uuid.uuid4().hex}"
    _newest(rows).repartition("bucket").write.partitionBy("bucket").parquet(version)
    removed(spark, old)
    return folders(spark, f"{version}/bucket=*")


def newest(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The newest correction of each parcel, from merged and change files. A read that meets a merge may find files gone; it can
    be tried again."""
    parts = folders(spark, f"{folder}/merged/version=*/bucket=*") + folders(spark, f"{folder}/changes/run=*/batch=*/bucket=*")
    if not parts:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*parts).withColumn("bucket", F.lit(0))
    return _newest(rows).drop("bucket")


def latest(parcels: DataFrame, folder: str, seq: str = "long") -> DataFrame:
    """parcels with the newest corrections."""
    schema = StructType.fromDDL(", ".join(f"{c} string" for c in ["parcel_key", *CORRECTION]) + f", seq {seq}")
    return upserted(parcels, newest(parcels.sparkSession, folder, schema))
