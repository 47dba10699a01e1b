"""What the operators of this subpackage share: tables, shared folders, saved intermediates."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='landmosaic-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def saved(df: DataFrame, kind: str = "table") -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, and outlives any executor."""
    path = new_path(df.sparkSession, kind)
    with setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):  # shuffles of a written table go at once
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes saved() tables with their files. Only for those that no plan reads any more."""
    for df in tables:
        spark = df.sparkSession
        path_of, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsparkSession.sessionState().newHadoopConf()
        folder = path_of(shared_dir(spark)).toUri().getPath()
        for at in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = path_of(at)
            if path.getParent().toUri().getPath() != folder:
                raise ValueError(f"{at} is no saved table")
            path.getFileSystem(conf).delete(path, True)


def settled(spark: SparkSession) -> None:
    """Spark frees broadcasts (each stage and each table read has one on every executor) and shuffles once the driver's garbage
    is collected; a job of hundreds of stages does so from time to time, else executors keep them all until its end."""
    gc.collect()
    spark._jvm.System.gc()


_models: dict[str, object] = {}


def model(name: str, make: Callable[[], object]):
    """What make() gives, kept by the process for its next tasks; it keeps one such model at a time."""
    if name not in _models:
        _models.clear()
        _models[name] = make()
    return _models[name]


def released(batches: Iterator[pa.RecordBatch], alone: bool = False) -> Iterator[pa.RecordBatch]:
    """The batches; between them, and after the last, what Arrow keeps of earlier ones goes back to the system (a process
    that held long texts once would otherwise keep their room through all later stages), and at the end what the C library
    keeps. alone: the stage has no model, so that of an earlier one goes too."""
    if alone:
        _models.clear()
    for batch in batches:
        yield batch
        pa.default_memory_pool().release_unused()
    batch = None
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """Within it, a setting of the session has the value."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def small_batches(spark: SparkSession, rows: int):
    """Within it, what is written passes to Python in batches of so many rows; for rows that may be long."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)


SALTS = 64


def attach(rows: DataFrame, key: str, spread: str, per_key: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with per_key (one row for each key, in a column of the same name; nulls match).

    A key may hold any share of the rows: per_key goes to (key, salt) first, the salt made from the column spread, and the
    rows meet it there, so that no task gets more than about 1/SALTS of a hot key's rows.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    parts = salted.select(F.col(key).alias("_key"), F.col("_salt").alias("_of")).distinct()
    parts = parts.join(per_key, F.col("_key").eqNullSafe(F.col(key))).drop(key)
    return salted.join(parts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_salt") == F.col("_of")), how).drop("_key", "_of", "_salt")


def salted_totals(rows: DataFrame, key: str, spread: str, aggs: dict[str, tuple[str, str]]) -> DataFrame:
    """rows with each key's totals. aggs: output name -> (min, max, sum or count, column). Spark adds up within tasks first."""
    of = {"min": F.min, "max": F.max, "sum": F.sum, "count": F.count}
    return attach(rows, key, spread, rows.groupBy(key).agg(*[of[f](c).alias(n) for n, (f, c) in aggs.items()]))


SLOTS = 1 << 20


def sieved(docs: DataFrame, column: Column, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """docs parted by whether a value's slot (of SLOTS) is taken by any of the keys: the first part has all keys and few
    others. With more keys than SLOTS nearly all slots are taken, and the second part is nearly empty; what is broadcast
    stays SLOTS numbers (some 20 MB), whatever the keys."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS))
    at = fresh(docs, "_slot")
    taken = F.broadcast(saved(keys.select(slot(F.col(key)).alias(at)).distinct(), "slots"))
    maybe, others = (docs.join(taken, slot(column) == F.col(at), how) for how in ("left_semi", "left_anti"))
    return maybe, others


def without(docs: DataFrame, gone: DataFrame, id_col: str, key: Column, gone_key: str, sieve: bool = True) -> DataFrame:
    """docs without the rows whose id (nulls match) and key stand in gone; all columns as they were. With a sieve only rows
    whose key may be there move. There is no Python in the plan."""
    of, at = fresh(docs, "_of"), fresh(docs, "_at")
    gone = saved(gone.select(F.col(id_col).alias(of), F.col(gone_key).alias(at)), "gone")
    left = lambda rows: rows.join(gone, F.col(id_col).eqNullSafe(F.col(of)) & (key == F.col(at)), "left_anti")
    if not sieve:
        return left(docs)
    maybe, others = sieved(docs, key, gone, at)
    return others.unionByName(left(maybe))


def once(docs: DataFrame, twice: DataFrame, id_col: str, key: Column, twice_key: str, text_col: str) -> DataFrame:
    """docs with one row of each id (nulls match) and key that stand in twice, which must name all that several rows share:
    the row whose other columns come first as JSON, then one whose text isn't null, then that of the first SHA-256 of its text.
    All columns as they were; only rows whose key may be there move."""
    if twice.isEmpty():
        return docs
    row, of, at, rest = (fresh(docs, c) for c in ("_row", "_of", "_at", "_rest"))
    maybe, others = sieved(docs, key, twice, twice_key)
    besides = ["`" + c.replace("`", "``") + "`" for c in docs.columns if c != text_col]
    maybe = maybe.select(F.struct("*").alias(row), F.col(id_col).alias(of), key.alias(at), F.struct(F.to_json(F.struct(*besides)), F.col(text_col).isNull(), F.sha2(text_col, 256)).alias(rest))
    return others.unionByName(maybe.groupBy(of, at).agg(F.min_by(row, rest).alias(row)).select(f"{row}.*"))
