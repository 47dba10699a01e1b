"""Ranks, splits, samples, caps and copies. Rows whose class or key is null are a class, or keys, of their own.

A seeded shuffle is the order of md5(seed|key), so results don't depend on partitions. Ranks within a few classes, one of
which may hold most rows, are exact without one task per class: rows are ranked within (class, first DIGITS hex digits of
the hash), and the counts of the earlier digits are added.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import hash_order
from ..sources.tables import kept


DIGITS = 3  # 4 096 parts of a class


def null_safe(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys whose nulls match; the keys come once."""
    other = other.withColumnsRenamed({k: f"_other_{k}" for k in keys})
    return rows.join(other, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_other_{k}")) for k in keys])).drop(*[f"_other_{k}" for k in keys])


def exact_rank(df: DataFrame, by: list[str], key: str, seed: str, name: str = "rank", first: Column | None = None) -> DataFrame:
    """df with the place (from 1) of each row in its class, by hash, then key; rows where `first` is true come before others,
    and name_n, the class's rows."""
    order = hash_order(seed, F.col(key))
    lead = F.when(first, "0").otherwise("1") if first is not None else F.lit("0")
    rows = df.withColumn("_h", order).withColumn("_b", F.concat(lead, F.substring("_h", 1, DIGITS)))
    counts = rows.groupBy(*by, "_b").agg(F.count("*").alias("_n"))  # at most 2 * 16**DIGITS rows for each class
    w = Window.partitionBy(*by).orderBy("_b") if by else Window.partitionBy(F.lit(1)).orderBy("_b")
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn(f"{name}_n", F.sum("_n").over(whole)).drop("_n")
    here = Window.partitionBy(*by, "_b").orderBy("_h", key)
    return null_safe(rows.withColumn("_r", F.row_number().over(here)), counts, [*by, "_b"]).withColumn(name, F.col("_before") + F.col("_r")).drop("_h", "_b", "_r", "_before")


def stratified_split(objects: DataFrame, class_col: str, key: str, ratio: float = 0.2, seed: str = "42") -> DataFrame:
    """Per class round-half-even(n * ratio) objects are val; a class of several keeps at least one in train."""
    r = exact_rank(objects, [class_col], key, seed)
    n_val = F.least(F.bround(F.col("rank_n") * ratio, 0), F.when(F.col("rank_n") > 1, F.col("rank_n") - 1).otherwise(F.col("rank_n")))
    return r.withColumn("split", F.when(F.col("rank") <= n_val, "val").otherwise("train")).drop("rank", "rank_n")


def plain_split(objects: DataFrame, key: str, ratio: float = 0.2, seed: str = "42") -> DataFrame:
    r = exact_rank(objects, [], key, seed)
    return r.withColumn("split", F.when(F.col("rank") <= F.floor(F.col("rank_n") * ratio), "val").otherwise("train")).drop("rank", "rank_n")


def minimum_split(crops: DataFrame, class_col: str, object_col: str, seq: str | Column, ratio: float = 0.2, least: int = 12, seed: str = "42") -> DataFrame:
    """Objects, in the class of their first crop; max(least, int(n * ratio)) are val, never all; a lone object is val."""
    objects = crops.groupBy(object_col).agg(F.min_by(class_col, seq).alias(class_col))
    r = exact_rank(objects, [class_col], object_col, seed)
    n = F.col("rank_n")
    n_val = F.when(n == 1, 1).otherwise(F.least(F.greatest(F.lit(least), F.floor(n * ratio)), n - 1))
    return r.withColumn("split", F.when(F.col("rank") <= n_val, "val").otherwise("train")).drop("rank", "rank_n")


def row_split(rows: DataFrame, key: str, ratio: float, least: int, seed: str) -> DataFrame:
    r = exact_rank(rows, [], key, seed)
    return r.withColumn("split", F.when(F.col("rank") <= F.greatest(F.lit(least), F.floor(F.col("rank_n") * ratio)), "val").otherwise("train")).drop("rank", "rank_n")


def cap_class(rows: DataFrame, class_col: str, majority: str, most: int, key: str, seed: str) -> DataFrame:
    """Only the named class is cut, to `most` rows."""
    big = exact_rank(rows.where(F.col(class_col) == majority), [class_col], key, seed).where(F.col("rank") <= most).drop("rank", "rank_n")
    return rows.where(~F.col(class_col).eqNullSafe(majority)).unionByName(big)


def copies_to(rows: DataFrame, class_col: str, key: str, target: int, seed: str, exact: bool = False) -> DataFrame:
    """Rows of classes under target are repeated in turn until there are exactly target; with exact, larger ones are cut."""
    r = exact_rank(rows, [class_col], key, seed)
    grow = F.when(F.col("rank_n") < target, F.floor((F.lit(target) - F.col("rank")) / F.col("rank_n")) + 1).otherwise(1)
    if exact:
        r = r.where((F.col("rank_n") <= target) | (F.col("rank") <= target))
    return r.withColumn("copy", F.explode(F.sequence(F.lit(1), grow.cast("int")))).drop("rank", "rank_n")


def copies_by_ratio(rows: DataFrame, class_col: str, most: int = 5) -> DataFrame:
    """Each row is copied max(1, min(most, largest class // own class)) times."""
    counts = rows.groupBy(class_col).agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_k", F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.max("_n").over(Window.partitionBy(F.lit(1))) / F.col("_n")))).cast("int"))
    return null_safe(rows, counts.select(class_col, "_k"), [class_col]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_k")))).drop("_k")


def duplicate_weight(rows: DataFrame, key: str, name: str = "sample_weight") -> DataFrame:
    counts = rows.groupBy(key).agg((F.lit(1.0) / F.count("*")).alias(name))
    return null_safe(rows, counts, [key])


def per_class_sample(rows: DataFrame, class_col: str, key: str, most: int, seed: str) -> DataFrame:
    return exact_rank(rows, [class_col], key, seed).where(F.col("rank") <= most).drop("rank", "rank_n")


def random_rows(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    return rows.orderBy(hash_order(seed, F.col(key)), key).limit(n)


def first_per_class(rows: DataFrame, class_col: str, seq: str, most: int) -> DataFrame:
    """The first `most` rows of each class by seq: cut within (class, hash bucket) first, so that few rows meet in a class's task."""
    w = lambda *by: Window.partitionBy(*by).orderBy(seq)
    cut = rows.withColumn("_b", F.pmod(F.xxhash64(seq), F.lit(256))).withColumn("_r", F.row_number().over(w(class_col, "_b"))).where(F.col("_r") <= most)
    return cut.withColumn("_r", F.row_number().over(w(class_col))).where(F.col("_r") <= most).drop("_b", "_r")


def errors_first_sample(rows: DataFrame, class_col: str, error_col: str, key: str, classes: list[str], n: int = 250, least: int = 40, seed: str = "42") -> DataFrame:
    """Per class max(least, n // 6) rows, errors before others; the rest of n at random; in class order cut to n."""
    quota = max(least, n // 6)
    r = exact_rank(rows, [class_col], key, seed, first=F.col(error_col))
    picked = r.where(F.col("rank") <= quota).drop("rank", "rank_n").withColumn("_top", F.lit(0))
    rest = exact_rank(rows.join(picked.select(key), key, "left_anti"), [], key, f"{seed}-top").drop("rank_n")
    count = picked.agg(F.count("*").alias("_c"))
    rest = rest.crossJoin(F.broadcast(count)).where(F.col("rank") <= n - F.col("_c")).drop("rank", "_c").withColumn("_top", F.lit(1))
    place = F.array_position(F.array(*map(F.lit, classes)), F.col(class_col))
    return picked.unionByName(rest).orderBy("_top", place, hash_order(seed, F.col(key)), key).limit(n).drop("_top")


def merged_sources(base: DataFrame, sources: list[tuple[DataFrame, int]], weight: str = "sample_weight") -> DataFrame:
    """Base rows, then each source's rows k times (not at all for k of 0); given weights stay, others are 1."""
    out = base
    for df, k in sources:
        if k > 0:
            out = out.unionByName(df.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(k)))).drop("_copy"), allowMissingColumns=True)
    return out.withColumn(weight, F.coalesce(F.col(weight), F.lit(1.0)) if weight in out.columns else F.lit(1.0))


def indexed(rows: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """rows with their place (from 0) in the global order. One shuffle: sorted range partitions are written with the number
    that Spark gives their rows as they pass (partition and place in it); what is added is the sizes of partitions before, as
    many numbers as there are partitions."""
    place = F.monotonically_increasing_id()
    placed = kept(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place), "placed")
    part = lambda c: F.shiftright(c, 33)
    sizes = placed.groupBy(part("_place").alias("_p")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_p", F.coalesce(before, F.lit(0)).alias("_before"))
    out = placed.join(F.broadcast(sizes), part(F.col("_place")) == F.col("_p"))  # a row per partition
    return out.withColumn(name, F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))).drop("_place", "_p", "_before")


def first_eligible(rows: DataFrame, eligible: Column, order: str, most: int, name: str = "selected") -> DataFrame:
    """rows with a mark on the first `most` eligible ones, those without a place in the order before others. Of rows with
    equal places any come first, but never more than `most` are marked."""
    rows = kept(rows.withColumn("_uid", F.monotonically_increasing_id()), "rows")
    some = rows.where(eligible).orderBy(F.col(order).asc_nulls_first(), "_uid").limit(most).select("_uid", F.lit(True).alias(name))
    return rows.join(some, "_uid", "left").withColumn(name, F.coalesce(name, F.lit(False))).drop("_uid")
