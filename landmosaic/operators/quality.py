"""Cleaning of crops: quality flags, near-duplicates, best headings, reasons to drop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .duplicates import greedy_losers, near_pairs  # noqa: F401  (part of cleaning)
from .ranking import first_per_class
from .selection import exact_percentile

NEAR, STD_MIN, SHARP_SHARE, SUSPECT = 4, 10.0, 0.03, 0.10


def best_headings(crops: DataFrame) -> DataFrame:
    """seq of the one multi-heading crop to keep per object: neither duplicate nor bad, else not duplicate, else any; the
    likeliest label, the first on ties."""
    tier = F.when(~F.col("is_dup") & ~F.col("is_bad"), 0).when(~F.col("is_dup"), 1).otherwise(2)
    return crops.where("multi_heading").groupBy("object_id").agg(F.min_by("seq", F.struct(tier, -F.col("label_prob"), "seq")).alias("seq"))


def sharpness_floor(crops: DataFrame, share: float = SHARP_SHARE) -> DataFrame:
    """One row: the sharpness that a share of all rows is under, exactly."""
    return crops.sparkSession.createDataFrame([(exact_percentile(crops, "sharpness", share),)], "floor double")


def drop_reasons(crops: DataFrame, losers: DataFrame, std_min: float = STD_MIN, suspect: float = SUSPECT, share: float = SHARP_SHARE) -> DataFrame:
    """crops (seq, object_id, split, std, sharpness, multi_heading, label_prob, predicted, class_name) with drop_reason, by
    priority duplicate, quality, heading_pruned, val_multiheading_excluded, and is_suspect."""
    rows = crops.crossJoin(F.broadcast(sharpness_floor(crops, share)))
    rows = rows.join(losers.select("seq", F.lit(True).alias("is_dup")), "seq", "left").fillna(False, ["is_dup"])
    empty, blurry = F.col("std") < std_min, F.col("sharpness") < F.col("floor")
    quality = F.concat_ws("+", F.when(empty, "empty"), F.when(blurry, "blurry"))
    rows = rows.withColumn("_quality", quality).withColumn("is_bad", quality != "").withColumn("is_suspect", (F.col("predicted") != F.col("class_name")) & (F.col("label_prob") < suspect))
    kept = best_headings(rows).select("seq", F.lit(True).alias("is_best"))
    rows = rows.join(kept, "seq", "left").fillna(False, ["is_best"])
    reason = F.when(F.col("is_dup"), "duplicate").when(F.col("is_bad"), F.col("_quality")).when(F.col("multi_heading") & ~F.col("is_best"), "heading_pruned").when(F.col("multi_heading") & (F.col("split") == "val"), "val_multiheading_excluded")
    return rows.withColumn("drop_reason", reason).drop("_quality", "floor", "is_best", "is_bad", "is_dup")


def drop_report(cleaned: DataFrame, most: int = 40) -> DataFrame:
    """reason, n, suspects, first of cleaned rows (seq, drop_reason, is_suspect): rows of each reason and of those kept, and
    the first of each reason, by seq: found within parts of a reason first, so that none comes to one task."""
    counts = cleaned.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"), F.count_if("is_suspect").alias("suspects"))
    some = first_per_class(cleaned.where("drop_reason IS NOT NULL").select("drop_reason", "seq"), "drop_reason", "seq", most)
    first = some.groupBy(F.col("drop_reason").alias("reason")).agg(F.concat_ws(",", F.array_sort(F.collect_list(F.lpad("seq", 9, "0")))).alias("first"))
    return counts.join(first, "reason", "left")
