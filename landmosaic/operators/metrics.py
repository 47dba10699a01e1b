"""Counts, audits and scores. Confusions are counted first; what follows works on as many rows as class pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zero_filled_counts(rows: DataFrame, keys: DataFrame, by: list[str], name: str = "n") -> DataFrame:
    """Counts for all combinations in keys, zero for absent ones."""
    return keys.join(rows.groupBy(*by).agg(F.count("*").alias(name)), by, "left").fillna({name: 0})


def totals(rows: DataFrame, class_col: str = "class_name", object_col: str = "object_id") -> DataFrame:
    """class, n, objects: rows and different objects of each class, and of all (null)."""
    return rows.rollup(class_col).agg(F.count("*").alias("n"), F.count_distinct(object_col).alias("objects"))


def dataset_info(samples: DataFrame, object_col: str = "object_id") -> DataFrame:
    """One row: samples, and those of each split; objects of each, and of both, which a valid dataset has none of."""
    o = samples.groupBy(object_col).agg(F.count_if(F.col("split") == "train").alias("t"), F.count_if(F.col("split") == "val").alias("v"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return o.agg(
        zero(F.col("t") + F.col("v")).alias("samples"), zero("t").alias("train"), zero("v").alias("val"), F.count_if(F.col("t") > 0).alias("train_objects"), F.count_if(F.col("v") > 0).alias("val_objects"),
        F.count_if((F.col("t") > 0) & (F.col("v") > 0)).alias("overlap"),
    )


def class_weights(rows: DataFrame, class_col: str, n_classes: int, weight: str | None = None) -> DataFrame:
    """n / (C * max(n_c, 1)); with sample weights, n_c is their sum."""
    per = rows.groupBy(class_col).agg((F.sum(weight) if weight else F.count("*")).cast("double").alias("_n"))
    return per.withColumn("weight", F.sum("_n").over(Window.partitionBy(F.lit(1))) / (n_classes * F.greatest(F.col("_n"), F.lit(1.0)))).drop("_n")


def accuracy(equal: Column) -> Column:
    """Share of true values with four digits, 0 on no rows."""
    return F.bround(F.coalesce(F.avg(equal.cast("double")), F.lit(0.0)), 4)


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def confusion_matrix(rows: DataFrame, truth: str, predicted: str, ids: list) -> DataFrame:
    return rows.groupBy(F.col(truth).alias("truth")).pivot(predicted, ids).count().na.fill(0)


def class_scores(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """class_id, precision, recall, f1, support of all classes from confusion counts; 0 for empty denominators."""
    n = F.col("n")
    flat = pairs.select(F.explode(F.array(F.struct(F.col("truth").alias("class_id"), F.when(F.col("truth") == F.col("predicted"), n).otherwise(0).alias("tp"), F.lit(0).alias("fp"), n.alias("support")), F.struct(F.col("predicted").alias("class_id"), F.lit(0).alias("tp"), F.when(F.col("truth") != F.col("predicted"), n).otherwise(0).alias("fp"), F.lit(0).alias("support")))).alias("c")).select("c.*")
    s = classes.join(flat.groupBy("class_id").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("support").alias("support")), "class_id", "left").fillna(0, ["tp", "fp", "support"])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("support"))
    return s.select("class_id", p.alias("precision"), r.alias("recall"), ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("support")).alias("f1"), "support")


def macro(scores: DataFrame) -> DataFrame:
    """Mean over all classes, also those without rows."""
    return scores.agg(F.bround(F.avg("f1"), 6).alias("macro_f1"), F.bround(F.avg("recall"), 6).alias("macro_recall"))


def voted(votes: DataFrame, max_views: int = 5, least: float = 0.28) -> DataFrame:
    """parcel_key, class_key, confidence: over a parcel's first views the class with the largest sum of squared confidences
    (seen first on ties), with its mean confidence; both null under the least."""
    view = F.row_number().over(Window.partitionBy("parcel_key").orderBy("view_index"))
    some = votes.withColumn("_v", view).where(F.col("_v") <= max_views)
    per = some.groupBy("parcel_key", "class_key").agg(F.sum(F.col("confidence") * F.col("confidence")).alias("score"), F.avg("confidence").alias("mean"), F.min("view_index").alias("seen"))
    best = per.groupBy("parcel_key").agg(F.max_by(F.struct("class_key", "mean"), F.struct(F.bround("score", 9), -F.col("seen"))).alias("b"))
    good = F.col("b.mean") >= least
    return best.select("parcel_key", F.when(good, F.col("b.class_key")).alias("class_key"), F.when(good, F.col("b.mean")).alias("confidence"))


def weight_sweep(rows: DataFrame, a: str, b: str, truth: str, steps: int = 20) -> DataFrame:
    """weight, accuracy of each blend of two logit vectors."""
    from ..functions.vectors import argmax, blended

    swept = rows.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    hit = argmax(blended(F.col(a), F.col(b), F.col("step") / steps)) == F.col(truth)
    return swept.groupBy("step").agg(F.avg(hit.cast("double")).alias("accuracy"))


def best_step(sweep: DataFrame) -> DataFrame:
    return sweep.agg(F.max_by(F.struct("step", "accuracy"), F.struct("accuracy", -F.col("step"))).alias("b")).select("b.*")


def run_statistics(rows: DataFrame, outcome: str = "outcome") -> DataFrame:
    """outcome, n: rows of each outcome, zero for absent ones; skipped are those of low confidence."""
    known = ["heuristic", "ml", "ml_low_confidence", "no_panorama", "skipped"]
    seen = rows.where(F.col(outcome).isNotNull()).select(F.explode(F.when(F.col(outcome) == "ml_low_confidence", F.array(F.col(outcome), F.lit("skipped"))).otherwise(F.array(outcome))).alias("outcome"))
    counts = seen.groupBy("outcome").agg(F.count("*").alias("n"))
    names = rows.sparkSession.createDataFrame([(k,) for k in known], "outcome string")
    return names.join(counts, "outcome", "left").select("outcome", F.coalesce("n", F.lit(0)).alias("n"))


def best_run(runs: DataFrame, policy: str, n_classes: int | None = None) -> DataFrame:
    """The best row of runs (run, and the metrics that the policy names), the first run on ties.

    metrics: by macro_f1, then accuracy; parcels: by gpkg_acc (none counts as 0), then val_acc; checkpoint: of those with
    n_classes, by val_macro_f1 (else val_balanced_f1, else 0) for six classes and by val_acc for three."""
    zero = lambda *c: F.coalesce(*c, F.lit(0.0))
    if policy == "checkpoint":
        runs = runs.where(F.col("n_classes") == n_classes)
        score = [zero("val_macro_f1", "val_balanced_f1") if n_classes == 6 else zero("val_acc")]
    else:
        score = {"metrics": [F.col("macro_f1"), F.col("accuracy")], "parcels": [zero("gpkg_acc"), F.col("val_acc")]}[policy]
    last = [F.coalesce((-s).cast("double"), F.lit(float("inf"))) for s in score]
    return runs.agg(F.min_by(F.struct(*runs.columns), F.struct(*last, "run")).alias("b")).where("b IS NOT NULL").select("b.*")


def on_target(accuracy: Column, macro_f1: Column, balanced_f1: Column, least: tuple[float, float, float] = (0.75, 0.60, 0.70)) -> Column:
    return (accuracy >= least[0]) & (macro_f1 >= least[1]) & (balanced_f1 >= least[2])


def raw_audit(objects: DataFrame, panoramas: DataFrame, most: int = 20) -> DataFrame:
    """kind, key, n, first: objects per class and in all, panoramas per season, objects without one (and the first of them)."""
    from .ranking import first_per_class

    row = lambda kind, key: [F.lit(kind).alias("kind"), key.alias("key"), F.col("n"), F.lit(None).cast("string").alias("first")]
    classes = objects.rollup("class_name").agg(F.count("*").alias("n"), F.grouping("class_name").alias("_g")).select(F.when(F.col("_g") == 1, "total").otherwise("class").alias("kind"), F.col("class_name").alias("key"), "n", F.lit(None).cast("string").alias("first"))
    seasons = panoramas.groupBy("season").agg(F.count("*").alias("n")).select(*row("season", F.coalesce("season", F.lit("default"))))
    none = objects.join(panoramas.select("object_id").distinct(), "object_id", "left_anti").withColumn("_all", F.lit(1))
    some = first_per_class(none, "_all", "seq", most).agg(F.array_sort(F.collect_list(F.struct("seq", "object_id"))).alias("f"))
    count = none.agg(F.count("*").alias("n")).crossJoin(some)  # one row each
    none = count.select(F.lit("without_panorama").alias("kind"), F.lit(None).cast("string").alias("key"), "n", F.concat_ws(",", F.transform("f", lambda x: x["object_id"])).alias("first"))
    return classes.unionByName(seasons).unionByName(none)


def sample_audit(samples: DataFrame, most: int = 20) -> DataFrame:
    """kind, key, n, first of samples (seq, class_name, object_id, bearing, distance_m, image_path, source_path, source_there,
    crop_there): rows per class, rows with each issue (0 where there are none), and the first of those that are listed. An unknown
    distance is near."""
    from .ranking import first_per_class

    issues = F.array(
        F.when(F.col("bearing").isNull(), F.struct(F.lit("null_bearing").alias("key"), F.col("object_id").alias("what"))), F.when(F.coalesce("distance_m", F.lit(0.0)) < 5, F.struct(F.lit("close_target_m").alias("key"), F.lit(None).cast("string").alias("what"))),
        F.when(~F.col("source_there"), F.struct(F.lit("missing_source").alias("key"), F.col("source_path").alias("what"))), F.when(~F.col("crop_there"), F.struct(F.lit("missing_crop").alias("key"), F.col("image_path").alias("what"))),
    )
    rows = samples.select("seq", F.explode(F.array_compact(issues)).alias("i")).select("seq", "i.*")
    first = first_per_class(rows.where("what IS NOT NULL"), "key", "seq", most).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", "what"))).alias("f"))
    names = samples.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, ["null_bearing", "close_target_m", "missing_source", "missing_crop"]))).alias("key"))
    counts = names.join(rows.groupBy("key").agg(F.count("*").alias("n")), "key", "left").join(first, "key", "left")
    counts = counts.select(F.lit("issue").alias("kind"), "key", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("f").isNotNull(), F.concat_ws(",", F.transform("f", lambda x: x["what"]))).alias("first"))
    return counts.unionByName(samples.groupBy(F.col("class_name").alias("key")).agg(F.count("*").alias("n")).select(F.lit("class").alias("kind"), "key", "n", F.lit(None).cast("string").alias("first")))


def panorama_counts(objects: DataFrame, class_col: str = "class_name") -> DataFrame:
    """Panoramas of each class: entries of panoramas_by_season, else panoramas.total, else 1 if panorama.has_panorama, else the
    files that were found (n_files)."""
    n = F.coalesce(F.when(F.col("panoramas_by_season").isNotNull(), F.size("panoramas_by_season")), F.col("panoramas_total"), F.when(F.col("has_panorama"), 1), F.col("n_files"), F.lit(0))
    return objects.groupBy(class_col).agg(F.sum(n.cast("long")).alias("panoramas"))


def image_statistics(items: DataFrame, class_col: str = "class_name") -> DataFrame:
    """Per class: items, those with a panorama, images, their bytes in all and on average, and how many have each size (WxH:n)."""
    sized = items.where("width > 0 AND height > 0").groupBy(class_col, F.concat("width", F.lit("x"), "height").alias("size")).agg(F.count("*").alias("_n"))
    sized = sized.groupBy(class_col).agg(F.array_join(F.array_sort(F.collect_list(F.concat("size", F.lit(":"), "_n"))), ",").alias("resolutions"))
    image = F.col("size_bytes").isNotNull()
    rows = items.groupBy(class_col).agg(
        F.count("*").alias("items"), F.count_if(F.col("has_panorama")).alias("with_panorama"), F.count_if(image).alias("images"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"), F.bround(F.coalesce(F.avg("size_bytes"), F.lit(0.0)), 4).alias("avg_bytes")
    )
    return rows.join(sized, class_col, "left").withColumn("resolutions", F.coalesce("resolutions", F.lit("")))


def text_ambiguity(rows: DataFrame, text: Column, label: Column) -> DataFrame:
    """text, n, classes, counts (label:n, sorted): texts with more than one label."""
    pairs = rows.groupBy(text.alias("text"), label.alias("label")).agg(F.count("*").alias("_n"))
    out = pairs.groupBy("text").agg(F.sum("_n").alias("n"), F.count("label").alias("classes"), F.array_join(F.array_sort(F.collect_list(F.concat("label", F.lit(":"), "_n"))), "; ").alias("counts"))
    return out.where("classes > 1")


def tile_report(expected: DataFrame, loaded: DataFrame, bad_share: float = 0.3) -> DataFrame:
    """Per image: expected, loaded, black and failed tiles, and whether too many failed."""
    t = expected.join(loaded, ["image_id", "x", "y"], "left")
    c = t.groupBy("image_id").agg(F.count("*").alias("expected"), F.count_if(F.col("status").isNotNull()).alias("loaded"), F.count_if(F.col("status") == "black").alias("black"))
    failed = F.col("expected") - F.col("loaded")
    return c.withColumn("failed", failed).withColumn("failed_share", F.bround(failed / F.col("expected"), 6)).withColumn("flagged", failed / F.col("expected") > bad_share)


def deficit_plan(counts: DataFrame, class_col: str, n: str, target: int | None = None, classes: int = 6, initial: int = 500) -> DataFrame:
    """Per class: target (given, or total // classes), what it needs, the next limit, its share and status."""
    w = Window.partitionBy(F.lit(1))
    total = F.sum(n).over(w)
    goal = F.lit(target).cast("long") if target is not None else F.floor(total / classes)
    out = counts.withColumn("target", goal).withColumn("need", F.greatest(F.col("target") - F.col(n), F.lit(0))).withColumn("share_pct", F.bround(100.0 * F.col(n) / total, 4))
    return out.withColumn("next_limit", F.when(F.col("need") > 0, initial + F.greatest(F.lit(500), 3 * F.col("need"))).otherwise(initial)).withColumn("status", F.when(F.col("need") > 0, "deficit").otherwise("ok"))
