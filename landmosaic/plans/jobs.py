"""Composed jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, rules, text, vectors
from ..functions.core import is_empty
from ..operators import joins, metrics, places, probe, quality, ranking
from ..sources.tables import kept, spread, statistics


def prepared(objects: DataFrame, files: DataFrame, ratio: float = 0.2, seed: str = "42", fov: float = 90.0) -> DataFrame:
    """A sample for each panorama file (object_id, source_path) of the objects (object_id, class_name, lat, lon,
    panoramas_by_season): season, region of view, split of its object (per class, an error if one leaks), index and path."""
    stem = F.regexp_extract("source_path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    rows = files.join(objects, "object_id").withColumn("season", text.season_from_name(stem))
    place = geo.capture_position(F.col("panoramas_by_season"), F.col("season"), F.col("lat"), F.col("lon"))
    rows = rows.withColumn("place", place).withColumn("region", geo.classification_region(F.col("place.lat"), F.col("place.lon"), F.col("lat"), F.col("lon"), fov))
    split = ranking.stratified_split(objects.select("object_id", "class_name"), "class_name", "object_id", ratio, seed).select("object_id", "split")
    rows = rows.join(split, "object_id").select("object_id", "class_name", "season", "split", "source_path", "region").withColumn("_season", F.coalesce("season", F.lit("")))
    rows = ranking.indexed(kept(rows, "samples"), ["class_name", "object_id", "_season", "source_path"]).drop("_season")
    name = F.concat("object_id", F.lit("_"), F.coalesce("season", F.lit("default")), F.format_string("_%04d.jpg", F.col("idx").cast("long")))
    return joins.without_leak(rows.withColumn("image_path", F.concat_ws("/", "split", "class_name", name)), "object_id")


def prepared_statistics(samples: DataFrame, classes: DataFrame) -> DataFrame:
    """kind, split, key, n of prepared samples: of each split the rows of all classes (zeros too), and the dataset's totals."""
    counts = statistics(samples, classes).where("class_name IS NOT NULL").select(F.lit("class").alias("kind"), "split", F.col("class_name").alias("key"), "n")
    info = metrics.dataset_info(samples)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("n")) for c in info.columns])).alias("i")
    return counts.unionByName(info.select(rows).select(F.lit("info").alias("kind"), F.lit(None).cast("string").alias("split"), "i.key", "i.n"))


def cleaned(samples: DataFrame, std_min: float, near: int, suspect: float) -> DataFrame:
    """samples (seq, object_id, class_name, split, multi_heading, pixels, label_prob, predicted) with drop_reason and is_suspect."""
    measured = {"std": vectors.pixel_std(F.col("pixels")), "sharpness": vectors.sharpness(F.col("pixels"), 8, 8), "ahash": vectors.average_hash(F.col("pixels"))}
    rows = kept(samples.withColumns(measured).drop("pixels"), "measured")  # several passes follow
    return quality.drop_reasons(rows, quality.greedy_losers(rows, near), std_min, suspect)


def relabel_build(crops: DataFrame, labels: DataFrame, ratio: float = 0.2, seed: str = "42") -> DataFrame:
    """Relabelled crops with a new plain split by object."""
    rows = joins.relabelled(crops, labels, rules.CLASS_KEYS).where("reason IS NULL").drop("reason")
    split = ranking.plain_split(rows.select("object_id").distinct(), "object_id", ratio, seed)
    return rows.join(split, "object_id")


def relabel_report(crops: DataFrame, labels: DataFrame, built: DataFrame, classes: DataFrame) -> DataFrame:
    """kind, split, key, n, share: label lines skipped by reason, rows of each split and class (zeros too), and the share of
    built rows whose new label is the source's."""
    skipped = joins.relabelled(crops, labels, rules.CLASS_KEYS).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))
    none = lambda kind: F.lit(None).cast(kind)
    skipped = skipped.select(F.lit("skipped").alias("kind"), none("string").alias("split"), F.col("reason").alias("key"), "n", none("double").alias("share"))
    counts = statistics(built, classes).where("class_name IS NOT NULL").select(F.lit("rows").alias("kind"), "split", F.col("class_name").alias("key"), "n", none("double").alias("share"))
    same = built.agg(F.count("*").alias("n"), F.bround(F.coalesce(F.sum((F.col("osm_label") == F.col("class_name")).cast("double")), F.lit(0.0)) / F.greatest(F.count("*"), F.lit(1)), 6).alias("share"))
    same = same.select(F.lit("agreement").alias("kind"), none("string").alias("split"), none("string").alias("key"), "n", "share")
    return skipped.unionByName(counts).unionByName(same)


def balanced(rows: DataFrame, majority: str, most: int, least: int, seed: str = "42") -> DataFrame:
    """The majority cut, small classes repeated to the least, and weights of 1 / copies of an image."""
    capped = ranking.cap_class(rows, "class_name", majority, most, "crop_id", seed)
    return ranking.duplicate_weight(ranking.copies_to(capped, "class_name", "crop_id", least, seed), "image_path")


def strong_build(crops: DataFrame, labels: DataFrame, target: int, seed: str = "42", *, line: str) -> DataFrame:
    """Relabelled crops with a split that leaves each class enough val objects, train classes brought to the target, and weights.
    An object's class is that of its first path; where that has several labels, of the last line (by `line`, a column of labels)."""
    rows = joins.relabelled(crops, labels.withColumn("_line", F.col(line)), rules.CLASS_KEYS, keep=("_line",)).where("reason IS NULL").drop("reason")
    last = rows.groupBy("object_id", "image_path").agg(F.max_by("class_name", "_line").alias("class_name"))
    split = ranking.minimum_split(last, "class_name", "object_id", "image_path", seed=seed).select("object_id", "split")
    rows = rows.drop("_line").join(split, "object_id")
    train = ranking.copies_to(rows.where("split = 'train'"), "class_name", "image_path", target, seed, exact=True).drop("copy")
    return ranking.duplicate_weight(train.unionByName(rows.where("split = 'val'")), "image_path")


def heuristic_filled(parcels: DataFrame, overwrite: bool = False) -> DataFrame:
    """Empty classes and subclasses from the description; a row with both stays."""
    h = rules.text_class_or_default(F.col("generated_land_use"))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    skip = F.lit(False) if overwrite else ~blank("class_ui") & ~blank("subclass_ui")
    new = lambda c: F.when(~skip & (F.lit(overwrite) | blank(c)), h[c]).otherwise(F.col(c)).alias(c)
    rest = [c for c in parcels.columns if c not in ("class_ui", "subclass_ui")]
    return parcels.select(*rest, new("class_ui"), new("subclass_ui"), (~skip).alias("filled"))


BESIDE, LOOKED_AT = 40.0, 3  # metres, boundary points


def with_panorama_beside(parcels: DataFrame, panoramas: DataFrame, metres: float = BESIDE, most: int = LOOKED_AT) -> DataFrame:
    """parcel_key of the parcels (ring, lat, lon, photos_ui) without a link that have a panorama (lat, lon) within `metres` of
    one of their first boundary points. A semi-join: a point is done with the first panorama that is found."""
    points = F.slice(geo.merged_points(geo.boundary_points(F.col("ring"), F.col("lat"), F.col("lon"))), 1, most)
    rows = parcels.where(~F.coalesce(text.has_link(F.col("photos_ui")), F.lit(False))).select("parcel_key", "ring", "lat", "lon")
    rows = spread(rows, "parcel_key").select("parcel_key", F.explode_outer(points).alias("p")).where("p IS NOT NULL")
    circles = rows.select("parcel_key", F.col("p.lat").alias("c_lat"), F.col("p.lon").alias("c_lon"))
    found = places.with_any_within(circles, panoramas.select(F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon")), metres)
    return found.select("parcel_key").distinct()


def classified(
    parcels: DataFrame, votes: DataFrame, mode: str = "smart", max_rows: int = 500, require_panorama: bool = True, fallback: bool = False, least: float = 0.28,
    beside: DataFrame | None = None, overwrite: bool = False,
) -> DataFrame:
    """parcels with class_ui, subclass_ui, panorama_status_ui and outcome of the first max_rows eligible ones decided: no
    panorama, text rules, the views' vote, or low confidence. A parcel has a panorama if it has a link to one, or if its key
    is in `beside` (as with_panorama_beside gives them). Eligible are those without a class or subclass; with overwrite all."""
    if mode == "heuristic" and not require_panorama:
        return heuristic_filled(parcels, overwrite).withColumn("outcome", F.when("filled", "heuristic")).drop("filled")
    eligible = F.lit(overwrite) | is_empty(F.col("class_ui")) | is_empty(F.col("subclass_ui")) | (F.trim("class_ui") == rules.NO_CATEGORY)
    rows = ranking.first_eligible(parcels, eligible, "oid", max_rows)
    there = text.has_link(F.col("photos_ui"))
    if beside is not None:
        rows = rows.join(beside.select("parcel_key", F.lit(True).alias("_beside")), "parcel_key", "left")
        there = there | F.coalesce("_beside", F.lit(False))
    winner = metrics.voted(votes, least=least).withColumnsRenamed({"class_key": "vote", "confidence": "vote_confidence"})
    rows = rows.join(winner, "parcel_key", "left")
    desc = F.col("generated_land_use")
    h, vote = rules.text_class_or_default(desc), F.col("vote").isNotNull() & F.lit(mode != "heuristic")
    smart_text = F.lit(mode == "smart") & ~rules.is_ambiguous(desc)
    selected = F.col("selected")
    none = ~there & F.lit(require_panorama)
    ml_sub = rules.refined_subclass(F.col("vote"), desc, rules.label_of(F.col("vote"), 1))
    use_text = F.lit(fallback)

    def decide(no: Column, by_text: Column, by_vote: Column, low: Column, old: Column) -> Column:
        weak = low if mode in ("ml", "ml+heuristic", "smart") else old
        last = weak if mode == "ml" else F.when(use_text, by_text).otherwise(weak)
        return F.when(~selected, old).when(none, no).when(smart_text, by_text).when(vote, by_vote).otherwise(last)

    old = F.col
    outcome = decide(F.lit("no_panorama"), F.lit("heuristic"), F.lit("ml"), F.lit("ml_low_confidence"), F.lit(None).cast("string"))
    status = decide(F.lit(rules.NO_PANORAMA), F.lit(rules.PANORAMA), F.lit(rules.PANORAMA), F.lit(rules.LOW_CONFIDENCE), old("panorama_status_ui") if mode != "heuristic" else F.when(selected, rules.PANORAMA).otherwise(old("panorama_status_ui")))
    return rows.select(
        "oid", "parcel_key",
        decide(F.lit(rules.NO_CATEGORY), h["class_ui"], rules.label_of(F.col("vote")), old("class_ui"), old("class_ui")).alias("class_ui"),
        decide(F.lit(""), h["subclass_ui"], ml_sub, old("subclass_ui"), old("subclass_ui")).alias("subclass_ui"),
        status.alias("panorama_status_ui"), outcome.alias("outcome"),
    )


def feedback(parcels: DataFrame, n: int = 250, least: int = 40, seed: str = "42") -> DataFrame:
    """Corrected parcels, errors of the text rules first, stratified, with a row split."""
    rows = parcels.withColumn("class_key", rules.analyst_key(F.col("class_corrected_ui"))).where("class_key IS NOT NULL")
    rows = rows.withColumn("is_error", rules.text_class_or_default(F.col("generated_land_use"))["class_ui"] != rules.label_of(F.col("class_key")))
    picked = ranking.errors_first_sample(kept(rows.select("parcel_key", "class_key", "is_error"), "feedback"), "class_key", "is_error", "parcel_key", rules.CLASS_KEYS, n, least, seed)
    return ranking.row_split(picked, "parcel_key", 0.2, 1, seed)


def hard_cases(parcels: DataFrame, most: int = 60, weight: float = 4.0, seed: str = "7") -> DataFrame:
    """Green courtyards whose correction is one of the two classes they are taken for, with photo places."""
    truth = F.trim("class_corrected_ui")
    rows = parcels.where(rules.is_hard_case(F.col("generated_land_use")) & truth.isin(rules.NATURE, rules.URBAN) & (F.size(text.photo_coords(F.col("photos_ui"))) > 0))
    some = ranking.per_class_sample(rows.select("parcel_key", truth.alias("truth")), "truth", "parcel_key", most, seed)
    return ranking.row_split(some, "parcel_key", 0.15, 2, seed).withColumn("sample_weight", F.lit(weight))


NOTED = 80  # characters of a description in a report


def _sample(parcels: DataFrame, n: int, seed: str) -> DataFrame:
    """At most n parcels, in a seeded order, that analysts have classed and that have a link."""
    rows = parcels.where(rules.is_valid_label(F.col("class_corrected_ui")) & text.has_link(F.col("photos_ui")))
    return kept(ranking.random_rows(rows, "oid", n, seed), "sample")


def analyst_report(parcels: DataFrame, votes: DataFrame, n: int = 50, seed: str = "42", most: int = 20, least: float = 0.28) -> DataFrame:
    """section, key, n, share, detail: how classes compare with the analysts' corrections.

    parcels: all, those with a correction, and those that have no category; heuristic: text rules against corrections, on all
    that have one; hard: green courtyards by their correction, and all of them (null key); sample: the views' vote on at most n
    parcels with links; sample_error: the first of its errors by oid, said and corrected."""
    truth, sub = F.trim("class_corrected_ui"), F.trim("subclass_corrected_ui")
    valid = rules.is_valid_label(F.col("class_corrected_ui"))
    h = rules.text_class_or_default(F.col("generated_land_use"))
    hard = rules.is_hard_case(F.col("generated_land_use")) & (F.size(text.photo_coords(F.col("photos_ui"))) > 0) & truth.isin(rules.NATURE, rules.URBAN)
    rows = kept(parcels.select(valid.alias("valid"), (truth == rules.NO_CATEGORY).alias("none"), (h["class_ui"] == truth).alias("hit"), (h["subclass_ui"] == sub).alias("sub_hit"), F.when(hard, truth).alias("hard")), "judged")
    line = lambda section, key, n, share=None, detail=None: F.struct(F.lit(section).alias("section"), (key if isinstance(key, Column) else F.lit(key).cast("string")).alias("key"), n.cast("long").alias("n"), (share if share is not None else F.lit(None)).cast("double").alias("share"), (detail if detail is not None else F.lit(None)).cast("string").alias("detail"))
    share = lambda of, where: metrics.accuracy(F.when(where, of))
    counts = rows.agg(F.count("*").alias("total"), F.count_if("valid").alias("valid"), F.count_if("none").alias("none"), share(F.col("hit"), F.col("valid")).alias("hit"), share(F.col("sub_hit"), F.col("valid")).alias("sub"))
    lines = F.explode(F.array(line("parcels", "total", F.col("total")), line("parcels", "evaluated", F.col("valid")), line("parcels", "no_category", F.col("none")), line("heuristic", "class", F.col("valid"), F.col("hit")), line("heuristic", "subclass", F.col("valid"), F.col("sub"))))
    out = counts.select(lines.alias("l")).select("l.*")
    courtyards = rows.where("hard IS NOT NULL").rollup("hard").agg(F.count("*").alias("n"), metrics.accuracy(F.col("hit")).alias("hit"))
    out = out.unionByName(courtyards.select(line("hard", F.col("hard"), F.col("n"), F.col("hit")).alias("l")).select("l.*"))

    some = _sample(parcels, n, seed)
    said = classified(some, votes, mode="ml", max_rows=n, least=least, overwrite=True).select("oid", F.col("class_ui").alias("said"), F.col("subclass_ui").alias("said_sub"))
    said = kept(said.join(some.select("oid", truth.alias("truth"), sub.alias("sub"), F.substring("generated_land_use", 1, NOTED).alias("note")), "oid"), "said")
    scored = said.agg(F.count("*").alias("n"), metrics.accuracy(F.col("said") == F.col("truth")).alias("hit"), metrics.accuracy(F.col("said_sub") == F.col("sub")).alias("sub"))
    out = out.unionByName(scored.select(F.explode(F.array(line("sample", "class", F.col("n"), F.col("hit")), line("sample", "subclass", F.col("n"), F.col("sub")))).alias("l")).select("l.*"))
    errors = said.where("said <> truth").orderBy("oid").limit(most)
    detail = F.concat("said", F.lit(" -> "), "truth", F.lit(": "), "note")
    return out.unionByName(errors.select(line("sample_error", F.col("oid").cast("string"), F.lit(1), None, detail).alias("l")).select("l.*"))


def probe_benchmark(parcels: DataFrame, votes: DataFrame, scores: DataFrame, n: int = 40, seed: str = "42", least: float = 0.28) -> DataFrame:
    """run, gpkg_n, gpkg_acc, val_acc, is_best: each run's votes (run, parcel_key, view_index, class_key, confidence) on the same
    sample of corrected parcels with links, beside its score on validation rows (run, val_acc), and which run is to be taken.
    All runs are judged in one pass; a parcel without a vote of enough confidence keeps the class that it has."""
    some = _sample(parcels, n, seed).select("parcel_key", "class_ui", F.trim("class_corrected_ui").alias("truth"))
    asked = votes.join(some.select("parcel_key"), "parcel_key", "left_semi").withColumn("parcel_key", F.struct("run", "parcel_key"))
    winner = metrics.voted(asked, least=least).select("parcel_key.run", "parcel_key.parcel_key", "class_key")
    each = scores.select("run").crossJoin(F.broadcast(some))  # at most n parcels for each run
    each = each.join(winner, ["run", "parcel_key"], "left")
    said = F.when(F.col("class_key").isNotNull(), rules.label_of(F.col("class_key"))).otherwise(F.col("class_ui"))
    hits = each.groupBy("run").agg(F.count("*").alias("gpkg_n"), metrics.accuracy(said == F.col("truth")).alias("gpkg_acc"))
    runs = kept(scores.join(hits, "run", "left").select("run", F.coalesce("gpkg_n", F.lit(0)).alias("gpkg_n"), F.col("gpkg_acc"), "val_acc"), "runs")
    best = metrics.best_run(runs, "parcels").select("run", F.lit(True).alias("is_best"))
    return runs.join(F.broadcast(best), "run", "left").withColumn("is_best", F.coalesce("is_best", F.lit(False)))  # one row


def probe_grid(features: DataFrame, n_classes: int, **how) -> DataFrame:
    """decay, accuracy, macro_f1, balanced_f1 of a linear head for each weight decay; how: as for probe.fitted."""
    return probe.grid(features.sparkSession, probe.fitted(features, n_classes, **how))


def best_probe(grid: DataFrame, select_by: str = "accuracy") -> DataFrame:
    """The row of the grid with the best accuracy, macro_f1 or balanced_f1; the smallest decay on ties."""
    return grid.agg(F.max_by(F.struct(*grid.columns), F.struct(F.col(select_by), -F.col("decay"))).alias("b")).select("b.*")


def season_collection(elements: DataFrame, panoramas: DataFrame, metres: float, most: int, box: tuple[float, float, float, float]) -> DataFrame:
    """Map elements (id, type, tags, c_lat, c_lon, e_lat, e_lon) to the images of a collection: item_id, class_name, season,
    pano_id, capture_date. Classes by tags, within (south, west, north, east), the first `most` of each class, of each season the
    nearest panorama."""
    rows = elements.withColumn("class_name", F.explode(rules.tag_classes(F.col("type"), F.col("tags"))))
    pair = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.struct(F.col(a).alias("lat"), F.col(b).alias("lon")))
    name = F.coalesce(*[F.element_at("tags", F.lit(k)) for k in ("name", "landuse", "leisure")], F.col("class_name"))
    rows = rows.select("id", "type", "class_name", name.alias("name"), F.coalesce(pair("c_lat", "c_lon"), pair("e_lat", "e_lon")).alias("p")).where("p IS NOT NULL").select("id", "type", "class_name", "name", "p.lat", "p.lon")
    rows = rows.where(F.col("lat").between(box[0], box[2]) & F.col("lon").between(box[1], box[3]))
    some = kept(ranking.first_per_class(rows, "class_name", "id", most).withColumn("object_id", F.concat_ws("/", "class_name", F.col("id").cast("string"))), "items")
    picks = joins.season_picks(some, panoramas, metres)
    item = text.safe_item_id(F.col("class_name"), F.col("type"), F.col("id"), F.col("id"), F.col("lat"), F.col("lon"), F.col("name"))
    rows = picks.join(some.select("object_id", "class_name", item.alias("item_id")), "object_id").join(panoramas.select("pano_id", "ts"), "pano_id")
    taken = text.capture_parts(F.timestamp_seconds(F.unix_timestamp("ts")))
    return rows.select("item_id", "class_name", "season", "pano_id", taken["capture_date"].alias("capture_date"))


def collection_statistics(collected: DataFrame, images: DataFrame) -> DataFrame:
    """What a collection has of each class: its items, those with an image, the images' bytes and sizes. collected: as
    season_collection gives it; images: pano_id, width, height, size_bytes of those that were loaded."""
    rows = collected.join(images.select("pano_id", "width", "height", "size_bytes"), "pano_id", "left")
    per = metrics.image_statistics(rows.withColumn("has_panorama", F.lit(True)))
    items = collected.groupBy("class_name").agg(F.count_distinct("item_id").alias("items"))
    return items.join(per.withColumnRenamed("items", "panoramas").drop("with_panorama"), "class_name")
