"""Joins: relabelling, corrections, missing rows, nearby panoramas, tiles, providers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import distance
from . import places


def relabelled(crops: DataFrame, labels: DataFrame, classes: list[str], only_confident: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every label line with the reason it is skipped for (bad_label, unsure, no_crop_record, in this order) or null; the new
    label in class_name, the old one in osm_label; keep: columns of labels that stay. Of crops with one path the last (by seq) counts."""
    last = crops.groupBy("image_path").agg(F.max_by(F.struct("object_id", F.col("class_name").alias("osm_label"), "split"), "seq").alias("c"))
    out = labels.join(last, "image_path", "left")
    known = F.coalesce(F.col("vlm_label").isin(classes), F.lit(False))
    reason = F.when(~known, "bad_label").when(~F.coalesce(F.col("vlm_confident"), F.lit(True)) & F.lit(only_confident), "unsure").when(F.col("c").isNull(), "no_crop_record")
    return out.select("image_path", F.col("vlm_label").alias("class_name"), F.col("c.osm_label").alias("osm_label"), F.col("c.object_id").alias("object_id"), reason.alias("reason"), *keep)


def missing(rows: DataFrame, key: str, there: DataFrame, there_key: str) -> DataFrame:
    """Rows whose key isn't there: missing files, objects without panorama, labels still to do."""
    return rows.join(there.select(F.col(there_key).alias("_there")), F.col(key) == F.col("_there"), "left_anti")


def without_leak(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """rows, or an error if a key stands in more than one split."""
    found = leaks(rows, key, split).limit(5).collect()
    if found:
        raise ValueError(f"in more than one split: {', '.join(str(r[0]) for r in found)}")
    return rows


def leaks(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """The keys that stand in more than one split."""
    return rows.groupBy(key).agg(F.count_distinct(split).alias("_n")).where("_n > 1").select(key)


def linked(parcels: DataFrame, cell: Column, keys: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """parcels with the cell in photos_ui where it is empty: only those whose parcel_key is in keys, and only the first `most`."""
    from .ranking import first_eligible

    empty = F.trim(F.coalesce("photos_ui", F.lit(""))) == ""
    rows = parcels
    if keys is not None:
        rows = rows.join(keys.select("parcel_key", F.lit(True).alias("_asked")).distinct(), "parcel_key", "left")
        empty = empty & F.coalesce("_asked", F.lit(False))
    rows = first_eligible(rows, empty, "oid", most, "_linked") if most is not None else rows.withColumn("_linked", empty)
    return rows.withColumn("photos_ui", F.when(F.col("_linked"), cell).otherwise(F.col("photos_ui"))).drop("_linked", "_asked")


EDITED = ["class_ui", "subclass_ui", "class_corrected_ui", "subclass_corrected_ui", "photos_ui"]


def upserted(parcels: DataFrame, corrections: DataFrame) -> DataFrame:
    """Parcels with the last correction (by seq) of each key: its fields ("" where missing), its status only if it has one."""
    last = corrections.groupBy("parcel_key").agg(F.max_by(F.struct(*EDITED, "panorama_status_ui"), "seq").alias("c"))
    out = parcels.join(last, "parcel_key", "left")
    hit = F.col("c").isNotNull()
    for c in EDITED:
        out = out.withColumn(c, F.when(hit, F.coalesce(F.col(f"c.{c}"), F.lit(""))).otherwise(F.col(c)))
    return out.withColumn("panorama_status_ui", F.coalesce(F.col("c.panorama_status_ui"), F.col("panorama_status_ui"))).drop("c")


def _near_places(objects: DataFrame, panoramas: DataFrame, metres: float, digits: int | None, most: int) -> DataFrame:
    """c_lat, c_lon, p_lat, p_lon, distance_m of the pairs of different places within a radius. An equi-join on cells, which are
    divided where they are full; however many rows share a place, it is met once."""
    pairs = places.pairs_within(objects.select("c_lat", "c_lon").distinct(), panoramas.select("p_lat", "p_lon").distinct(), metres, most)
    d = distance(F.col("c_lat"), F.col("c_lon"), F.col("p_lat"), F.col("p_lon"))
    return pairs.withColumn("distance_m", d if digits is None else F.bround(d, digits))


def nearby(objects: DataFrame, panoramas: DataFrame, metres: float, most: int = places.MOST, digits: int | None = None) -> DataFrame:
    """Pairs within a radius: object_id, pano_id, distance_m (rounded half-even to digits). Distances are worked out between places;
    panoramas take them over, and the objects of a place meet them last, so that pairs are never shuffled."""
    o = objects.select("object_id", F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"))
    p = panoramas.select("pano_id", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    near = p.join(_near_places(o, p, metres, digits, most), ["p_lat", "p_lon"]).select("c_lat", "c_lon", "pano_id", "distance_m")
    return near.join(o.hint("merge"), ["c_lat", "c_lon"]).select("object_id", "pano_id", "distance_m")


def _picked(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    """by, season and pick (distance_m, newest: the later the less, pano_id): each season's least, of the `most` first seasons."""
    best = rows.groupBy(*by, "season").agg(F.min("pick").alias("pick"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("pick.distance_m"), "season"))
    return best.withColumn("_r", place).where(F.col("_r") <= most).drop("_r")


def season_picks(objects: DataFrame, panoramas: DataFrame, metres: float, most: int = 4, digits: int = 6, full: int = places.MOST) -> DataFrame:
    """Per object and season the nearest panorama within a radius (distances rounded to digits), then the newest, then the first
    id; at most four seasons: object_id, season, pano_id, distance_m. Of the panoramas at one place and season only the newest
    can be picked, and objects at one place have the same picks, so neither side's copies are multiplied."""
    o = objects.select("object_id", F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"))
    p = panoramas.select(F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), "season", F.struct((-F.unix_micros(F.col("ts").cast("timestamp"))).alias("newest"), "pano_id").alias("first"))
    p = p.groupBy("p_lat", "p_lon", "season").agg(F.min("first").alias("first"))
    rows = p.join(_near_places(o, p, metres, digits, full), ["p_lat", "p_lon"])
    rows = _picked(rows.select("c_lat", "c_lon", "season", F.struct("distance_m", "first.newest", "first.pano_id").alias("pick")), ["c_lat", "c_lon"], most)
    rows = _picked(o.join(rows, ["c_lat", "c_lon"]).select("object_id", "season", "pick"), ["object_id"], most)  # an id may have several places
    return rows.select("object_id", "season", "pick.pano_id", "pick.distance_m")


def expected_tiles(images: DataFrame, tile: int = 512) -> DataFrame:
    """image_id, x, y of the tiles that cover an image of that width and height."""
    upto = lambda c: F.sequence(F.lit(0), (F.ceil(F.col(c) / tile) - 1).cast("int"))
    return images.where("width > 0 AND height > 0").withColumn("x", F.explode(upto("width"))).withColumn("y", F.explode(upto("height"))).select("image_id", "x", "y")


def first_provider(sources: list[DataFrame], point: str = "point_id", url: str = "url") -> DataFrame:
    """Union of providers in order of priority: empty URLs go, and of a repeated one the first provider's stays."""
    out = None
    for i, s in enumerate(sources):
        rows = s.where(F.coalesce(F.trim(F.col(url)), F.lit("")) != "").select(point, url, F.lit(i).alias("priority"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy(point, url).agg(F.min("priority").alias("priority"))
