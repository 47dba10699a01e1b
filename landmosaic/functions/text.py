"""Links, names, answers and boxes in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINK = r"(?i)[?&]ll=(-?\d+(?:\.\d+)?)(?:%2C|,)(-?\d+(?:\.\d+)?)"
SEASONS = {"winter": [12, 1, 2], "spring": [3, 4, 5], "summer": [6, 7, 8]}


def photo_coords(photos: Column, digits: int = 6) -> Column:
    """array<struct<lon, lat>> of the links in a cell, each place once, in the order of first sight."""
    text = F.coalesce(photos, F.lit(""))
    pair = F.arrays_zip(F.regexp_extract_all(text, F.lit(LINK), F.lit(1)).alias("lon"), F.regexp_extract_all(text, F.lit(LINK), F.lit(2)).alias("lat"))
    return F.array_distinct(F.transform(pair, lambda p: F.struct(F.bround(p["lon"].cast("double"), digits).alias("lon"), F.bround(p["lat"].cast("double"), digits).alias("lat"))))


def has_link(photos: Column) -> Column:
    return F.lower(F.coalesce(photos, F.lit(""))).contains("ll=")


def gallery_of(photos: Column) -> Column:
    """The first gallery path of a photos cell."""
    return F.get(F.filter(F.split(F.trim(F.coalesce(photos, F.lit(""))), r"\s+"), lambda x: x.startswith("/snapshots/")), F.lit(0))


def urls_of(photos: Column) -> Column:
    return F.filter(F.split(F.coalesce(photos, F.lit("")), r"[\s,;|]+"), lambda x: x.rlike("(?i)^https?://"))


def is_image_url(url: Column) -> Column:
    return url.rlike(r"(?i)\.(jpe?g|png|gif|webp|bmp|svg)(\?|#|$)")


def is_raster_url(url: Column) -> Column:
    return is_image_url(url) | url.rlike(r"(?i)maps\.googleapis\.com/maps/api/streetview\?")


def widget_url(lon: Column, lat: Column) -> Column:
    return F.concat(F.lit("https://yandex.ru/map-widget/v1/?ll="), lon.cast("string"), F.lit("%2C"), lat.cast("string"), F.lit("&z=18&l=stv&lang=ru_RU"))


def gallery_url(dataset: Column, key: Column) -> Column:
    return F.concat(F.lit("/snapshots/"), dataset, F.lit("/"), key, F.lit("/"))


def map_url(lon: Column, lat: Column, direction: Column) -> Column:
    """The map at a place; with the direction of view, in whole degrees, if it is known."""
    place = F.concat(lon.cast("string"), F.lit("%2C"), lat.cast("string"))
    look = F.when(direction.isNotNull(), F.concat(F.lit("&panorama%5Bdirection%5D="), F.bround(direction, 0).cast("int").cast("string"))).otherwise("")
    return F.concat(F.lit("https://yandex.ru/maps/?ll="), place, F.lit("&z=19&l=stv&pt="), place, F.lit(",pm2rdm"), look)


def photos_cell(dataset: Column, key: Column, points: Column) -> Column:
    """The gallery, then a link for every view point, joined by blanks."""
    return F.concat_ws(" ", F.concat(F.array(gallery_url(dataset, key)), F.transform(points, lambda p: widget_url(p["lon"], p["lat"]))))


def split_photos(photos: Column) -> Column:
    """struct(gallery, rest): the first gallery path of a cell, and all other parts joined by blanks."""
    parts = F.filter(F.split(F.coalesce(photos, F.lit("")), r"\s+"), lambda x: x != "")
    at = F.array_position(F.transform(parts, lambda x: x.startswith("/snapshots/")), F.lit(True)).cast("int")
    return F.struct(F.get(parts, at - 1).alias("gallery"), F.array_join(F.filter(parts, lambda x, i: i + 1 != at), " ").alias("rest"))


def heading_fan_out(bearing: Column, offset: float = 0.0, unknown: Column | None = None, default: float = 0.0) -> Column:
    """array<struct<heading, tag>>: one view where the bearing is known; else the given headings (array of doubles), tagged, or
    the default one."""
    turned = lambda h: F.pmod(h + offset, F.lit(360.0))
    one = lambda h: F.array(F.struct(h.alias("heading"), F.lit("").alias("tag")))
    fan = F.transform(unknown, lambda h: F.struct(turned(h).alias("heading"), F.format_string("h%03d", h.cast("int")).alias("tag"))) if unknown is not None else None
    blind = one(F.lit(default % 360.0))
    return F.when(bearing.isNotNull(), one(turned(bearing))).otherwise(F.when(F.size(fan) > 0, fan).otherwise(blind) if fan is not None else blind)


def crop_path(split: Column, class_name: Column, path: Column, tag: Column) -> Column:
    """split/class/stem[_tag].suffix of a crop cut from an image."""
    stem, suffix = F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1), F.regexp_extract(path, r"(\.[^./]*)$", 1)
    return F.concat_ws("/", split, class_name, F.concat(stem, F.when(tag != "", F.concat(F.lit("_"), tag)).otherwise(""), F.when(suffix == "", ".jpg").otherwise(suffix)))


def crop_record(split: Column, class_name: Column, source: Column, view: Column, region_fov: Column, fov: float | None = None, pitch: float = 0.0, offset: float = 0.0, width: int = 896, height: int = 672) -> Column:
    """struct(image_path, perspective) of a view (heading, tag; as heading_fan_out gives them) of an image. The field of view is
    the given one, else the region's, else 90 degrees; a tagged view is one of several."""
    wide = F.coalesce(F.lit(fov).cast("double"), region_fov.cast("double"), F.lit(90.0))
    perspective = F.struct(
        F.bround(view["heading"], 4).alias("heading_deg"), F.lit(float(offset)).alias("heading_offset_deg"), F.lit(float(pitch)).alias("pitch_deg"), wide.alias("fov_deg"),
        F.lit(width).alias("out_width"), F.lit(height).alias("out_height"), source.alias("source_equirect"), (view["tag"] != "").alias("multi_heading"),
    )
    return F.struct(crop_path(split, class_name, source, view["tag"]).alias("image_path"), perspective.alias("perspective"))


def view_name(prefix: str, heading: Column, pitch: Column, fov: float, width: int, height: int) -> Column:
    whole = lambda c: F.bround(c, 0).cast("int").cast("string")
    return F.concat(F.lit(f"{prefix}_h"), whole(heading), F.lit("_p"), whole(pitch), F.lit(f"_f{round(fov)}_{width}x{height}.jpg"))


def season_of(month: Column) -> Column:
    out = F.lit("autumn")
    for name, months in SEASONS.items():
        out = F.when(month.isin(months), name).otherwise(out)
    return out


def capture_parts(taken: Column) -> Column:
    """struct(capture_date, capture_year, capture_month, capture_day, capture_season) of the time of capture; null without one."""
    parts = {"year": F.year(taken), "month": F.month(taken), "day": F.dayofmonth(taken)}
    named = [c.alias(f"capture_{k}") for k, c in parts.items()]
    return F.when(taken.isNotNull(), F.struct(F.date_format(taken, "yyyy-MM-dd").alias("capture_date"), *named, season_of(F.month(taken)).alias("capture_season")))


def season_from_name(stem: Column) -> Column:
    """null for the default panorama, else the season that the file name carries."""
    return F.when(stem == "panorama", None).when(stem.startswith("panorama_"), F.regexp_replace(stem, "^panorama_", "")).otherwise(stem)


def is_multi_heading(path: Column) -> Column:
    return path.rlike(r"_h(\d{3})\.jpg$")


def safe_item_id(class_name: Column, kind: Column, number: Column, row: Column, lat: Column, lon: Column, name: Column) -> Column:
    safe = F.substring(F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"[^\p{L}\p{N} _-]", "")), 1, 40)
    safe = F.when(safe == "", F.lit("unnamed")).otherwise(safe)
    ident = F.coalesce(F.concat(kind, number.cast("string")), F.lpad(row.cast("string"), 4, "0"))
    whole = F.concat_ws("_", class_name, ident, F.format_string("%.6f", lat), F.format_string("%.6f", lon), safe)
    return F.regexp_replace(F.regexp_replace(whole, r"[^\p{L}\p{N} _.-]", ""), " ", "_")


def location_boxes(text: Column) -> Column:
    """array<array<double>> (x0, y0, x1, y1) of groups of four location tokens (y0, x0, y1, x1), as shares with 4 digits."""
    v = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"<loc(\d{4})>"), F.lit(1)), lambda x: F.bround(x.cast("double") / 1023, 4))
    starts = F.sequence(F.lit(1), F.floor(F.size(v) / 4) * 4, F.lit(4))
    return F.when(F.size(v) < 4, F.array().cast("array<array<double>>")).otherwise(F.transform(starts, lambda i: F.array(*[F.element_at(v, (i + k).cast("int")) for k in (1, 0, 3, 2)])))


def location_tokens(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    q = lambda c: F.format_string("<loc%04d>", F.greatest(F.lit(0), F.least(F.lit(1023), F.bround(c * 1023, 0).cast("int"))))
    return F.concat(q(y0), q(x0), q(y1), q(x1))


def box_iou(a: Column, b: Column) -> Column:
    at = lambda c, i: F.element_at(c, i)
    wide = F.greatest(F.lit(0.0), F.least(at(a, 3), at(b, 3)) - F.greatest(at(a, 1), at(b, 1)))
    high = F.greatest(F.lit(0.0), F.least(at(a, 4), at(b, 4)) - F.greatest(at(a, 2), at(b, 2)))
    area = lambda c: F.greatest(F.lit(0.0), at(c, 3) - at(c, 1)) * F.greatest(F.lit(0.0), at(c, 4) - at(c, 2))
    union = area(a) + area(b) - wide * high
    return F.when(union > 0, wide * high / union).otherwise(F.lit(0.0))
