"""Registered queries: each applies an operator to a whole logical table; SQL says the same where it can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import core, geo, rules, text, vectors
from ..operators import joins, metrics, quality, ranking
from ..sources import tables
from .bindings import bound, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with SQL over the logical tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = oracle(sql)
        return f

    return add


def dims(spark: SparkSession, values: list, name: str) -> DataFrame:
    return spark.sql("SELECT explode(?) AS v", args=[values]).withColumnRenamed("v", name)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _of(column: str, values: dict, default: str = "''") -> str:
    return f"CASE {column} " + " ".join(f"WHEN {k if isinstance(k, int) else _quoted(k)} THEN {_quoted(v)}" for k, v in values.items()) + f" ELSE {default} END"


# What the rules must give for the sixteen descriptions of the parcels (by oid % 16), worked out by hand.
_EXPECTED = {
    0: ("Природные территории", "Парки и скверы"), 1: ("Природные территории", "Лесные массивы"), 2: ("Активное строительство", "Стройплощадки с активностью"), 4: ("Природные территории", "Парки и скверы"),
    5: ("Природные территории", "Водные объекты"), 6: ("Недоиспользуемые инфраструктурные/городские зоны", "Парковки с низкой загрузкой"), 7: ("Активное строительство", "Стройплощадки с активностью"),
    8: ("Низкоплотная застройка / Деградировавшие объекты", "Заброшенные здания"), 9: ("Природные территории", "Растительность вдоль дорог"), 10: ("Активные городские территории", "Образовательные/медицинские/офисные комплексы"),
    11: ("Активные городские территории", "Коммерческие улицы"), 12: ("Незавершенное/приостановленное строительство", "Замороженные объекты"), 13: ("Активные городские территории", "Жилая застройка с активностью"),
}
TEXT_CLASS_SQL, TEXT_SUB_SQL = (_of("oid % 16", {k: v[i] for k, v in _EXPECTED.items()}) for i in (0, 1))
_DEFAULT_CLASS, _DEFAULT_SUB = "'Активные городские территории'", "'Жилая застройка с активностью'"
_FINER = {
    "natural_areas": {1: "Лесные массивы", 4: "Благоустроенные парки и скверы", 5: "Водные объекты", 9: "Растительность вдоль дорог"},
    "underused_infrastructure": {5: "Промзона"},
    "active_urban": {9: "Интенсивные транспортные коридоры", 10: "Образовательные/медицинские/офисные комплексы", 11: "Коммерческие улицы"},
}
_LABEL = {"natural_areas": "Природные территории", "low_density_degraded": "Низкоплотная застройка / Деградировавшие антропогенные объекты", "underused_infrastructure": "Недоиспользуемые инфраструктурные/городские зоны", "frozen_construction": "Незавершенное/приостановленное строительство", "active_construction": "Активное строительство", "active_urban": "Активные городские территории"}
_SUBLABEL = {"natural_areas": "Парки и скверы", "low_density_degraded": "Заброшенные здания", "underused_infrastructure": "Парковки с низкой загрузкой", "frozen_construction": "Замороженные объекты", "active_construction": "Стройплощадки с активностью", "active_urban": "Жилая застройка с активностью"}
_ANALYST = {"Природные территории": "natural_areas", "Активные городские территории": "active_urban", "Активное строительство (стройплощадки)": "active_construction", "Недоиспользуемые инфраструктурные/городские зоны": "underused_infrastructure", "Незавершенное/приостановленное строительство (стройка)": "frozen_construction"}
_KEYS_SQL = _of("trim(class_corrected_ui)", _ANALYST, "NULL")


def _finer(key: str, default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {_quoted(k)} THEN {_of('oid % 16', v, default)}" for k, v in _FINER.items()) + f" ELSE {default} END"


# ---------------------------------------------------------------- votes


@query("""WITH v AS (SELECT *, row_number() OVER (PARTITION BY parcel_key ORDER BY view_index) AS r FROM votes),
    c AS (SELECT parcel_key, class_key, round_even(sum(confidence * confidence), 9) AS s, avg(confidence) AS m, min(view_index) AS f FROM v WHERE r <= 5 GROUP BY 1, 2),
    b AS (SELECT *, row_number() OVER (PARTITION BY parcel_key ORDER BY s DESC, f) AS k FROM c)
    SELECT parcel_key, CASE WHEN m >= 0.28 THEN class_key END AS class_key, CASE WHEN m >= 0.28 THEN round_even(m, 6) END AS confidence FROM b WHERE k = 1""")
def a17_view_voting(spark, sf):
    return metrics.voted(bound(spark, sf, "votes")).withColumn("confidence", F.bround("confidence", 6))


# ---------------------------------------------------------------- splits and samples

_rank = lambda by, key, seed="42": f"row_number() OVER ({'PARTITION BY ' + by if by else ''} ORDER BY md5(concat('{seed}|', {key})), {key})"


@query(f"""WITH r AS (SELECT object_id, class_name, {_rank('class_name', 'object_id')} AS r, count(*) OVER (PARTITION BY class_name) AS n FROM objects)
    SELECT object_id, class_name, CASE WHEN r <= least(round_even(n * 0.2e0, 0), CASE WHEN n > 1 THEN n - 1 ELSE n END) THEN 'val' ELSE 'train' END AS split FROM r""")
def w1_stratified_split(spark, sf):
    return ranking.stratified_split(bound(spark, sf, "objects").select("object_id", "class_name"), "class_name", "object_id")


@query(f"""WITH r AS (SELECT object_id, {_rank('', 'object_id')} AS r, count(*) OVER () AS n FROM objects)
    SELECT object_id, CASE WHEN r <= floor(n * 0.2e0) THEN 'val' ELSE 'train' END AS split FROM r""")
def w2_plain_split(spark, sf):
    return ranking.plain_split(bound(spark, sf, "objects").select("object_id"), "object_id")


@query(f"""WITH o AS (SELECT object_id, arg_min(class_name, seq) AS class_name FROM crops GROUP BY 1),
    r AS (SELECT *, {_rank('class_name', 'object_id')} AS r, count(*) OVER (PARTITION BY class_name) AS n FROM o)
    SELECT object_id, class_name, CASE WHEN r <= CASE WHEN n = 1 THEN 1 ELSE least(greatest(12, floor(n * 0.2e0)), n - 1) END THEN 'val' ELSE 'train' END AS split FROM r""")
def w3_minimum_split(spark, sf):
    return ranking.minimum_split(bound(spark, sf, "crops"), "class_name", "object_id", "seq")


@query(f"""WITH r AS (SELECT crop_id, {_rank('', 'crop_id', '7')} AS r, count(*) OVER () AS n FROM crops)
    SELECT crop_id, CASE WHEN r <= greatest(2, floor(n * 0.15e0)) THEN 'val' ELSE 'train' END AS split FROM r""")
def w4_row_split(spark, sf):
    return ranking.row_split(bound(spark, sf, "crops").select("crop_id"), "crop_id", 0.15, 2, "7")


@query(f"""WITH r AS (SELECT crop_id, class_name, {_rank('class_name', 'crop_id')} AS r FROM crops)
    SELECT crop_id, class_name FROM r WHERE class_name <> 'active_urban' OR r <= 120""")
def w9_cap_majority(spark, sf):
    return ranking.cap_class(bound(spark, sf, "crops").select("crop_id", "class_name"), "class_name", "active_urban", 120, "crop_id", "42")


@query(f"""WITH r AS (SELECT object_id, class_name, {_rank('class_name', 'object_id')} AS r, count(*) OVER (PARTITION BY class_name) AS n FROM objects)
    SELECT object_id, class_name, unnest(range(1, CAST(CASE WHEN n < 350 THEN (350 - r) // n + 1 ELSE 1 END AS BIGINT) + 1)) AS copy FROM r""")
def w10_oversample_to_minimum(spark, sf):
    return ranking.copies_to(bound(spark, sf, "objects").select("object_id", "class_name"), "class_name", "object_id", 350, "42").withColumn("copy", F.col("copy").cast("long"))


@query(f"""WITH r AS (SELECT object_id, class_name, {_rank('class_name', 'object_id')} AS r, count(*) OVER (PARTITION BY class_name) AS n FROM objects)
    SELECT object_id, class_name, unnest(range(1, CAST(CASE WHEN n < 300 THEN (300 - r) // n + 1 ELSE 1 END AS BIGINT) + 1)) AS copy FROM r WHERE n <= 300 OR r <= 300""")
def w11_resize_to_target(spark, sf):
    return ranking.copies_to(bound(spark, sf, "objects").select("object_id", "class_name"), "class_name", "object_id", 300, "42", exact=True).withColumn("copy", F.col("copy").cast("long"))


@query("""WITH r AS (SELECT pano_id, CASE WHEN pano_id % 30 = 0 THEN 'rare' WHEN pano_id % 10 = 0 THEN 'some' WHEN pano_id % 7 = 0 THEN NULL ELSE season END AS kind FROM panoramas), c AS (SELECT kind, count(*) AS n FROM r GROUP BY 1), k AS (SELECT kind, greatest(1, least(5, max(n) OVER () // n)) AS k FROM c)
    SELECT pano_id, r.kind, unnest(range(1, CAST(k AS BIGINT) + 1)) AS copy FROM r JOIN k ON r.kind IS NOT DISTINCT FROM k.kind""")
def w12_ratio_oversample(spark, sf):
    kind = F.when(F.col("pano_id") % 30 == 0, "rare").when(F.col("pano_id") % 10 == 0, "some").when(F.col("pano_id") % 7 != 0, F.col("season"))
    rows = bound(spark, sf, "panoramas").select("pano_id", kind.alias("kind"))
    return ranking.copies_by_ratio(rows, "kind").select("pano_id", "kind", F.col("copy").cast("long").alias("copy"))


@query("""WITH r AS (SELECT crop_id, CASE WHEN seq % 5 = 0 THEN NULL ELSE class_name END AS class_name FROM crops), n AS (SELECT *, row_number() OVER (PARTITION BY class_name ORDER BY md5(concat('42|', crop_id)), crop_id) AS k, count(*) OVER (PARTITION BY class_name) AS n FROM r)
    SELECT crop_id, class_name, CASE WHEN k <= least(round_even(n * 0.2e0, 0), CASE WHEN n > 1 THEN n - 1 ELSE n END) THEN 'val' ELSE 'train' END AS split FROM n""")
def w1_split_of_unclassed(spark, sf):
    """Rows without a class are a class of their own."""
    rows = bound(spark, sf, "crops").select("crop_id", F.when(F.col("seq") % 5 != 0, F.col("class_name")).alias("class_name"))
    return ranking.stratified_split(rows, "class_name", "crop_id")


@query("""WITH b AS (SELECT crop_id, class_name, CASE WHEN seq % 2 = 0 THEN 0.5e0 END AS w FROM crops), a AS (SELECT crop_id, class_name, CAST(NULL AS DOUBLE) AS w FROM crops WHERE seq % 10 = 0), h AS (SELECT crop_id, class_name, 4e0 AS w FROM crops WHERE seq % 25 = 0)
    SELECT crop_id, class_name, coalesce(w, 1) AS sample_weight FROM b UNION ALL SELECT crop_id, class_name, 1 FROM a, range(2) UNION ALL SELECT crop_id, class_name, w FROM h, range(4)""")
def w13_weighted_merge(spark, sf):
    c = bound(spark, sf, "crops").select("crop_id", "class_name", "seq")
    base = c.select("crop_id", "class_name", F.when(F.col("seq") % 2 == 0, 0.5).alias("sample_weight"))
    return ranking.merged_sources(base, [(c.where("seq % 10 = 0").select("crop_id", "class_name"), 2), (c.where("seq % 25 = 0").select("crop_id", "class_name", F.lit(4.0).alias("sample_weight")), 4)])


@query(f"""WITH c AS (SELECT crop_id, class_name, price > 300000 AS err FROM crops),
    r AS (SELECT *, row_number() OVER (PARTITION BY class_name ORDER BY err DESC, md5(concat('42|', crop_id)), crop_id) AS r FROM c),
    p AS (SELECT * FROM r WHERE r <= 41), q AS (SELECT *, {_rank('', 'crop_id', '42-top')} AS t FROM r WHERE r > 41),
    u AS (SELECT crop_id, class_name, err, 0 AS top FROM p UNION ALL SELECT crop_id, class_name, err, 1 FROM q WHERE t <= 250 - (SELECT count(*) FROM p)),
    o AS (SELECT *, row_number() OVER (ORDER BY top, list_position({rules.CLASS_KEYS}, class_name), md5(concat('42|', crop_id)), crop_id) AS k FROM u)
    SELECT crop_id, class_name, err FROM o WHERE k <= 250""")
def w14_error_first_sample(spark, sf):
    c = bound(spark, sf, "crops").select("crop_id", "class_name", (F.col("price") > 300000).alias("err"))
    return ranking.errors_first_sample(c, "class_name", "err", "crop_id", rules.CLASS_KEYS)


@query(f"""WITH r AS (SELECT crop_id, class_name, {_rank('class_name', 'crop_id')} AS r FROM crops) SELECT crop_id, class_name FROM r WHERE r <= 35""")
def w15_per_class_sample(spark, sf):
    return ranking.per_class_sample(bound(spark, sf, "crops").select("crop_id", "class_name"), "class_name", "crop_id", 35, "42")


@query("SELECT crop_id FROM crops ORDER BY md5(concat('42|', crop_id)), crop_id LIMIT 500")
def w16_random_rows(spark, sf):
    return ranking.random_rows(bound(spark, sf, "crops").select("crop_id"), "crop_id", 500, "42")


@query("""WITH r AS (SELECT seq, class_name, row_number() OVER (PARTITION BY class_name ORDER BY seq) AS r FROM crops) SELECT seq, class_name FROM r WHERE r <= 100""")
def w17_first_per_class(spark, sf):
    return ranking.first_per_class(bound(spark, sf, "crops").select("seq", "class_name"), "class_name", "seq", 100)


@query("""SELECT crop_id, row_number() OVER (ORDER BY class_name, object_id, image_path, crop_id) - 1 AS idx, concat(class_name, '_', printf('%04d', row_number() OVER (ORDER BY class_name, object_id, image_path, crop_id) - 1), '.jpg') AS file_name FROM crops""")
def w18_stable_index(spark, sf):
    r = ranking.indexed(bound(spark, sf, "crops").select("crop_id", "class_name", "object_id", "image_path"), ["class_name", "object_id", "image_path", "crop_id"])
    return r.select("crop_id", F.col("idx").cast("long").alias("idx"), F.format_string("%s_%04d.jpg", "class_name", F.col("idx").cast("long")).alias("file_name"))


@query("""WITH e AS (SELECT oid, row_number() OVER (ORDER BY oid) AS r FROM parcels WHERE class_ui = '')
    SELECT p.oid, coalesce(r <= 500, false) AS selected FROM parcels p LEFT JOIN e ON p.oid = e.oid""")
def w19_bounded_processing(spark, sf):
    return ranking.first_eligible(bound(spark, sf, "parcels").select("oid", "class_ui"), core.is_empty(F.col("class_ui")), "oid", 500).select("oid", "selected")


@query("""WITH u AS (SELECT object_id, season, pano_id, CASE WHEN pano_id % 10 = 0 THEN 0 ELSE 1 END AS p FROM panoramas), r AS (SELECT *, row_number() OVER (PARTITION BY object_id, season ORDER BY p DESC, pano_id DESC) AS k FROM u)
    SELECT object_id, season, pano_id FROM r WHERE k = 1""")
def w20_latest_record(spark, sf):
    p = bound(spark, sf, "panoramas").select("object_id", "season", "pano_id")
    both = p.where("pano_id % 10 = 0").withColumn("p", F.lit(0)).unionByName(p.where("pano_id % 10 <> 0").withColumn("p", F.lit(1)))
    return both.groupBy("object_id", "season").agg(F.max_by("pano_id", F.struct("p", "pano_id")).alias("pano_id"))


# ---------------------------------------------------------------- sets


@query("SELECT object_id FROM crops GROUP BY 1 HAVING count(DISTINCT seq % 4 = 0) > 1")
def u1_leak_check(spark, sf):
    """Objects that stand in both halves; joins.without_leak() turns any into an error."""
    c = bound(spark, sf, "crops").withColumn("split", F.when(F.col("seq") % 4 == 0, "val").otherwise("train"))
    return joins.leaks(c, "object_id")


@query("SELECT object_id, 'train' AS split FROM crops WHERE seq % 5 <> 0 UNION ALL SELECT object_id, 'val' FROM crops WHERE seq % 5 = 0")
def u2_union_of_splits(spark, sf):
    c = bound(spark, sf, "crops")
    return c.where("seq % 5 <> 0").select("object_id", F.lit("train").alias("split")).unionByName(c.where("seq % 5 = 0").select("object_id", F.lit("val").alias("split")))


@query(f"""WITH r AS (SELECT crop_id, class_name, {_rank('class_name', 'crop_id')} AS r FROM crops) SELECT crop_id FROM r WHERE r > 35""")
def u3_rest(spark, sf):
    c = bound(spark, sf, "crops").select("crop_id", "class_name")
    return joins.missing(c, "crop_id", ranking.per_class_sample(c, "class_name", "crop_id", 35, "42"), "crop_id").select("crop_id")


# ---------------------------------------------------------------- geography

_dist = lambda a, b, c, d: f"2 * 6371000e0 * asin(least(1e0, sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"
_bear = lambda a, b, c, d: f"fmod(degrees(atan2(sin(radians({d} - {b})) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - {b})))) + 360, 360)"


@query(f"""SELECT pano_id, CASE WHEN {_dist('p.lat', 'p.lon', 'o.lat', 'o.lon')} >= 2 THEN round_even(round_even({_bear('p.lat', 'p.lon', 'o.lat', 'o.lon')}, 4), 2) END AS bearing, round_even({_dist('p.lat', 'p.lon', 'o.lat', 'o.lon')}, 2) AS distance_m,
    CASE WHEN {_dist('p.lat', 'p.lon', 'o.lat', 'o.lon')} < 2 THEN 'camera and object coincide' END AS notes FROM panoramas p JOIN objects o ON p.object_id = o.object_id""")
def f18_classification_region(spark, sf):
    p, o = bound(spark, sf, "panoramas"), bound(spark, sf, "objects").select("object_id", F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"))
    r = p.join(o, "object_id").select("pano_id", geo.classification_region(F.col("lat"), F.col("lon"), F.col("o_lat"), F.col("o_lon")).alias("r"))
    return r.select("pano_id", F.bround("r.bearing_geographic_deg", 2).alias("bearing"), F.col("r.distance_m_approx").alias("distance_m"), F.col("r.notes").alias("notes"))


@query("""SELECT object_id, round_even(degrees(asin(sin(radians(lat)) * cos(22 / 6371000e0) + cos(radians(lat)) * sin(22 / 6371000e0) * cos(radians(seq % 360)))), 6) AS lat,
    round_even(lon + degrees(atan2(sin(radians(seq % 360)) * sin(22 / 6371000e0) * cos(radians(lat)), cos(22 / 6371000e0) - sin(radians(lat)) * (sin(radians(lat)) * cos(22 / 6371000e0) + cos(radians(lat)) * sin(22 / 6371000e0) * cos(radians(seq % 360))))), 6) AS lon FROM objects""")
def f17_destination(spark, sf):
    o = bound(spark, sf, "objects")
    d = geo.destination(F.col("lat"), F.col("lon"), (F.col("seq") % 360).cast("double"), F.lit(22.0))
    return o.select("object_id", F.bround(d["lat"], 6).alias("lat"), F.bround(d["lon"], 6).alias("lon"))


def _ring(side_lon=1.0, side_lat=1.0):
    p = lambda a, b: F.struct((F.col("lon") + a * side_lon * F.col("side")).alias("lon"), (F.col("lat") + b * side_lat * F.col("side")).alias("lat"))
    return F.array(p(-1, -1), p(1, -1), p(1, 1), p(-1, 1), p(-1, -1))


@query("SELECT parcel_key, round_even(8 * side * side * 1e6, 3) AS area FROM parcels")
def f19_exterior_ring(spark, sf):
    p = bound(spark, sf, "parcels").withColumn("rings", F.array(_ring(0.5, 0.5), _ring(2.0, 1.0)))
    return p.select("parcel_key", F.bround(geo.ring_area(geo.exterior_ring(F.col("rings"))) * 1e6, 3).alias("area"))


_EDGES = f"""g AS (SELECT parcel_key, oid, lat, lon, unnest([{{'i': 0, 'ax': -1e0, 'ay': -1e0, 'bx': 1e0, 'by': -1e0}}, {{'i': 1, 'ax': 1e0, 'ay': -1e0, 'bx': 1e0, 'by': 1e0}}, {{'i': 2, 'ax': 1e0, 'ay': 1e0, 'bx': -1e0, 'by': 1e0}}, {{'i': 3, 'ax': -1e0, 'ay': 1e0, 'bx': -1e0, 'by': -1e0}}]) AS e, side FROM parcels),
    h AS (SELECT parcel_key, oid, lat, lon, e.i AS i, lon + e.ax * side AS ax, lat + e.ay * side AS ay, lon + e.bx * side AS bx, lat + e.by * side AS by_ FROM g), m AS (SELECT *, (ay + by_) / 2 AS my, (ax + bx) / 2 AS mx, {_dist('ay', 'ax', 'by_', 'bx')} AS edge, {_bear('ay', 'ax', 'by_', 'bx')} AS along FROM h),
    t AS (SELECT *, radians(fmod(along + 90, 360)) AS r1, radians(fmod(along + 270, 360)) AS r2, radians(my) AS p, 22 / 6371000e0 AS d FROM m WHERE edge >= 4),
    u AS (SELECT *, asin(sin(p) * cos(d) + cos(p) * sin(d) * cos(r1)) AS p1, asin(sin(p) * cos(d) + cos(p) * sin(d) * cos(r2)) AS p2 FROM t),
    v AS (SELECT *, degrees(p1) AS y1, degrees(p2) AS y2, mx + degrees(atan2(sin(r1) * sin(d) * cos(p), cos(d) - sin(p) * sin(p1))) AS x1, mx + degrees(atan2(sin(r2) * sin(d) * cos(p), cos(d) - sin(p) * sin(p2))) AS x2, {_dist('my', 'mx', 'lat', 'lon')} AS mine FROM u),
    w AS (SELECT *, CASE WHEN {_dist('y1', 'x1', 'lat', 'lon')} >= mine THEN y1 WHEN {_dist('y2', 'x2', 'lat', 'lon')} >= mine THEN y2 END AS y, CASE WHEN {_dist('y1', 'x1', 'lat', 'lon')} >= mine THEN x1 WHEN {_dist('y2', 'x2', 'lat', 'lon')} >= mine THEN x2 END AS x FROM v),
    points AS (SELECT parcel_key, oid, lat AS t_lat, lon AS t_lon, row_number() OVER (PARTITION BY parcel_key ORDER BY -edge, i) - 1 AS k, i AS edge_index, round_even(edge, 3) AS edge, round_even(x, 6) AS lon, round_even(y, 6) AS lat, fmod(round_even({_bear('y', 'x', 'lat', 'lon')}, 1), 360) AS bearing_deg FROM w WHERE y IS NOT NULL)"""
_LINKS = f"""l AS (SELECT parcel_key, CAST(regexp_extract(photos_ui, '(?i)[?&]ll=(-?[0-9.]+)(?:%2C|,)(-?[0-9.]+)', 1) AS DOUBLE) AS lon, CAST(regexp_extract(photos_ui, '(?i)[?&]ll=(-?[0-9.]+)(?:%2C|,)(-?[0-9.]+)', 2) AS DOUBLE) AS lat, lat AS t_lat, lon AS t_lon, contains(photos_ui, '/snapshots/') AS gallery FROM parcels WHERE contains(lower(photos_ui), 'll=')),
    links AS (SELECT parcel_key, lon, lat, fmod(round_even({_bear('lat', 'lon', 't_lat', 't_lon')}, 1), 360) AS bearing_deg, gallery FROM l)"""


@query(f"WITH {_EDGES} SELECT parcel_key, k AS i, edge_index, edge, lon, lat, bearing_deg FROM points")
def f21_boundary_points(spark, sf):
    p = tables.spread(bound(spark, sf, "parcels").select("parcel_key", "lat", "lon", "side"), "parcel_key")
    p = p.withColumn("points", geo.merged_points(geo.boundary_points(_ring(), F.col("lat"), F.col("lon"))))
    rows = p.select("parcel_key", F.posexplode_outer("points").alias("i", "p")).where("p IS NOT NULL")  # not outer, Spark works points out once more below the shuffle
    rows = rows.select("parcel_key", F.col("i").cast("long").alias("i"), "p.*")
    return rows.withColumn("edge_index", F.col("edge_index").cast("int")).withColumn("edge", F.bround("edge", 3)).withColumn("bearing_deg", F.pmod("bearing_deg", F.lit(360.0)))


@query(f"WITH {_EDGES}, {_LINKS} SELECT parcel_key, CAST(k + 1 AS INT) AS index, lon, lat, bearing_deg FROM points WHERE parcel_key NOT IN (SELECT parcel_key FROM links WHERE NOT gallery) UNION ALL SELECT parcel_key, 1, lon, lat, bearing_deg FROM links WHERE NOT gallery")
def f23_chosen_points(spark, sf):
    """Boundary points where the photos cell has a gallery, else the links' places with the bearing to the parcel, else boundary points."""
    p = tables.spread(bound(spark, sf, "parcels").select("parcel_key", "lat", "lon", "side", "photos_ui"), "parcel_key")
    links = F.transform(text.photo_coords(F.col("photos_ui")), lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat"), F.bround(geo.bearing(x["lat"], x["lon"], F.col("lat"), F.col("lon")), 1).alias("bearing_deg")))
    around = F.transform(geo.merged_points(geo.boundary_points(_ring(), F.col("lat"), F.col("lon"))), lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat"), x["bearing_deg"].alias("bearing_deg")))
    chosen = F.when(text.gallery_of(F.col("photos_ui")).isNull() & (F.size(links) > 0), links).otherwise(around)
    rows = p.select("parcel_key", F.posexplode_outer(chosen).alias("i", "p")).where("p IS NOT NULL").select("parcel_key", (F.col("i") + 1).alias("index"), "p.*")
    return rows.withColumn("bearing_deg", F.pmod("bearing_deg", F.lit(360.0)))


@query(f"""WITH pairs AS (SELECT o.object_id, p.pano_id, {_dist('o.lat', 'o.lon', 'p.lat', 'p.lon')} AS d FROM objects o JOIN panoramas p ON p.lat BETWEEN o.lat - 1e-3 AND o.lat + 1e-3 AND p.lon BETWEEN o.lon - 1e-3 AND o.lon + 1e-3)
    SELECT object_id, pano_id, round_even(d, 3) AS distance_m FROM pairs WHERE d <= 3.01""")
def j7_nearby_panoramas(spark, sf):
    return joins.nearby(bound(spark, sf, "objects"), bound(spark, sf, "panoramas"), 3.01, digits=3)


@query(f"""WITH pairs AS (SELECT o.object_id, p.pano_id, season, ts, {_dist('o.lat', 'o.lon', 'p.lat', 'p.lon')} AS d FROM objects o JOIN panoramas p ON p.lat BETWEEN o.lat - 1e-3 AND o.lat + 1e-3 AND p.lon BETWEEN o.lon - 1e-3 AND o.lon + 1e-3),
    r AS (SELECT *, row_number() OVER (PARTITION BY object_id, season ORDER BY round_even(d, 6), ts DESC, pano_id) AS k FROM pairs WHERE d <= 3.01), b AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY round_even(d, 6), season) AS j FROM r WHERE k = 1)
    SELECT object_id, season, pano_id FROM b WHERE j <= 4""")
def w8_season_pick(spark, sf):
    return joins.season_picks(bound(spark, sf, "objects"), bound(spark, sf, "panoramas"), 3.01).select("object_id", "season", "pano_id")


# ---------------------------------------------------------------- text rules


@query(f"SELECT parcel_key, {TEXT_CLASS_SQL} AS class_ui, {TEXT_SUB_SQL} AS subclass_ui FROM parcels")
def f1_text_class(spark, sf):
    return bound(spark, sf, "parcels").select("parcel_key", rules.text_class(F.col("generated_land_use")).alias("c")).select("parcel_key", "c.*")


@query(f"""WITH c AS (SELECT parcel_key, {TEXT_CLASS_SQL} AS a, {TEXT_SUB_SQL} AS b FROM parcels) SELECT parcel_key, CASE WHEN a = '' THEN {_DEFAULT_CLASS} ELSE a END AS class_ui, CASE WHEN a = '' THEN {_DEFAULT_SUB} ELSE b END AS subclass_ui FROM c""")
def f2_text_class_or_default(spark, sf):
    return bound(spark, sf, "parcels").select("parcel_key", rules.text_class_or_default(F.col("generated_land_use")).alias("c")).select("parcel_key", "c.*")


@query(f"""WITH t AS (SELECT parcel_key, oid, ['natural_areas', 'low_density_degraded', 'underused_infrastructure', 'frozen_construction', 'active_construction', 'active_urban'][oid % 6 + 1] AS k FROM parcels) SELECT parcel_key, k AS class_key, {_finer('k', "'default'")} AS subclass FROM t""")
def f3_refined_subclass(spark, sf):
    p = bound(spark, sf, "parcels").withColumn("class_key", F.element_at(F.array(*map(F.lit, rules.CLASS_KEYS)), (F.col("oid") % 6 + 1).cast("int")))
    return p.select("parcel_key", "class_key", rules.refined_subclass(F.col("class_key"), F.col("generated_land_use"), F.lit("default")).alias("subclass"))


@query(f"SELECT parcel_key, {_KEYS_SQL} AS class_key FROM parcels")
def p18_analyst_key(spark, sf):
    return bound(spark, sf, "parcels").select("parcel_key", rules.analyst_key(F.col("class_corrected_ui")).alias("class_key"))


@query("SELECT parcel_key, trim(class_corrected_ui) AS label FROM parcels WHERE trim(class_corrected_ui) NOT IN ('', 'nan', 'Категории нет')")
def p4_valid_label(spark, sf):
    return bound(spark, sf, "parcels").where(rules.is_valid_label(F.col("class_corrected_ui"))).select("parcel_key", F.trim("class_corrected_ui").alias("label"))


@query("""SELECT parcel_key, contains(lower(generated_land_use), 'просто зелень') OR contains(lower(generated_land_use), 'прочие нежилые') AS ambiguous, contains(lower(generated_land_use), 'зелен') AND contains(lower(generated_land_use), 'двор') AS hard, contains(lower(photos_ui), 'll=') AS has_link FROM parcels""")
def p19_p20_p21_predicates(spark, sf):
    p = bound(spark, sf, "parcels")
    return p.select("parcel_key", rules.is_ambiguous(F.col("generated_land_use")).alias("ambiguous"), rules.is_hard_case(F.col("generated_land_use")).alias("hard"), text.has_link(F.col("photos_ui")).alias("has_link"))


@query("""WITH t AS (SELECT parcel_key, CASE oid % 5 WHEN 0 THEN NULL WHEN 1 THEN concat(chr(9), ' ', chr(10)) WHEN 2 THEN 'nan' WHEN 3 THEN '' ELSE ' own ' END AS mine, CASE oid % 7 WHEN 0 THEN 'NaN' WHEN 1 THEN ' given ' WHEN 2 THEN NULL WHEN 3 THEN concat(chr(9), 'tab', chr(10)) WHEN 4 THEN chr(10) ELSE 'plain' END AS given, oid FROM parcels)
    SELECT parcel_key, CASE WHEN oid % 5 < 4 AND oid % 7 IN (1, 3, 5, 6) THEN CASE oid % 7 WHEN 1 THEN 'given' WHEN 3 THEN 'tab' ELSE 'plain' END ELSE mine END AS filled FROM t""")
def p2_fill_if_empty(spark, sf):
    p = bound(spark, sf, "parcels")
    mine = F.expr("CASE oid % 5 WHEN 0 THEN NULL WHEN 1 THEN concat(char(9), ' ', char(10)) WHEN 2 THEN 'nan' WHEN 3 THEN '' ELSE ' own ' END")
    given = F.expr("CASE oid % 7 WHEN 0 THEN 'NaN' WHEN 1 THEN ' given ' WHEN 2 THEN NULL WHEN 3 THEN concat(char(9), 'tab', char(10)) WHEN 4 THEN char(10) ELSE 'plain' END")
    return p.select("parcel_key", core.fill_if_empty(mine, given).alias("filled"))


@query("""SELECT image_path, CASE WHEN contains(lower(raw), 'underused_infrastructure') THEN 'underused_infrastructure' WHEN contains(lower(raw), 'low_density_degraded') THEN 'low_density_degraded' WHEN contains(lower(raw), 'active_construction') THEN 'active_construction' WHEN contains(lower(raw), 'frozen_construction') THEN 'frozen_construction'
    WHEN contains(lower(raw), 'natural_areas') THEN 'natural_areas' WHEN contains(lower(raw), 'active_urban') THEN 'active_urban' END AS class_name, NOT contains(lower(raw), 'unsure') AS confident FROM annotations""")
def f9_answer_parsing(spark, sf):
    return bound(spark, sf, "annotations").select("image_path", rules.parsed_class(F.col("raw")).alias("class_name"), rules.is_confident(F.col("raw")).alias("confident"))


@query("""SELECT object_id, class_name, CASE WHEN class_name IN ('frozen_construction', 'active_construction') THEN 'construction' ELSE class_name END AS five, CASE WHEN class_name IN ('frozen_construction', 'active_construction') THEN 'construction' WHEN class_name = 'natural_areas' THEN class_name ELSE 'built_up' END AS three FROM objects""")
def p16_regroup(spark, sf):
    return bound(spark, sf, "objects").select("object_id", "class_name", rules.regrouped(F.col("class_name"), 5).alias("five"), rules.regrouped(F.col("class_name"), 3).alias("three"))


@query(f"""SELECT object_id, {_of('class_name', _LABEL)} AS label, {_of('class_name', _SUBLABEL)} AS subclass FROM objects""")
def p17_j9_labels(spark, sf):
    return bound(spark, sf, "objects").select("object_id", rules.label_of(F.col("class_name")).alias("label"), rules.label_of(F.col("class_name"), 1).alias("subclass"))


# ---------------------------------------------------------------- links, names, boxes


@query(r"""WITH m AS (SELECT parcel_key, unnest(regexp_extract_all(photos_ui, '(?i)[?&]ll=(-?\d+(?:\.\d+)?)(?:%2C|,)(-?\d+(?:\.\d+)?)', 1)) AS lon, unnest(regexp_extract_all(photos_ui, '(?i)[?&]ll=(-?\d+(?:\.\d+)?)(?:%2C|,)(-?\d+(?:\.\d+)?)', 2)) AS lat FROM parcels)
    SELECT DISTINCT parcel_key, round_even(CAST(lon AS DOUBLE), 6) AS lon, round_even(CAST(lat AS DOUBLE), 6) AS lat FROM m""")
def f4_photo_coords(spark, sf):
    return bound(spark, sf, "parcels").select("parcel_key", F.explode(text.photo_coords(F.col("photos_ui"))).alias("p")).select("parcel_key", "p.*")


@query(r"""WITH u AS (SELECT parcel_key, unnest(regexp_split_to_array(photos_ui, '[\s,;|]+')) AS url FROM parcels) SELECT parcel_key, url, regexp_matches(url, '(?i)\.(jpe?g|png|gif|webp|bmp|svg)(\?|#|$)') AS is_image FROM u WHERE regexp_matches(url, '(?i)^https?://')""")
def f5_f6_urls(spark, sf):
    return bound(spark, sf, "parcels").select("parcel_key", F.explode(text.urls_of(F.col("photos_ui"))).alias("url")).withColumn("is_image", text.is_raster_url(F.col("url")))


@query(r"""SELECT page_id, regexp_matches(url, '(?i)^https?://') AS web, regexp_matches(url, '(?i)\.(jpe?g|png|gif|webp|bmp|svg)(\?|#|$)') OR regexp_matches(url, '(?i)maps\.googleapis\.com/maps/api/streetview\?') AS raster FROM pages""")
def f6_page_urls(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet")
    return p.select("page_id", F.col("url").rlike("(?i)^https?://").alias("web"), text.is_raster_url(F.col("url")).alias("raster"))


@query("""SELECT parcel_key, CASE WHEN oid % 3 = 0 THEN concat('/snapshots/ds/p', oid, '/') END AS gallery, CASE WHEN oid % 3 = 0 THEN substr(photos_ui, instr(photos_ui, ' ') + 1) ELSE photos_ui END AS rest FROM parcels""")
def f5_split_photos(spark, sf):
    return bound(spark, sf, "parcels").select("parcel_key", text.split_photos(F.col("photos_ui")).alias("s")).select("parcel_key", "s.*")


@query("""WITH t AS (SELECT *, round_even(37 + (oid % 1000) / 1e3, 3) AS x, round_even(55 + (oid % 777) / 1e3, 3) AS y FROM parcels), e AS (SELECT oid, row_number() OVER (ORDER BY oid) AS r FROM parcels WHERE photos_ui = '' AND oid % 4 < 2)
    SELECT parcel_key, CASE WHEN e.r <= 300 THEN concat('/snapshots/town/', parcel_key, '/ https://yandex.ru/map-widget/v1/?ll=', x, '%2C', y, '&z=18&l=stv&lang=ru_RU https://yandex.ru/map-widget/v1/?ll=', y, '%2C', x, '&z=18&l=stv&lang=ru_RU') ELSE photos_ui END AS photos_ui FROM t LEFT JOIN e ON t.oid = e.oid""")
def f7_f8_links(spark, sf):
    """Links for a set of parcels, where there is none, and for no more than the first 300."""
    p = bound(spark, sf, "parcels")
    x, y = F.bround(37 + (F.col("oid") % 1000) / F.lit(1000.0), 3), F.bround(55 + (F.col("oid") % 777) / F.lit(1000.0), 3)
    points = F.array(F.struct(x.alias("lon"), y.alias("lat")), F.struct(y.alias("lon"), x.alias("lat")))
    return joins.linked(p, text.photos_cell(F.lit("town"), F.col("parcel_key"), points), p.where("oid % 4 < 2"), 300).select("parcel_key", "photos_ui")


@query("""WITH t AS (SELECT parcel_key, oid, round_even(37 + (oid % 1000) / 1e3, 3) AS x, round_even(55 + (oid % 777) / 1e3, 3) AS y FROM parcels)
    SELECT parcel_key, concat('https://yandex.ru/maps/?ll=', x, '%2C', y, '&z=19&l=stv&pt=', x, '%2C', y, ',pm2rdm', CASE WHEN oid % 4 > 0 THEN concat('&panorama%5Bdirection%5D=', CAST(round_even(oid % 360 + (oid % 4) / 4e0, 0) AS INT)) ELSE '' END) AS url FROM t""")
def f7_map_url(spark, sf):
    x, y = F.bround(37 + (F.col("oid") % 1000) / F.lit(1000.0), 3), F.bround(55 + (F.col("oid") % 777) / F.lit(1000.0), 3)
    look = F.when(F.col("oid") % 4 > 0, F.col("oid") % 360 + (F.col("oid") % 4) / F.lit(4.0))
    return bound(spark, sf, "parcels").select("parcel_key", text.map_url(x, y, look).alias("url"))


@query("""SELECT pano_id, month(ts) AS month, CAST(ts AS DATE)::VARCHAR AS capture_date, year(ts) AS year, day(ts) AS day, CASE WHEN month(ts) IN (12, 1, 2) THEN 'winter' WHEN month(ts) <= 5 THEN 'spring' WHEN month(ts) <= 8 THEN 'summer' ELSE 'autumn' END AS capture_season FROM panoramas""")
def p9_p10_capture_date(spark, sf):
    p = bound(spark, sf, "panoramas").select("pano_id", text.capture_parts(F.timestamp_seconds(F.unix_timestamp("ts"))).alias("c"))
    return p.select("pano_id", F.col("c.capture_month").alias("month"), "c.capture_date", F.col("c.capture_year").alias("year"), F.col("c.capture_day").alias("day"), "c.capture_season")


@query("""WITH t AS (SELECT pano_id, CASE pano_id % 3 WHEN 0 THEN 'panorama' WHEN 1 THEN concat('panorama_', season) ELSE season END AS stem FROM panoramas) SELECT pano_id, CASE WHEN stem = 'panorama' THEN NULL WHEN starts_with(stem, 'panorama_') THEN substr(stem, 10) ELSE stem END AS season FROM t""")
def p11_season_from_name(spark, sf):
    stem = F.when(F.col("pano_id") % 3 == 0, F.lit("panorama")).when(F.col("pano_id") % 3 == 1, F.concat(F.lit("panorama_"), "season")).otherwise(F.col("season"))
    return bound(spark, sf, "panoramas").select("pano_id", text.season_from_name(stem).alias("season"))


@query("SELECT seq, image_path LIKE '%\\_h___.jpg' ESCAPE '\\' AS multi FROM samples")
def p13_multi_heading(spark, sf):
    return bound(spark, sf, "samples").select("seq", text.is_multi_heading(F.col("image_path")).alias("multi"))


@query("""SELECT crop_id, fmod(bearing + 15, 360) AS heading, '' AS tag FROM crops WHERE bearing IS NOT NULL
    UNION ALL SELECT crop_id, CAST((h + 15) % 360 AS DOUBLE), concat('h', lpad(CAST(h AS VARCHAR), 3, '0')) FROM crops, unnest([0, 90, 180, 350]) AS u(h) WHERE bearing IS NULL""")
def p14_heading_fan_out(spark, sf):
    views = text.heading_fan_out(F.col("bearing"), 15.0, F.array(*[F.lit(float(h)) for h in (0, 90, 180, 350)]))
    return bound(spark, sf, "crops").select("crop_id", F.explode(views).alias("h")).select("crop_id", "h.*")


@query("""WITH v AS (SELECT crop_id, seq, split, class_name, bearing, h FROM crops, unnest(CASE WHEN bearing IS NULL THEN [0, 180] ELSE [-1] END) AS u(h))
    SELECT crop_id, concat(split, '/', class_name, '/', seq % 5000, CASE WHEN h >= 0 THEN concat('_h', lpad(CAST(h AS VARCHAR), 3, '0')) ELSE '' END, '.jpg') AS new_path, round_even(CASE WHEN h >= 0 THEN h ELSE bearing END, 4) AS heading_deg, CASE WHEN seq % 3 = 0 THEN 90e0 ELSE 75e0 END AS fov_deg, h >= 0 AS multi_heading FROM v""")
def p15_crop_record(spark, sf):
    """A crop's record: its path, and its view with the field of the region, or else of 90 degrees."""
    c = bound(spark, sf, "crops").withColumn("v", F.explode(text.heading_fan_out(F.col("bearing"), 0.0, F.array(F.lit(0.0), F.lit(180.0)))))
    r = text.crop_record(F.col("split"), F.col("class_name"), F.col("image_path"), F.col("v"), F.when(F.col("seq") % 3 != 0, 75.0))
    c = c.select("crop_id", r.alias("r")).select("crop_id", F.col("r.image_path").alias("new_path"), "r.perspective.*")
    return c.select("crop_id", "new_path", "heading_deg", "fov_deg", "multi_heading")


@query("""WITH e AS (SELECT object_id, season, CASE WHEN season = 'autumn' THEN NULL ELSE arg_min(lat, pano_id) END AS y, arg_min(lon, pano_id) AS x FROM panoramas GROUP BY 1, 2), f AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY season) AS k FROM e),
    s AS (SELECT pano_id, object_id, CASE WHEN pano_id % 3 > 0 THEN season END AS season FROM panoramas)
    SELECT s.pano_id, CASE WHEN q.y IS NOT NULL THEN q.y ELSE o.lat END AS lat, CASE WHEN q.y IS NOT NULL THEN q.x ELSE o.lon END AS lon FROM s JOIN objects o ON s.object_id = o.object_id LEFT JOIN f q ON q.object_id = s.object_id AND CASE WHEN s.season IS NULL THEN q.k = 1 ELSE q.season = s.season END""")
def p12_capture_position(spark, sf):
    rows = bound(spark, sf, "panoramas").withColumn("season", F.when(F.col("pano_id") % 3 > 0, F.col("season"))).select("pano_id", "object_id", "season").join(_placed(spark, sf), "object_id")
    return rows.select("pano_id", geo.capture_position(F.col("panoramas_by_season"), F.col("season"), F.col("lat"), F.col("lon")).alias("p")).select("pano_id", "p.*")


def _placed(spark, sf):
    """Objects with a map of their seasons' first panoramas; those of autumn have no latitude."""
    p = bound(spark, sf, "panoramas").groupBy("object_id", "season").agg(F.min_by(F.struct("lat", "lon"), "pano_id").alias("at"))
    p = p.withColumn("at", F.struct(F.when(F.col("season") != "autumn", F.col("at.lat")).alias("lat"), F.col("at.lon").alias("lon")))
    p = p.groupBy("object_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("season", "at")))).alias("panoramas_by_season"))
    return bound(spark, sf, "objects").join(p, "object_id", "left")


@query("SELECT seq, image_path FROM samples")
def p22_without_private_columns(spark, sf):
    s = bound(spark, sf, "samples").select("seq", "image_path", F.lit(1).alias("_std"), F.col("class_id").alias("_pred"))
    return tables.without_private(s)


_TAGS = {"landuse": "landuse", "building": "building", "shop": "shop", "amenity": "amenity", "parking": "parking", "abandoned": "abandoned", "name": "name", "leisure": "leisure", "nature": "natural", "office": "office", "highway": "highway", "disused_highway": "disused:highway", "construction": "construction", "abandoned_building": "abandoned:building", "disused_building": "disused:building", "disused": "disused"}


def _elements(spark, sf):
    e = bound(spark, sf, "elements")
    return e.withColumn("tags", F.map_filter(F.map_from_arrays(F.array(*map(F.lit, _TAGS.values())), F.array(*_TAGS)), lambda k, v: v.isNotNull()))


# Which elements are of which class, written out by hand.
_CLASS_OF_TAGS = """tagged AS (
    SELECT *, 'natural_areas' AS class_name FROM elements WHERE type = 'way' AND (landuse IN ('forest', 'meadow', 'grass') OR leisure IN ('park', 'nature_reserve') OR nature IN ('wood', 'scrub')) OR type = 'relation' AND (landuse = 'forest' OR leisure = 'park')
    UNION ALL SELECT *, 'low_density_degraded' FROM elements WHERE type = 'way' AND (building = 'abandoned' OR abandoned_building IS NOT NULL OR disused_building IS NOT NULL OR building IS NOT NULL AND (abandoned = 'yes' OR disused = 'yes') OR landuse = 'residential' OR amenity = 'parking' AND parking = 'garage_boxes') OR type = 'relation' AND (building = 'abandoned' OR abandoned = 'yes')
    UNION ALL SELECT *, 'underused_infrastructure' FROM elements WHERE type = 'way' AND (shop = 'vacant' OR amenity = 'vacant' OR office = 'vacant' OR amenity = 'parking' AND parking IN ('surface', 'multi-storey') OR building IN ('commercial', 'retail') OR highway = 'bus_stop' AND disused_highway = 'bus_stop') OR type = 'relation' AND shop = 'vacant'
    UNION ALL SELECT *, 'frozen_construction' FROM elements WHERE landuse = 'construction' OR type = 'way' AND (construction = 'yes' OR building = 'construction')
    UNION ALL SELECT *, 'active_construction' FROM elements WHERE landuse = 'construction' OR type = 'way' AND construction = 'yes'
    UNION ALL SELECT *, 'active_urban' FROM elements WHERE type = 'way' AND (building IN ('apartments', 'residential') OR shop IS NOT NULL OR amenity IN ('cafe', 'restaurant') OR contains(highway, 'primary') OR contains(highway, 'secondary')) OR type = 'relation' AND building = 'apartments')"""


@query(f"WITH {_CLASS_OF_TAGS} SELECT id, class_name FROM tagged")
def p5_tag_classes(spark, sf):
    return _elements(spark, sf).select("id", F.explode(rules.tag_classes(F.col("type"), F.col("tags"))).alias("class_name"))


@query("""WITH t AS (SELECT id, coalesce(c_lat, e_lat) AS lat, coalesce(c_lon, e_lon) AS lon, coalesce(name, landuse, leisure, 'natural_areas') AS name FROM elements WHERE (c_lat IS NOT NULL AND c_lon IS NOT NULL) OR (e_lat IS NOT NULL AND e_lon IS NOT NULL))
    SELECT * FROM t WHERE lat BETWEEN 55.5 AND 55.95 AND lon BETWEEN 37.35 AND 37.85""")
def p6_p7_bbox_and_fallback(spark, sf):
    e = _elements(spark, sf)
    place = F.coalesce(F.when(F.col("c_lat").isNotNull() & F.col("c_lon").isNotNull(), F.struct(F.col("c_lat").alias("lat"), F.col("c_lon").alias("lon"))), F.when(F.col("e_lat").isNotNull() & F.col("e_lon").isNotNull(), F.struct(F.col("e_lat").alias("lat"), F.col("e_lon").alias("lon"))))
    name = F.coalesce(F.element_at("tags", F.lit("name")), F.element_at("tags", F.lit("landuse")), F.element_at("tags", F.lit("leisure")), F.lit("natural_areas"))
    return e.select("id", place.alias("p"), name.alias("name")).where("p IS NOT NULL").select("id", "p.lat", "p.lon", "name").where("lat BETWEEN 55.5 AND 55.95 AND lon BETWEEN 37.35 AND 37.85")


@query(r"""WITH t AS (SELECT seq, class_name, lat, lon, substr(trim(regexp_replace(concat(name, ' (', seq, ')'), '[^\p{L}\p{N} _-]', '', 'g')), 1, 40) AS safe FROM objects)
    SELECT seq, replace(concat(class_name, '_way', seq, '_', printf('%.6f', lat), '_', printf('%.6f', lon), '_', safe), ' ', '_') AS item_id FROM t""")
def p8_item_id(spark, sf):
    o = bound(spark, sf, "objects").withColumn("name", F.concat("name", F.lit(" ("), F.col("seq").cast("string"), F.lit(")")))
    return o.select("seq", text.safe_item_id(F.col("class_name"), F.lit("way"), F.col("seq"), F.col("seq"), F.col("lat"), F.col("lon"), F.col("name")).alias("item_id"))


@query("""WITH t AS (SELECT oid, (oid % 50) / 1e2 AS x0, (oid % 40) / 1e2 AS y0, (oid % 50 + 30) / 1e2 AS x1, (oid % 40 + 45) / 1e2 AS y1 FROM parcels)
    SELECT oid, concat('<loc', lpad(CAST(CAST(round_even(y0 * 1023, 0) AS INT) AS VARCHAR), 4, '0'), '><loc', lpad(CAST(CAST(round_even(x0 * 1023, 0) AS INT) AS VARCHAR), 4, '0'), '><loc', lpad(CAST(CAST(round_even(y1 * 1023, 0) AS INT) AS VARCHAR), 4, '0'), '><loc', lpad(CAST(CAST(round_even(x1 * 1023, 0) AS INT) AS VARCHAR), 4, '0'), '>') AS tokens,
    round_even(CAST(round_even(x0 * 1023, 0) AS INT) / 1023e0, 4) AS back_x0, round_even(CAST(round_even(y1 * 1023, 0) AS INT) / 1023e0, 4) AS back_y1 FROM t""")
def f10_f11_location_tokens(spark, sf):
    o = F.col("oid")
    p = bound(spark, sf, "parcels").select("oid", text.location_tokens(o % 50 / F.lit(100.0), o % 40 / F.lit(100.0), (o % 50 + 30) / F.lit(100.0), (o % 40 + 45) / F.lit(100.0)).alias("tokens"))
    b = text.location_boxes(F.col("tokens"))[0]
    return p.select("oid", "tokens", b[0].alias("back_x0"), b[3].alias("back_y1"))


@query("""WITH t AS (SELECT oid, (oid % 50) / 1e2 AS x0, (oid % 40) / 1e2 AS y0, (oid % 50 + 30) / 1e2 AS x1, (oid % 40 + 45) / 1e2 AS y1 FROM parcels), i AS (SELECT *, greatest(0, least(x1, 0.6) - greatest(x0, 0.2)) * greatest(0, least(y1, 0.7) - greatest(y0, 0.1)) AS a FROM t)
    SELECT oid, round_even(a / ((x1 - x0) * (y1 - y0) + 0.4 * 0.6 - a), 6) AS iou FROM i""")
def f13_box_iou(spark, sf):
    o = F.col("oid")
    box = F.array(o % 50 / F.lit(100.0), o % 40 / F.lit(100.0), (o % 50 + 30) / F.lit(100.0), (o % 40 + 45) / F.lit(100.0))
    return bound(spark, sf, "parcels").select("oid", F.bround(text.box_iou(box, F.array(*map(F.lit, (0.2, 0.1, 0.6, 0.7)))), 6).alias("iou"))


# ---------------------------------------------------------------- vectors


@query("SELECT seq, round_even(list_sum(list_transform(list_transform(pixels, lambda x: CAST(x AS DOUBLE)), lambda x: x / sqrt(list_sum(list_transform(pixels, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))))), 5) AS total FROM samples")
def f26_normalised(spark, sf):
    v = vectors.normalised(F.col("pixels"))
    return bound(spark, sf, "samples").select("seq", F.bround(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("""WITH t AS (SELECT seq, list_transform(range(10), lambda i: 0.7 * CAST(pixels[i + 1] AS DOUBLE) + (1 - 0.7) * CAST(pixels[i + 11] AS DOUBLE)) AS z FROM samples) SELECT seq, CAST(list_position(z, list_max(z)) - 1 AS BIGINT) AS predicted FROM t""")
def f29_blend(spark, sf):
    z = vectors.blended(F.transform(F.slice("pixels", 1, 10), lambda x: x.cast("double")), F.transform(F.slice("pixels", 11, 10), lambda x: x.cast("double")), F.lit(0.7))
    return bound(spark, sf, "samples").select("seq", vectors.argmax(z).cast("long").alias("predicted"))


@query("""WITH m AS (SELECT seq, list_transform(pixels, lambda x: CAST(x AS DOUBLE)) AS p, list_avg(list_transform(pixels, lambda x: CAST(x AS DOUBLE))) AS m FROM samples)
    SELECT seq, round_even(sqrt(list_avg(list_transform(p, lambda x: (x - m) * (x - m)))), 5) AS std,
    round_even(list_avg(list_transform(list_filter(range(1, 64), lambda i: i % 8 <> 0), lambda i: pow(p[i] - p[i + 1], 2))) + list_avg(list_transform(range(1, 57), lambda i: pow(p[i] - p[i + 8], 2))), 5) AS sharpness,
    array_to_string(list_transform(p, lambda x: CASE WHEN x > m THEN '1' ELSE '0' END), '') AS bits FROM m""")
def f30_quality_metrics(spark, sf):
    s = bound(spark, sf, "samples")
    return s.select("seq", F.bround(vectors.pixel_std(F.col("pixels")), 5).alias("std"), F.bround(vectors.sharpness(F.col("pixels"), 8, 8), 5).alias("sharpness"), F.lpad(F.bin(vectors.average_hash(F.col("pixels"))), 64, "0").alias("bits"))


@query("SELECT seq, round_even(list_sum(list_transform(pixels[25:64], lambda x: CAST(x AS DOUBLE))), 5) AS total, len(pixels[25:64]) AS n FROM samples")
def f34_sky_crop(spark, sf):
    v = vectors.sky_cropped(F.col("pixels"), 8, 8, 0.625)
    return bound(spark, sf, "samples").select("seq", F.bround(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"), F.size(v).cast("long").alias("n"))


def _prototypes(spark, sf):
    """Mean embedding of each class: as many rows as classes."""
    s = bound(spark, sf, "samples")
    cells = s.select("class_id", F.posexplode("pixels").alias("i", "x")).groupBy("class_id", "i").agg(F.avg("x").alias("x"))
    return cells.groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select("class_id", F.transform("v", lambda p: p["x"]).alias("v"))


@query("""WITH c AS (SELECT class_id, i, avg(CAST(pixels[i] AS DOUBLE)) AS x FROM samples, range(1, 65) r(i) GROUP BY 1, 2), d AS (SELECT s.seq, c.class_id, sum(CAST(s.pixels[i] AS DOUBLE) * c.x) AS z FROM samples s, c GROUP BY 1, 2)
    SELECT seq, arg_max(class_id, round_even(z, 6)) AS predicted FROM (SELECT * FROM d ORDER BY class_id) GROUP BY seq""")
def f27_zero_shot(spark, sf):
    p = _prototypes(spark, sf).agg(F.array_sort(F.collect_list(F.struct("class_id", "v"))).alias("prototypes"))
    s = bound(spark, sf, "samples").crossJoin(F.broadcast(p))  # one row: the classes' prototypes
    z = F.transform("prototypes", lambda c: F.bround(vectors.dot(F.col("pixels"), c["v"]), 6))
    return s.select("seq", F.get(F.col("prototypes"), vectors.argmax(z).cast("int"))["class_id"].alias("predicted"))


@query("""WITH t AS (SELECT seq, [0.5 * CAST(pixels[1] AS DOUBLE) + 0.1, -0.25 * CAST(pixels[2] AS DOUBLE), CAST(pixels[3] AS DOUBLE) - 0.1] AS z FROM samples), e AS (SELECT seq, z, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM t)
    SELECT seq, ['a', 'b', 'c'][list_position(z, list_max(z))] AS class_key, round_even(list_max(e) / list_sum(e), 6) AS confidence FROM e""")
def f28_head_inference(spark, sf):
    import numpy as np

    w = np.zeros((3, 64))
    w[0, 0], w[1, 1], w[2, 2] = 0.5, -0.25, 1.0
    s = bound(spark, sf, "samples").select("seq", "pixels")
    return vectors.head_scores(s, w, np.array([0.1, 0.0, -0.1]), ["a", "b", "c"], "pixels").select("seq", "class_key", F.bround("confidence", 6).alias("confidence"))


@query("""WITH m AS (SELECT seq, list_filter(range(64), lambda i: pixels[i + 1] >= 0.02) AS on_ FROM samples), b AS (SELECT seq, len(on_) AS n, list_min(list_transform(on_, lambda i: i % 8)) / 7e0 AS x0, list_max(list_transform(on_, lambda i: i % 8)) / 7e0 AS x1, list_min(list_transform(on_, lambda i: i // 8)) / 7e0 AS y0, list_max(list_transform(on_, lambda i: i // 8)) / 7e0 AS y1 FROM m),
    w AS (SELECT seq, n, CASE WHEN x1 - x0 < 0.05 THEN greatest(0, x0 - 0.05) ELSE x0 END AS x0, CASE WHEN y1 - y0 < 0.05 THEN greatest(0, y0 - 0.05) ELSE y0 END AS y0, CASE WHEN x1 - x0 < 0.05 THEN least(1, x1 + 0.05) ELSE x1 END AS x1, CASE WHEN y1 - y0 < 0.05 THEN least(1, y1 + 0.05) ELSE y1 END AS y1 FROM b)
    SELECT seq, round_even(CASE WHEN n < 16 THEN 0.15e0 ELSE x0 END, 6) AS x0, round_even(CASE WHEN n < 16 THEN 0.15e0 ELSE y0 END, 6) AS y0, round_even(CASE WHEN n < 16 THEN 0.85e0 ELSE x1 END, 6) AS x1, round_even(CASE WHEN n < 16 THEN 0.85e0 ELSE y1 END, 6) AS y1 FROM w""")
def f14_evidence_box(spark, sf):
    s = bound(spark, sf, "samples").select("seq", F.col("pixels").alias("heat"), F.lit(8).alias("width"))
    return vectors.evidence_boxes(s, threshold=0.02).select("seq", *[F.bround(F.element_at("box", i), 6).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"), 1)])


# ---------------------------------------------------------------- joins


@query("""WITH c AS (SELECT image_path, arg_max(class_name, seq) AS osm_label, arg_max(object_id, seq) AS object_id FROM crops GROUP BY 1)
    SELECT a.image_path, vlm_label AS class_name, osm_label, object_id, CASE WHEN vlm_label NOT IN ('natural_areas', 'low_density_degraded', 'underused_infrastructure', 'frozen_construction', 'active_construction', 'active_urban') THEN 'bad_label' WHEN NOT coalesce(vlm_confident, true) THEN 'unsure' WHEN c.image_path IS NULL THEN 'no_crop_record' END AS reason
    FROM annotations a LEFT JOIN c ON a.image_path = c.image_path""")
def j1_relabel(spark, sf):
    return joins.relabelled(bound(spark, sf, "crops"), bound(spark, sf, "annotations"), rules.CLASS_KEYS)


@query(f"""WITH r AS (SELECT object_id, {_rank('', 'object_id')} AS r, count(*) OVER () AS n FROM objects) SELECT crop_id, CASE WHEN r <= floor(n * 0.2e0) THEN 'val' ELSE 'train' END AS split FROM crops c JOIN r ON c.object_id = r.object_id""")
def j2_split_join(spark, sf):
    split = ranking.plain_split(bound(spark, sf, "objects").select("object_id"), "object_id")
    return bound(spark, sf, "crops").drop("split").join(split, "object_id").select("crop_id", "split")


@query("SELECT crop_id FROM crops WHERE image_path NOT IN (SELECT image_path FROM annotations)")
def j3_j5_missing(spark, sf):
    return joins.missing(bound(spark, sf, "crops"), "image_path", bound(spark, sf, "annotations"), "image_path").select("crop_id")


@query("SELECT object_id FROM objects WHERE object_id NOT IN (SELECT object_id FROM panoramas)")
def j4_without_panorama(spark, sf):
    return joins.missing(bound(spark, sf, "objects"), "object_id", bound(spark, sf, "panoramas"), "object_id").select("object_id")


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY parcel_key ORDER BY seq DESC) AS r FROM corrections) SELECT p.parcel_key, CASE WHEN l.seq IS NULL THEN p.class_ui ELSE coalesce(l.class_ui, '') END AS class_ui, CASE WHEN l.seq IS NULL THEN p.subclass_corrected_ui ELSE coalesce(l.subclass_corrected_ui, '') END AS subclass_corrected_ui,
    coalesce(l.panorama_status_ui, p.panorama_status_ui) AS panorama_status_ui FROM parcels p LEFT JOIN l ON p.parcel_key = l.parcel_key AND l.r = 1""")
def j6_correction_upsert(spark, sf):
    return joins.upserted(bound(spark, sf, "parcels"), bound(spark, sf, "corrections")).select("parcel_key", "class_ui", "subclass_corrected_ui", "panorama_status_ui")


_HC = f"WITH c AS (SELECT *, {TEXT_CLASS_SQL} AS a, {TEXT_SUB_SQL} AS b FROM parcels), p AS (SELECT *, CASE WHEN a = '' THEN {_DEFAULT_CLASS} ELSE a END AS cls, CASE WHEN a = '' THEN {_DEFAULT_SUB} ELSE b END AS sub FROM c)"


@query(f"{_HC} SELECT oid, cls = trim(class_corrected_ui) AS class_equal, sub = trim(subclass_corrected_ui) AS subclass_equal FROM p WHERE trim(class_corrected_ui) NOT IN ('', 'nan', 'Категории нет')")
def j8_prediction_vs_correction(spark, sf):
    p = bound(spark, sf, "parcels")
    predicted = p.select("oid", rules.text_class_or_default(F.col("generated_land_use")).alias("h"))
    truth = p.where(rules.is_valid_label(F.col("class_corrected_ui"))).select("oid", F.trim("class_corrected_ui").alias("c"), F.trim("subclass_corrected_ui").alias("s"))
    return predicted.join(truth, "oid").select("oid", (F.col("h.class_ui") == F.col("c")).alias("class_equal"), (F.col("h.subclass_ui") == F.col("s")).alias("subclass_equal"))


_TILES = "i AS (SELECT DISTINCT image_id FROM tiles), e AS (SELECT image_id, x, y FROM i, range(4) a(x), range(2) b(y)), l AS (SELECT image_id, x, y, max(status) AS status FROM tiles GROUP BY 1, 2, 3)"


def _tiles(spark, sf):
    t = bound(spark, sf, "tiles")
    images = t.select("image_id").distinct().select("image_id", F.lit(2048).alias("width"), F.lit(1000).alias("height"))
    return joins.expected_tiles(images), t.groupBy("image_id", "x", "y").agg(F.max("status").alias("status"))


@query(f"WITH {_TILES} SELECT e.image_id, CAST(e.x AS INT) AS x, CAST(e.y AS INT) AS y FROM e LEFT JOIN l ON e.image_id = l.image_id AND e.x = l.x AND e.y = l.y WHERE l.status IS NULL")
def j11_missing_tiles(spark, sf):
    e, t = _tiles(spark, sf)
    return e.join(t, ["image_id", "x", "y"], "left_anti")


@query("""WITH u AS (SELECT c_nationkey AS point_id, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE concat('u', c_custkey % 40) END AS url, 0 AS priority FROM customer UNION ALL SELECT s_nationkey, concat('u', s_suppkey % 60), 1 FROM supplier) SELECT point_id, url, min(priority) AS priority FROM u WHERE url <> '' GROUP BY 1, 2""")
def j12_provider_union(spark, sf):
    a = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_nationkey").alias("point_id"), F.when(F.col("c_custkey") % 10 == 0, "").otherwise(F.concat(F.lit("u"), (F.col("c_custkey") % 40).cast("string"))).alias("url"))
    b = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_nationkey").alias("point_id"), F.concat(F.lit("u"), (F.col("s_suppkey") % 60).cast("string")).alias("url"))
    return joins.first_provider([a, b])


# ---------------------------------------------------------------- aggregates and scores


@query("""WITH k AS (SELECT s.split, c.class_name FROM (SELECT unnest(['train', 'val']) AS split) s, (SELECT unnest(['natural_areas', 'low_density_degraded', 'underused_infrastructure', 'frozen_construction', 'active_construction', 'active_urban']) AS class_name) c)
    SELECT k.split, k.class_name, count(c.crop_id) AS n FROM k LEFT JOIN crops c ON c.split = k.split AND c.class_name = k.class_name GROUP BY 1, 2""")
def a1_class_counts(spark, sf):
    keys = dims(spark, ["train", "val"], "split").crossJoin(dims(spark, rules.CLASS_KEYS, "class_name"))  # 12 rows
    return metrics.zero_filled_counts(bound(spark, sf, "crops"), keys, ["split", "class_name"])


@query("SELECT class_name, count(*) AS n, count(DISTINCT object_id) AS objects FROM crops GROUP BY ROLLUP (class_name)")
def a8_totals(spark, sf):
    return metrics.totals(bound(spark, sf, "crops"))


@query("""WITH w AS (SELECT * FROM objects WHERE object_id NOT IN (SELECT object_id FROM panoramas))
    SELECT 'class' AS kind, class_name AS key, count(*) AS n, CAST(NULL AS VARCHAR) AS first FROM objects GROUP BY 2 UNION ALL SELECT 'total', NULL, count(*), NULL FROM objects UNION ALL SELECT 'season', season, count(*), NULL FROM panoramas GROUP BY 2
    UNION ALL SELECT 'without_panorama', NULL, (SELECT count(*) FROM w), (SELECT string_agg(object_id, ',' ORDER BY seq) FROM (SELECT * FROM w ORDER BY seq LIMIT 20))""")
def a2_raw_audit(spark, sf):
    return metrics.raw_audit(bound(spark, sf, "objects"), bound(spark, sf, "panoramas"))


_ISSUE = lambda key, where, what: f"SELECT 'issue' AS kind, '{key}' AS key, (SELECT count(*) FROM c WHERE {where}) AS n, (SELECT string_agg({what}, ',' ORDER BY seq) FROM (SELECT * FROM c WHERE {where} ORDER BY seq LIMIT 20)) AS first"


@query(f"""WITH c AS (SELECT seq, class_name, object_id, bearing, CASE WHEN seq % 11 > 0 THEN distance_m END AS d, image_path, concat('source/', seq % 50) AS source_path FROM crops)
    {_ISSUE('null_bearing', 'bearing IS NULL', 'object_id')} UNION ALL {_ISSUE('close_target_m', 'coalesce(d, 0) < 5', 'NULL::VARCHAR')} UNION ALL {_ISSUE('missing_source', 'seq % 9 = 0', 'source_path')} UNION ALL {_ISSUE('missing_crop', 'image_path NOT IN (SELECT image_path FROM annotations)', 'image_path')}
    UNION ALL SELECT 'class', class_name, count(*), NULL FROM c GROUP BY 2""")
def a3_sample_audit(spark, sf):
    c = bound(spark, sf, "crops").join(bound(spark, sf, "annotations").select("image_path", F.lit(True).alias("there")).distinct(), "image_path", "left")
    c = c.select("seq", "class_name", "object_id", "bearing", F.when(F.col("seq") % 11 > 0, F.col("distance_m")).alias("distance_m"), "image_path", F.concat(F.lit("source/"), (F.col("seq") % 50).cast("string")).alias("source_path"), (F.col("seq") % 9 != 0).alias("source_there"), F.coalesce("there", F.lit(False)).alias("crop_there"))
    return metrics.sample_audit(c)


@query("""SELECT count(*) AS samples, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(DISTINCT object_id) FILTER (split = 'train') AS train_objects, count(DISTINCT object_id) FILTER (split = 'val') AS val_objects,
    (SELECT count(*) FROM (SELECT object_id FROM samples WHERE split = 'train' INTERSECT SELECT object_id FROM samples WHERE split = 'val')) AS overlap FROM samples""")
def a4_dataset_info(spark, sf):
    return metrics.dataset_info(bound(spark, sf, "samples"))


@query("""SELECT class_name, CAST(sum(CASE seq % 4 WHEN 0 THEN least(seq % 3, 2) WHEN 1 THEN seq % 5 ELSE CASE WHEN seq % 8 = 2 THEN 1 ELSE 2 END END) AS BIGINT) AS panoramas FROM objects GROUP BY 1""")
def a5_panorama_counts(spark, sf):
    """Objects that know their seasons, or a total, or only whether there is a panorama, or of which only files are known."""
    seasons = F.map_filter(F.create_map(F.lit("summer"), F.lit(1), F.lit("winter"), F.lit(2)), lambda k, v: v <= F.col("seq") % 3)
    o = bound(spark, sf, "objects").select("class_name", F.when(F.col("seq") % 4 == 0, seasons).alias("panoramas_by_season"), F.when(F.col("seq") % 4 == 1, F.col("seq") % 5).alias("panoramas_total"), (F.col("seq") % 8 == 2).alias("has_panorama"), F.lit(2).alias("n_files"))
    return metrics.panorama_counts(o)


@query("""WITH c AS (SELECT class_name, count(*) AS n FROM objects GROUP BY 1), t AS (SELECT *, sum(n) OVER () AS total FROM c), g AS (SELECT *, CAST(total // 6 AS BIGINT) AS target FROM t), d AS (SELECT *, greatest(target - n, 0) AS need FROM g)
    SELECT class_name, n, target, need, round_even(100.0 * n / total, 4) AS share_pct, CASE WHEN need > 0 THEN 500 + greatest(500, 3 * need) ELSE 500 END AS next_limit, CASE WHEN need > 0 THEN 'deficit' ELSE 'ok' END AS status FROM d""")
def a6_deficit_plan(spark, sf):
    return metrics.deficit_plan(bound(spark, sf, "objects").groupBy("class_name").agg(F.count("*").alias("n")), "class_name", "n")


@query("""WITH i AS (SELECT class_name, seq, CASE seq % 3 WHEN 0 THEN '1024x768' WHEN 1 THEN '800x600' END AS size, CASE WHEN seq % 3 < 2 THEN seq * 10 END AS b FROM objects), z AS (SELECT class_name, size, count(*) AS n FROM i WHERE size IS NOT NULL GROUP BY 1, 2), y AS (SELECT class_name, string_agg(concat(size, ':', n), ',' ORDER BY concat(size, ':', n)) AS resolutions FROM z GROUP BY 1),
    x AS (SELECT class_name, count(*) AS items, count(*) FILTER (seq % 5 > 0) AS with_panorama, count(b) AS images, CAST(coalesce(sum(b), 0) AS BIGINT) AS total_bytes, round_even(coalesce(avg(b), 0), 4) AS avg_bytes FROM i GROUP BY 1) SELECT x.*, coalesce(resolutions, '') AS resolutions FROM x LEFT JOIN y ON x.class_name = y.class_name""")
def a7_image_statistics(spark, sf):
    n = F.col("seq") % 3
    o = bound(spark, sf, "objects").select("class_name", (F.col("seq") % 5 > 0).alias("has_panorama"), F.when(n == 0, 1024).when(n == 1, 800).alias("width"), F.when(n == 0, 768).when(n == 1, 600).alias("height"), F.when(n < 2, F.col("seq") * 10).alias("size_bytes"))
    return metrics.image_statistics(o)


@query("SELECT crop_id, image_path, 1e0 / count(*) OVER (PARTITION BY image_path) AS sample_weight FROM crops")
def a9_duplicate_weight(spark, sf):
    return ranking.duplicate_weight(bound(spark, sf, "crops").select("crop_id", "image_path"), "image_path")


@query("WITH c AS (SELECT class_name, CAST(count(*) AS DOUBLE) AS n FROM crops GROUP BY 1) SELECT class_name, round_even(sum(n) OVER () / (6 * greatest(n, 1)), 6) AS weight FROM c")
def a10_class_weights(spark, sf):
    return metrics.class_weights(bound(spark, sf, "crops"), "class_name", 6).withColumn("weight", F.bround("weight", 6))


_PRED = "SELECT seq, class_id AS truth, CASE WHEN seq % 3 = 0 THEN (class_id + seq) % 7 ELSE class_id END AS predicted FROM samples"


def _predicted(spark, sf):
    s = bound(spark, sf, "samples")
    return s.select("seq", F.col("class_id").alias("truth"), F.when(F.col("seq") % 3 == 0, (F.col("class_id") + F.col("seq")) % 7).otherwise(F.col("class_id")).alias("predicted"))


@query(f"WITH p AS ({_PRED}) SELECT round_even(avg(CASE WHEN truth = predicted THEN 1e0 ELSE 0 END), 4) AS accuracy FROM p")
def a11_accuracy(spark, sf):
    return _predicted(spark, sf).agg(metrics.accuracy(F.col("truth") == F.col("predicted")).alias("accuracy"))


_SCORES = f"p AS ({_PRED}), c AS (SELECT range AS class_id FROM range(12)), s AS (SELECT class_id, count(*) FILTER (truth = class_id AND predicted = class_id) AS tp, count(*) FILTER (truth <> class_id AND predicted = class_id) AS fp, count(*) FILTER (truth = class_id) AS support FROM c, p GROUP BY 1)"


@query(f"WITH {_SCORES} SELECT class_id, support, round_even(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round_even(coalesce(tp / nullif(support, 0), 0), 6) AS recall, round_even(coalesce(2 * tp / nullif(tp + fp + support, 0), 0), 6) AS f1 FROM s")
def a12_class_scores(spark, sf):
    s = metrics.class_scores(metrics.confusion(_predicted(spark, sf), "truth", "predicted"), spark.range(12).withColumnRenamed("id", "class_id"))
    return s.select("class_id", "support", *[F.bround(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"WITH {_SCORES} SELECT round_even(avg(coalesce(2 * tp / nullif(tp + fp + support, 0), 0)), 6) AS macro_f1, round_even(avg(coalesce(tp / nullif(support, 0), 0)), 6) AS macro_recall FROM s")
def a12_a15_macro(spark, sf):
    return metrics.macro(metrics.class_scores(metrics.confusion(_predicted(spark, sf), "truth", "predicted"), spark.range(12).withColumnRenamed("id", "class_id")))


@query(f"WITH p AS ({_PRED}) SELECT truth, " + ", ".join(f'count(*) FILTER (predicted = {i}) AS "{i}"' for i in range(10)) + " FROM p GROUP BY 1")
def a13_confusion(spark, sf):
    return metrics.confusion_matrix(_predicted(spark, sf), "truth", "predicted", list(range(10)))


@query(f"""WITH q AS (SELECT *, row_number() OVER (PARTITION BY truth ORDER BY md5(concat('42|', seq)), seq) AS r FROM ({_PRED})), p AS (SELECT * FROM q WHERE r <= 35), c AS (SELECT range AS class_id FROM range(12)), s AS (SELECT class_id, count(*) FILTER (truth = class_id AND predicted = class_id) AS tp, count(*) FILTER (truth <> class_id AND predicted = class_id) AS fp, count(*) FILTER (truth = class_id) AS support FROM c, p GROUP BY 1)
    SELECT round_even(avg(coalesce(2 * tp / nullif(tp + fp + support, 0), 0)), 6) AS balanced_macro_f1 FROM s""")
def a14_balanced_macro_f1(spark, sf):
    rows = ranking.per_class_sample(_predicted(spark, sf), "truth", "seq", 35, "42")
    return metrics.macro(metrics.class_scores(metrics.confusion(rows, "truth", "predicted"), spark.range(12).withColumnRenamed("id", "class_id"))).select(F.col("macro_f1").alias("balanced_macro_f1"))


@query("""WITH c AS (SELECT image_path, arg_max(class_name, seq) AS osm FROM crops GROUP BY 1) SELECT round_even(sum(CASE WHEN osm = vlm_label THEN 1e0 ELSE 0 END) / greatest(count(*), 1), 6) AS agreement, count(*) AS n FROM annotations a JOIN c ON a.image_path = c.image_path""")
def a19_source_agreement(spark, sf):
    r = joins.relabelled(bound(spark, sf, "crops"), bound(spark, sf, "annotations"), rules.CLASS_KEYS).where("osm_label IS NOT NULL")
    return r.agg(F.bround(F.coalesce(F.sum((F.col("osm_label") == F.col("class_name")).cast("double")), F.lit(0.0)) / F.greatest(F.count("*"), F.lit(1)), 6).alias("agreement"), F.count("*").alias("n"))


@query("SELECT round_even(quantile_cont(price, 0.03), 6) AS floor FROM crops")
def a21_percentile(spark, sf):
    return quality.sharpness_floor(bound(spark, sf, "crops").select(F.col("price").alias("sharpness"))).select(F.bround("floor", 6).alias("floor"))


_HARD = "contains(lower(generated_land_use), 'зелен') AND contains(lower(generated_land_use), 'двор') AND trim(class_corrected_ui) IN ('Природные территории', 'Активные городские территории') AND contains(lower(photos_ui), 'll=')"


@query(f"""{_HC} SELECT trim(class_corrected_ui) AS truth, count(*) AS total, count(*) FILTER (cls = trim(class_corrected_ui)) AS correct, round_even(count(*) FILTER (cls = trim(class_corrected_ui)) / count(*), 4) AS accuracy FROM p WHERE {_HARD} GROUP BY ROLLUP (trim(class_corrected_ui))""")
def a22_hard_case_score(spark, sf):
    """Per class of two, and in all (null)."""
    p = bound(spark, sf, "parcels").where(rules.is_hard_case(F.col("generated_land_use")) & (F.size(text.photo_coords(F.col("photos_ui"))) > 0)).withColumn("truth", F.trim("class_corrected_ui")).where(F.col("truth").isin(rules.NATURE, rules.URBAN))
    hit = rules.text_class_or_default(F.col("generated_land_use"))["class_ui"] == F.col("truth")
    return p.select("truth", hit.alias("hit")).rollup("truth").agg(F.count("*").alias("total"), F.count_if("hit").alias("correct"), metrics.accuracy(F.col("hit")).alias("accuracy"))


@query(f"{_HC} SELECT oid, substr(generated_land_use, 1, 80) AS text, cls AS predicted, trim(class_corrected_ui) AS truth FROM p WHERE trim(class_corrected_ui) NOT IN ('', 'nan', 'Категории нет') AND cls <> trim(class_corrected_ui) ORDER BY oid LIMIT 20")
def a23_first_errors(spark, sf):
    p = bound(spark, sf, "parcels").where(rules.is_valid_label(F.col("class_corrected_ui"))).select("oid", F.substring("generated_land_use", 1, 80).alias("text"), rules.text_class_or_default(F.col("generated_land_use"))["class_ui"].alias("predicted"), F.trim("class_corrected_ui").alias("truth"))
    return p.where("predicted <> truth").orderBy("oid").limit(20)


@query(f"""{_HC} SELECT count(*) AS total, count(*) FILTER (v) AS evaluated, count(*) FILTER (trim(class_corrected_ui) = 'Категории нет') AS no_category, round_even(coalesce(avg(CASE WHEN v THEN CASE WHEN cls = trim(class_corrected_ui) THEN 1e0 ELSE 0 END END), 0), 4) AS class_accuracy, round_even(coalesce(avg(CASE WHEN v THEN CASE WHEN sub = trim(subclass_corrected_ui) THEN 1e0 ELSE 0 END END), 0), 4) AS subclass_accuracy
    FROM (SELECT *, trim(class_corrected_ui) NOT IN ('', 'nan', 'Категории нет') AS v FROM p)""")
def a23_heuristic_report(spark, sf):
    p = bound(spark, sf, "parcels").withColumn("h", rules.text_class_or_default(F.col("generated_land_use")))
    v = rules.is_valid_label(F.col("class_corrected_ui"))
    return p.agg(F.count("*").alias("total"), F.count_if(v).alias("evaluated"), F.count_if(F.trim("class_corrected_ui") == rules.NO_CATEGORY).alias("no_category"), metrics.accuracy(F.when(v, F.col("h.class_ui") == F.trim("class_corrected_ui"))).alias("class_accuracy"), metrics.accuracy(F.when(v, F.col("h.subclass_ui") == F.trim("subclass_corrected_ui"))).alias("subclass_accuracy"))


@query("""WITH c AS (SELECT lower(trim(generated_land_use)) AS text, trim(class_corrected_ui) AS label, count(*) AS n FROM parcels WHERE trim(class_corrected_ui) NOT IN ('', 'nan', 'Категории нет') GROUP BY 1, 2)
    SELECT text, CAST(sum(n) AS BIGINT) AS n, count(*) AS classes, string_agg(concat(label, ':', n), '; ' ORDER BY concat(label, ':', n)) AS counts FROM c GROUP BY 1 HAVING count(*) > 1""")
def a24_text_ambiguity(spark, sf):
    p = bound(spark, sf, "parcels").where(rules.is_valid_label(F.col("class_corrected_ui")))
    return metrics.text_ambiguity(p, F.lower(F.trim("generated_land_use")), F.trim("class_corrected_ui"))


_RUNS = "r AS (SELECT user_id AS run, round_even(avg(value) / 1e2, 3) AS accuracy, round_even(max(value) / 1e3, 2) AS macro_f1, round_even(stddev_samp(value) / 1e2, 3) AS balanced_f1, CASE user_id % 2 WHEN 0 THEN 6 ELSE 3 END AS n_classes FROM events GROUP BY 1)"
_BEST = lambda policy, where, order: f"SELECT * FROM (SELECT '{policy}' AS policy, run, coalesce(accuracy >= 0.75 AND macro_f1 >= 0.60 AND balanced_f1 >= 0.70, false) AS on_target FROM r WHERE {where} ORDER BY {order}, run LIMIT 1)"


@query(f"""WITH {_RUNS} {_BEST('metrics', 'true', 'macro_f1 DESC, accuracy DESC')} UNION ALL {_BEST('parcels', 'true', 'CASE WHEN run % 3 = 0 THEN accuracy ELSE 0 END DESC, macro_f1 DESC')} UNION ALL {_BEST('checkpoint 6', 'n_classes = 6', 'CASE WHEN run % 5 > 0 THEN macro_f1 ELSE coalesce(balanced_f1, 0) END DESC')} UNION ALL {_BEST('checkpoint 3', 'n_classes = 3', 'accuracy DESC')}""")
def a25_a26_best_runs(spark, sf):
    """The best run by each policy, and whether it reaches all three targets."""
    e = spark.read.parquet(f"{sf}/events.parquet").groupBy(F.col("user_id").alias("run")).agg(F.bround(F.avg("value") / 100, 3).alias("accuracy"), F.bround(F.max("value") / 1000, 2).alias("macro_f1"), F.bround(F.stddev_samp("value") / 100, 3).alias("balanced_f1"))
    e = e.withColumns({"n_classes": F.when(F.col("run") % 2 == 0, 6).otherwise(3), "val_acc": F.col("accuracy"), "val_macro_f1": F.when(F.col("run") % 5 > 0, F.col("macro_f1")), "val_balanced_f1": F.col("balanced_f1"), "gpkg_acc": F.when(F.col("run") % 3 == 0, F.col("accuracy"))})
    parcels = e.withColumn("val_acc", F.col("macro_f1"))
    found = {"metrics": metrics.best_run(e, "metrics"), "parcels": metrics.best_run(parcels, "parcels"), "checkpoint 6": metrics.best_run(e, "checkpoint", 6), "checkpoint 3": metrics.best_run(e, "checkpoint", 3)}
    out = None
    for policy, row in found.items():
        row = row.select(F.lit(policy).alias("policy"), "run", F.coalesce(metrics.on_target(F.col("accuracy"), F.col("macro_f1"), F.col("balanced_f1")), F.lit(False)).alias("on_target"))
        out = row if out is None else out.unionByName(row)
    return out


@query(f"""WITH {_TILES}, c AS (SELECT e.image_id, count(*) AS expected, count(l.status) AS loaded, count(*) FILTER (l.status = 'black') AS black FROM e LEFT JOIN l ON e.image_id = l.image_id AND e.x = l.x AND e.y = l.y GROUP BY 1)
    SELECT *, expected - loaded AS failed, round_even((expected - loaded) / expected, 6) AS failed_share, (expected - loaded) / expected > 0.3 AS flagged FROM c""")
def a27_tile_completeness(spark, sf):
    return metrics.tile_report(*_tiles(spark, sf))


_SWEEP = "t AS (SELECT seq, class_id, s, list_transform(range(10), lambda i: (s / 20e0) * CAST(pixels[i + 1] AS DOUBLE) + (1 - s / 20e0) * CAST(pixels[i + 11] AS DOUBLE)) AS z FROM samples, range(21) r(s)), a AS (SELECT s AS step, round_even(avg(CASE WHEN list_position(z, list_max(z)) - 1 = class_id THEN 1e0 ELSE 0 END), 6) AS accuracy FROM t GROUP BY 1)"


def _sweep(spark, sf):
    s = bound(spark, sf, "samples").select("class_id", F.transform(F.slice("pixels", 1, 10), lambda x: x.cast("double")).alias("a"), F.transform(F.slice("pixels", 11, 10), lambda x: x.cast("double")).alias("b"))
    return metrics.weight_sweep(s, "a", "b", "class_id").withColumn("accuracy", F.bround("accuracy", 6)).withColumn("step", F.col("step").cast("long"))


@query(f"WITH {_SWEEP} SELECT step, accuracy FROM a")
def a28_j10_weight_sweep(spark, sf):
    return _sweep(spark, sf)


@query(f"WITH {_SWEEP} SELECT step, accuracy FROM a ORDER BY accuracy DESC, step LIMIT 1")
def a28_best_weight(spark, sf):
    return metrics.best_step(_sweep(spark, sf))
