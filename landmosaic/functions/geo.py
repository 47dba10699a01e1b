"""Distances, bearings, rings and view points, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6_371_000.0  # metres
COINCIDENT, OFFSET, MIN_EDGE, MERGE, MOST = 2.0, 22.0, 4.0, 12.0, 14


def distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * RADIUS) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in degrees, 0 to 360."""
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def destination(lat: Column, lon: Column, degrees: Column, metres: Column) -> Column:
    """struct(lat, lon) reached; the longitude from -180 to under 180."""
    p, b, d = F.radians(lat), F.radians(degrees), metres / RADIUS
    p2 = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b))
    l2 = F.radians(lon) + F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(p2))
    return F.struct(F.degrees(p2).alias("lat"), (F.pmod(F.degrees(l2) + 540, F.lit(360.0)) - 180).alias("lon"))


def capture_position(by_season: Column, season: Column, lat: Column, lon: Column) -> Column:
    """struct(lat, lon) of a panorama: its season's entry in map<season, struct<lat, lon>>; of the default season (null) the
    map's first entry; where that isn't there or not whole, the object's own place."""
    whole = lambda p: F.when(p["lat"].isNotNull() & p["lon"].isNotNull(), F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    first = F.get(F.map_values(by_season), F.lit(0))
    return F.coalesce(F.when(season.isNotNull(), whole(F.element_at(by_season, season))).otherwise(whole(first)), F.struct(lat.alias("lat"), lon.alias("lon")))


def classification_region(cam_lat: Column, cam_lon: Column, lat: Column, lon: Column, fov: float = 90.0) -> Column:
    """Where an object is seen from its camera; a camera on the object has no bearing."""
    d = distance(cam_lat, cam_lon, lat, lon)
    near = d < COINCIDENT
    return F.struct(
        F.when(~near, F.bround(bearing(cam_lat, cam_lon, lat, lon), 4)).alias("bearing_geographic_deg"),
        F.lit(fov).alias("fov_deg"),
        F.struct(cam_lat.alias("lat"), cam_lon.alias("lon")).alias("panorama"),
        F.struct(lat.alias("lat"), lon.alias("lon")).alias("label_target_osm"),
        F.bround(d, 2).alias("distance_m_approx"),
        F.when(near, F.lit("camera and object coincide")).alias("notes"),
    )


def ring_area(ring: Column) -> Column:
    """Shoelace area of array<struct<lon, lat>>, in square degrees."""
    pairs = F.arrays_zip(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))).alias("a"), F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))).alias("b"))
    return F.abs(F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["a"]["lon"] * p["b"]["lat"] - p["b"]["lon"] * p["a"]["lat"])) / 2


def exterior_ring(rings: Column) -> Column:
    """The ring with the largest area."""
    return F.array_max(F.transform(rings, lambda r: F.struct(ring_area(r).alias("area"), r.alias("ring"))))["ring"]


def bound_to(value: Column, f) -> Column:
    """f(value), with value worked out once however often f uses it."""
    return F.transform(F.array(value), f)[0]


def boundary_points(ring: Column, lat: Column, lon: Column, offset: float = OFFSET, least: float = MIN_EDGE) -> Column:
    """array<struct<edge_index, edge, lon, lat, bearing_deg>>: for each edge of at least `least` metres, the point `offset`
    metres out of its middle, on the side that isn't nearer to the target, looking at the target. Spark functions only."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    edges = F.arrays_zip(F.slice(ring, 1, n).alias("a"), F.slice(ring, 2, n).alias("b"), F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))).alias("i"))

    def measured(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return F.struct(e["i"].alias("i"), ((a["lat"] + b["lat"]) / 2).alias("lat"), ((a["lon"] + b["lon"]) / 2).alias("lon"), distance(a["lat"], a["lon"], b["lat"], b["lon"]).alias("edge"), bearing(a["lat"], a["lon"], b["lat"], b["lon"]).alias("along"))

    def sided(e: Column) -> Column:
        turned = [destination(e["lat"], e["lon"], F.pmod(e["along"] + t, F.lit(360.0)), F.lit(offset)).alias(name) for t, name in ((90.0, "right"), (-90.0, "left"))]
        return F.struct(e["i"].alias("i"), e["edge"].alias("edge"), distance(e["lat"], e["lon"], lat, lon).alias("mine"), *turned)

    def chosen(e: Column) -> Column:
        out = lambda p: F.when(distance(p["lat"], p["lon"], lat, lon) >= e["mine"], p)
        return F.struct(e["i"].alias("i"), e["edge"].alias("edge"), F.coalesce(out(e["right"]), out(e["left"])).alias("p"))

    def seen(e: Column) -> Column:
        p = e["p"]
        return F.struct(e["i"].alias("edge_index"), e["edge"].alias("edge"), F.bround(p["lon"], 6).alias("lon"), F.bround(p["lat"], 6).alias("lat"), F.bround(bearing(p["lat"], p["lon"], lat, lon), 1).alias("bearing_deg"))

    long = F.filter(F.transform(edges, measured), lambda e: e["edge"] >= least)
    found = F.transform(F.filter(F.transform(F.transform(long, sided), chosen), lambda e: e["p"].isNotNull()), seen)
    centre = F.array(F.struct(F.lit(0).alias("edge_index"), F.lit(0.0).alias("edge"), F.bround(lon, 6).alias("lon"), F.bround(lat, 6).alias("lat"), F.lit(None).cast("double").alias("bearing_deg")))
    return F.when(F.size(ring) < 4, F.slice(centre, 1, 0)).otherwise(bound_to(found, lambda x: F.when(F.size(x) > 0, x).otherwise(centre)))


def nearest_edge(ring: Column, lat: Column, lon: Column) -> Column:
    """The index of the edge of array<struct<lon, lat>> whose middle is nearest to a point; the first on ties."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    edges = F.arrays_zip(F.slice(ring, 1, n).alias("a"), F.slice(ring, 2, n).alias("b"))
    to = lambda e: distance(lat, lon, (e["a"]["lat"] + e["b"]["lat"]) / 2, (e["a"]["lon"] + e["b"]["lon"]) / 2)
    return F.array_min(F.transform(edges, lambda e, i: F.struct(to(e).alias("d"), i.alias("i"))))["i"]


def merged_points(points: Column, near: float = MERGE, most: int = MOST) -> Column:
    """Points that aren't within `near` metres of one kept before; the `most` with the longest edges, in that order."""

    def kept(all_: Column) -> Column:
        return F.aggregate(all_, F.slice(all_, 1, 0), lambda out, p: F.when(F.exists(out, lambda q: distance(q["lat"], q["lon"], p["lat"], p["lon"]) < near), out).otherwise(F.concat(out, F.array(p))))

    order = F.array_sort(F.transform(bound_to(points, kept), lambda p, i: F.struct((-p["edge"]).alias("k"), i.alias("i"), p.alias("p"))))
    return F.transform(F.slice(order, 1, most), lambda x: x["p"])


def interior_points(rows, ring: str = "ring"):
    """rows with (i_lon, i_lat), a point inside the exterior ring array<struct<lon, lat>>: the middle of the widest stretch
    that a horizontal line between two neighbouring heights has inside. numpy, a batch at a time; null for rings without area."""
    import numpy as np

    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, i_lon double, i_lat double"

    def point(r) -> tuple[float | None, float | None]:
        p = np.array([(q["lon"], q["lat"]) for q in r], float).reshape(-1, 2)
        heights = np.unique(p[:, 1])
        if len(p) < 4 or len(heights) < 2:
            return None, None
        gaps = np.diff(heights)
        y = heights[np.argmax(gaps)] + gaps.max() / 2
        a, b = p[:-1], p[1:]
        cross = (a[:, 1] > y) != (b[:, 1] > y)
        x = np.sort(a[cross, 0] + (y - a[cross, 1]) / (b[cross, 1] - a[cross, 1]) * (b[cross, 0] - a[cross, 0]))
        if len(x) < 2:
            return None, None
        k = int(np.argmax(x[1::2] - x[: len(x) // 2 * 2 : 2])) * 2
        return float((x[k] + x[k + 1]) / 2), float(y)

    def run(frames):
        for f in frames:
            found = [point(r) for r in f[ring]]
            yield f.assign(i_lon=[a for a, _ in found], i_lat=[b for _, b in found])

    return rows.mapInPandas(run, schema)
