"""Distance joins against brute force: everywhere on the globe, and in a cell that holds nearly all."""

import random
from math import asin, cos, radians, sin, sqrt

import pytest
from pyspark.sql import functions as F

from landmosaic.operators import joins, places


def apart(a, b):
    h = sin(radians(b[0] - a[0]) / 2) ** 2 + cos(radians(a[0])) * cos(radians(b[0])) * sin(radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371000 * asin(min(1, sqrt(h)))


def around(rng, lat, lon, metres):
    """A place about so far from another, the poles and the date line crossed as it comes."""
    dy, dx = rng.uniform(-1.5, 1.5) * metres / 111_000, rng.uniform(-1.5, 1.5) * metres / 111_000
    y = lat + dy
    if abs(y) > 90:
        y, lon = (180 if y > 0 else -180) - y, lon + 180
    x = lon + dx / max(cos(radians(min(89.9999, abs(lat)))), 1e-4)
    return y, (x + 180) % 360 - 180


def both(spark, circles, points):
    c = spark.createDataFrame([(i, *p) for i, p in enumerate(circles)] + [(-1, None, 0.0), (-2, 0.0, None), (-3, 95.0, 0.0)], "object_id long, lat double, lon double")
    p = spark.createDataFrame([(i, *p) for i, p in enumerate(points)] + [(-1, None, 0.0), (-2, float("nan"), 0.0)], "pano_id long, lat double, lon double")
    return c, p


CENTRES = [(0, 180), (0, -180), (10, 179.9999), (60, -179.9999), (-33, 12), (89.9995, 0), (89.9999, 77), (90, 0), (-90, 10), (-89.9997, -170), (89.99, 180), (0, 0), (45, 45), (-0.0001, 0.0001), (89.97, -180)]


@pytest.mark.parametrize("metres", [40.0, 900.0, 250_000.0])
@pytest.mark.parametrize("most", [2, 4000])
def test_pairs_everywhere(spark, metres, most):
    rng = random.Random(int(metres) + most)
    circles = [around(rng, *c, metres) for c in CENTRES for _ in range(5)]
    points = [around(rng, *c, metres) for c in CENTRES for _ in range(7)]
    want = sorted((i, j) for i, a in enumerate(circles) for j, b in enumerate(points) if apart(a, b) <= metres)
    got = sorted((r.object_id, r.pano_id) for r in joins.nearby(*both(spark, circles, points), metres, most).collect())
    assert want and got == want


def test_date_line(spark):
    c, p = both(spark, [(55.0, 179.9999)], [(55.0, -179.9999)])
    assert [round(r.distance_m) for r in joins.nearby(c, p, 30.0).collect()] == [13]


def test_a_full_cell_is_divided(spark):
    rng = random.Random(2)
    points = [(55 + rng.random() * 1e-3, 37 + rng.random() * 1e-3) for _ in range(1500)]
    circles = [(55 + rng.random() * 1e-3, 37 + rng.random() * 1e-3) for _ in range(40)]
    c, p = both(spark, circles, points)
    c, p = (x.withColumnsRenamed({"lat": f"{n}_lat", "lon": f"{n}_lon"}) for x, n in ((c, "c"), (p, "p")))
    celled, held = places._celled(c, p, 300.0, 100)
    sizes = [r["count"] for r in held.groupBy("level", "y", "x").count().collect()]
    assert max(sizes) <= 100 and sum(sizes) == 1500 and celled.groupBy("object_id", "level", "y", "x").count().where("count > 1").isEmpty()
    got = places.pairs_within(c, p, 20.0, 50).groupBy("object_id").count().collect()
    assert {r.object_id: r["count"] for r in got} == {i: n for i, a in enumerate(circles) if (n := sum(apart(a, b) <= 20 for b in points))}


def test_points_at_one_place(spark):
    c, p = both(spark, [(1.0, 1.0)] * 30, [(1.0, 1.0)] * 200)
    assert joins.nearby(c, p, 5.0, 20).count() == 6000


def test_any_within(spark):
    rng = random.Random(6)
    circles, points = [around(rng, *c, 100.0) for c in CENTRES for _ in range(4)], [around(rng, *c, 100.0) for c in CENTRES]
    c, p = (x.withColumnsRenamed({"lat": f"{n}_lat", "lon": f"{n}_lon"}) for x, n in zip(both(spark, circles, points), "cp", strict=True))
    got = {r.object_id for r in places.with_any_within(c, p, 60.0, 3).select("object_id").distinct().collect()}
    assert got == {i for i, a in enumerate(circles) if any(apart(a, b) <= 60 for b in points)}
    assert places.with_any_within(c, p.limit(0), 60.0).count() == 0 and places.pairs_within(c.where(F.lit(False)), p, 60.0).count() == 0
