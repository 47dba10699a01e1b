import math

import pytest
from pyspark.sql import functions as F

from landmosaic.functions import core, geo, rules, text, vectors


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()[0]


@pytest.mark.parametrize(("lat", "lon", "want"), [(56.0, 37.0, 0.0), (55.0, 38.0, 90.0), (54.0, 37.0, 180.0), (55.0, 36.0, 270.0)])
def test_bearing_points(spark, lat, lon, want):
    got = one(spark, geo.bearing(F.lit(55.0), F.lit(37.0), F.lit(lat), F.lit(lon)))
    assert abs(got - want) < 0.5 or abs(got - want) > 359.5


def test_distance_and_destination_agree(spark):
    p = one(spark, geo.destination(F.lit(55.0), F.lit(179.9999), F.lit(90.0), F.lit(1000.0)))
    assert -180 <= p["lon"] < 180
    assert math.isclose(one(spark, geo.distance(F.lit(55.0), F.lit(179.9999), F.lit(p["lat"]), F.lit(p["lon"]))), 1000, rel_tol=1e-6)


def test_coincident_camera_has_no_bearing(spark):
    r = one(spark, geo.classification_region(F.lit(55.0), F.lit(37.0), F.lit(55.000001), F.lit(37.0)))
    assert r["bearing_geographic_deg"] is None and r["notes"]


def test_boundary_points_stand_outside_and_look_inside(spark):
    ring = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in ((37.0, 55.0), (37.001, 55.0), (37.001, 55.001), (37.0, 55.001), (37.0, 55.0))])
    points = one(spark, geo.merged_points(geo.boundary_points(ring, F.lit(55.0005), F.lit(37.0005))))
    assert len(points) == 4
    for p in points:
        assert not (37.0 < p["lon"] < 37.001 and 55.0 < p["lat"] < 55.001)
    assert [p["edge"] for p in points] == sorted((p["edge"] for p in points), reverse=True)
    short = one(spark, geo.boundary_points(F.slice(ring, 1, 3), F.lit(55.0), F.lit(37.0)))
    assert short == []


def test_interior_point_is_inside(spark):
    df = spark.createDataFrame([([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0), (0.0, 0.0)],), ([(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)],)], "ring array<struct<lon: double, lat: double>>")
    a, b = geo.interior_points(df).collect()
    assert 0 < a.i_lon < 4 and 0 < a.i_lat < 4
    assert b.i_lon is None


@pytest.mark.parametrize(("said", "want"), [("лесопарк чистая сцена", rules.FORESTS), ("Дорога с зеленью и деревьями", rules.ROADSIDE), ("Гаражи и парковки", rules.PARKS), ("завод, промышленная", rules.WATER), ("nan", ""), (None, ""), ("xyz", "")])
def test_text_rules_keep_their_side_effects(spark, said, want):
    assert one(spark, rules.text_class(F.lit(said).cast("string")))["subclass_ui"] == want


def test_defaults_and_refinement(spark):
    assert one(spark, rules.text_class_or_default(F.lit("")))["class_ui"] == rules.DEFAULT_CLASS
    assert one(spark, rules.refined_subclass(F.lit("natural_areas"), F.lit("просто зелень (деревья во дворах и тд)"), F.lit("d"))) == "d"
    assert one(spark, rules.analyst_key(F.lit(" Активное строительство "))) == "active_construction"
    assert one(spark, rules.analyst_key(F.lit("Категории нет"))) is None
    assert one(spark, rules.label_of(F.lit(None).cast("string"))) == rules.DEFAULT_CLASS


def test_emptiness(spark):
    for v, want in ((None, True), ("", True), (" nan ", True), ("a", False)):
        assert one(spark, core.is_empty(F.lit(v).cast("string"))) is want


def test_links(spark):
    cell = "https://a.example/?ll=37.5,55.7 https://b.example/?x=1&LL=37.5%2C55.7 https://c.example/?ll=-1.25,2"
    assert [tuple(p) for p in one(spark, text.photo_coords(F.lit(cell)))] == [(37.5, 55.7), (-1.25, 2.0)]
    assert one(spark, text.photo_coords(F.lit(None).cast("string"))) == []
    assert one(spark, text.gallery_of(F.lit("x /snapshots/a/b/ y"))) == "/snapshots/a/b/"


def test_location_tokens_round_trip(spark):
    tokens = one(spark, text.location_tokens(F.lit(0.1), F.lit(0.2), F.lit(0.5), F.lit(1.2)))
    assert tokens == "<loc0205><loc0102><loc1023><loc0512>"
    assert one(spark, text.location_boxes(F.lit(tokens))) == [[round(v / 1023, 4) for v in (102, 205, 512, 1023)]]
    assert one(spark, text.location_boxes(F.lit("<loc0001>"))) == []


def test_average_hash_and_hamming(spark):
    a = F.array(*[F.lit(float(i % 2)) for i in range(64)])
    b = F.array(*[F.lit(float((i + 1) % 2)) for i in range(64)])
    assert one(spark, vectors.average_hash(a)) & ((1 << 64) - 1) == int("01" * 32, 2)
    assert one(spark, vectors.hamming(vectors.average_hash(a), vectors.average_hash(b))) == 64


def test_perspective_looks_where_it_should():
    import numpy as np

    image = np.zeros((8, 16, 3), np.uint8)
    image[:, 12:] = 200  # the right quarter: headings from 90 to 180
    assert vectors.perspective_view(image, 135.0, 0.0, 30.0, 4, 4).mean() > 190
    assert vectors.perspective_view(image, -90.0, 0.0, 30.0, 4, 4).mean() < 10


def test_half_even(spark):
    assert [one(spark, core.half_even(F.lit(v))) for v in (0.5, 1.5, 2.5)] == [0, 2, 2]


def test_emptiness_and_filling(spark):
    from landmosaic.functions import core

    rows = [("", "NaN", ""), ("\t\n", "x", "x"), (None, " y ", "y"), ("nan", "NAN", "nan"), ("own", "z", "own"), (" ", None, " "), ("\u00a0", "q", "q")]
    df = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "i int, t string, s string")
    got = {r.i: r.v for r in df.select("i", core.fill_if_empty(F.col("t"), F.col("s")).alias("v")).collect()}
    assert got == {i: r[2] for i, r in enumerate(rows)}


def test_columns_are_filled_and_kept(spark):
    from landmosaic.sources import tables

    df = spark.createDataFrame([("x", None, 1, "k1"), ("", "B", 2, "k2"), ("", "C", 3, "k3")], "class_ui string, utt_class string, oid int, status string")
    got = sorted((r.oid, r.class_ui, r.status, r.parcel_key, r.photos_ui) for r in tables.normalised(df).collect())
    assert got == [(1, "x", "k1", "1", ""), (2, "B", "k2", "2", ""), (3, "C", "k3", "3", "")]
    assert sorted(r.oid for r in tables.normalised(df.drop("oid")).collect()) == [1, 2, 3]
    assert tables.without_private(df.withColumn("_a", F.lit(1))).columns == df.columns


def test_objects_in_a_wrong_folder(spark, tmp_path):
    from landmosaic.sources import tables

    for folder, said in (("parks", "parks"), ("roads", "parks")):
        (tmp_path / folder / "o").mkdir(parents=True)
        (tmp_path / folder / f"{folder}.json").write_text('{\n"id": "%s",\n"class": "%s"}' % (folder, said))
    rows = tables.read_objects(spark, str(tmp_path))
    assert {(r.id, r.folder_class) for r in rows.collect()} == {("parks", "parks"), ("roads", "roads")}
    with pytest.raises(ValueError, match="roads"):
        tables.checked_objects(rows)


def test_late_corrections_do_not_win(spark, tmp_path):
    from landmosaic.streaming import jobs

    cols = "parcel_key string, class_ui string, subclass_ui string, class_corrected_ui string, subclass_corrected_ui string, photos_ui string, panorama_status_ui string"
    parcels = spark.createDataFrame([("a", *"12345", "s"), ("b", *"12345", "s")], cols)
    for seq, word in ((5, "new"), (2, "old"), (7, "newest"), (6, "late")):
        spark.createDataFrame([("a", word, None, word, None, None, None, seq)], f"{cols}, seq long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(f"{cols}, seq long").parquet(f"{tmp_path}/in")
        jobs.upsert_corrections(stream, f"{tmp_path}/out", f"{tmp_path}/cp")
    got = {r.parcel_key: r.class_ui for r in jobs.latest(parcels, f"{tmp_path}/out").collect()}
    assert got == {"a": "newest", "b": "1"}


def test_crops_are_labelled_once(spark, tmp_path):
    from landmosaic.streaming import jobs

    for part in (["a", "b", "b"], ["b", "c", None]):
        spark.createDataFrame([(x, "natural_areas") for x in part], "image_path string, raw string").write.mode("append").parquet(f"{tmp_path}/in")
        jobs.ingest_answers(spark.readStream.schema("image_path string, raw string").parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert sorted((r.image_path, r.batch) for r in jobs.ingested(spark, f"{tmp_path}/out").collect()) == [("a", 0), ("b", 0), ("c", 1)]


def test_images_that_do_not_fit_their_size_have_no_views(spark):
    rows = spark.createDataFrame([("a", b"\x07" * 96, 8, 4), ("b", b"\x07" * 95, 8, 4), ("c", None, 8, 4), ("d", b"", 0, 0), (None, b"\x09" * 96, 8, 4)], "image_path string, rgb binary, width int, height int")
    got = sorted(((r.image_path, r.heading, r.pitch, bytes(r.rgb)) for r in vectors.perspective_views(rows, [0, 90], [0, 10], 90.0, 2, 3).collect()), key=repr)
    assert got == sorted([(n, h, p, bytes([v]) * 18) for n, v in (("a", 7), (None, 9)) for h in (0.0, 90.0) for p in (0.0, 10.0)], key=repr)
    assert vectors.sampling_map.cache_info().maxsize == vectors.MAPS
