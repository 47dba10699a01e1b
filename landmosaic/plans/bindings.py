"""The logical tables, derived from the driver's. One text serves Spark and, in the oracle queries, plain SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import place_in_files

CLASS_OF_SEGMENT = "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'natural_areas' WHEN 'BUILDING' THEN 'active_construction' WHEN 'FURNITURE' THEN 'frozen_construction' WHEN 'HOUSEHOLD' THEN 'low_density_degraded' ELSE 'active_urban' END"

BINDINGS = {
    "samples": """SELECT vec_id AS seq, concat('o', CAST(floor(vec_id / 8e0) AS BIGINT)) AS object_id, label AS class_id, concat('c', label) AS class_name,
        CASE WHEN vec_id % 5 = 0 THEN 'val' ELSE 'train' END AS split, vec_id % 3 = 0 AS multi_heading,
        concat('crops/c', label, '/v', vec_id, CASE WHEN vec_id % 3 = 0 THEN concat('_h', lpad(CAST(90 * (vec_id % 4) AS STRING), 3, '0')) ELSE '' END, '.jpg') AS image_path,
        embedding AS pixels FROM {embeddings}""",
    "objects": f"""SELECT concat('k', c_custkey) AS object_id, {CLASS_OF_SEGMENT} AS class_name, c_name AS name, c_custkey AS seq,
        55.5e0 + (c_custkey * 37 % 5000) / 1e4 AS lat, 37.3e0 + (c_custkey * 91 % 7000) / 1e4 AS lon FROM {{customer}}""",
    "crops": f"""SELECT o_orderkey AS seq, concat('k', o_custkey) AS object_id, {CLASS_OF_SEGMENT} AS class_name, o_orderdate AS taken,
        concat('crops/', o_orderkey % 5000, '.jpg') AS image_path, concat('r', o_orderkey) AS crop_id, o_totalprice AS price, 'train' AS split,
        CASE WHEN o_orderkey % 7 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(o_orderkey * 13 % 360 AS DOUBLE) END AS bearing,
        (o_orderkey * 7 % 100) / 4e0 AS distance_m FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey""",
    "panoramas": """SELECT event_id AS pano_id, 55.5e0 + (user_id * 37 % 5000) / 1e4 + (event_id % 7 - 3) / 1e5 AS lat, 37.3e0 + (user_id * 91 % 7000) / 1e4 + (event_id % 5 - 2) / 1e5 AS lon,
        ts, CASE event_id % 5 WHEN 0 THEN 'winter' WHEN 1 THEN 'spring' WHEN 2 THEN 'summer' WHEN 3 THEN 'autumn' ELSE 'unknown' END AS season, concat('k', user_id) AS object_id FROM {events}""",
    "votes": "SELECT user_id AS parcel_key, event_id AS view_index, event_type AS class_key, least(abs(value) / 1e2, 1e0) AS confidence FROM {events}",
    "parcels": """SELECT p_partkey AS oid, concat('p', p_partkey) AS parcel_key,
        CASE p_partkey % 16 WHEN 0 THEN 'Просто зелень (деревья во дворах и тд)' WHEN 1 THEN 'лесопарк чистая сцена' WHEN 2 THEN 'МКД, многоэтажная застройка' WHEN 3 THEN 'nan' WHEN 4 THEN 'Гаражи и парковки'
            WHEN 5 THEN 'завод, промышленная территория' WHEN 6 THEN 'прочие нежилые объекты' WHEN 7 THEN 'стройплощадка с краном' WHEN 8 THEN 'заброшенное здание' WHEN 9 THEN ' Дорога с зеленью и деревьями '
            WHEN 10 THEN 'детский сад и школа' WHEN 11 THEN 'торговый центр' WHEN 12 THEN 'замороженный скелет' WHEN 13 THEN 'ИЖС, частный сектор' WHEN 14 THEN '' ELSE 'xyz' END AS generated_land_use,
        CASE p_size % 9 WHEN 0 THEN 'Природные территории' WHEN 1 THEN 'Активные городские территории' WHEN 2 THEN 'Категории нет' WHEN 3 THEN 'nan' WHEN 4 THEN ' Активное строительство (стройплощадки) ' WHEN 5 THEN '' WHEN 6 THEN 'Недоиспользуемые инфраструктурные/городские зоны' WHEN 7 THEN 'Незавершенное/приостановленное строительство (стройка)' ELSE 'неизвестно' END AS class_corrected_ui,
        CASE p_size % 3 WHEN 0 THEN 'Парки и скверы' WHEN 1 THEN 'Жилая застройка с активностью' ELSE '' END AS subclass_corrected_ui,
        CASE WHEN p_partkey % 5 = 0 THEN 'Активные городские территории' WHEN p_partkey % 5 = 1 THEN 'Категории нет' ELSE '' END AS class_ui,
        CASE WHEN p_partkey % 10 = 0 THEN 'Жилая застройка с активностью' ELSE '' END AS subclass_ui, '' AS panorama_status_ui,
        CASE WHEN p_partkey % 3 = 0 THEN concat('/snapshots/ds/p', p_partkey, '/ https://maps.example.org/?ll=37.', lpad(CAST(p_partkey % 9000 AS STRING), 4, '0'), '%2C55.', lpad(CAST(p_partkey * 7 % 9000 AS STRING), 4, '0'), '&z=18')
             WHEN p_partkey % 3 = 1 THEN concat('https://maps.example.org/?LL=37.5,55.7 https://maps.example.org/?x=1&ll=37.5,55.7;https://img.example.org/', p_partkey, '.JPG?s=1') ELSE '' END AS photos_ui,
        37.3e0 + (p_partkey * 91 % 7000) / 1e4 AS lon, 55.5e0 + (p_partkey * 37 % 5000) / 1e4 AS lat, (p_size % 9 + 1) / 1e4 AS side FROM {part}""",
    "elements": """SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'relation' ELSE 'way' END AS type,
        CASE p_partkey % 9 WHEN 0 THEN 'forest' WHEN 1 THEN 'construction' WHEN 2 THEN 'residential' END AS landuse,
        CASE p_partkey % 7 WHEN 0 THEN 'apartments' WHEN 1 THEN 'commercial' WHEN 2 THEN 'abandoned' WHEN 3 THEN 'yes' END AS building,
        CASE p_partkey % 11 WHEN 0 THEN 'vacant' WHEN 1 THEN 'bakery' END AS shop, CASE p_partkey % 5 WHEN 0 THEN 'parking' WHEN 1 THEN 'cafe' END AS amenity,
        CASE p_partkey % 6 WHEN 0 THEN 'surface' WHEN 1 THEN 'garage_boxes' END AS parking, CASE p_partkey % 13 WHEN 0 THEN 'yes' END AS abandoned,
        CASE p_partkey % 17 WHEN 0 THEN 'park' WHEN 1 THEN 'nature_reserve' END AS leisure, CASE p_partkey % 19 WHEN 0 THEN 'wood' WHEN 1 THEN 'scrub' END AS nature, CASE p_partkey % 23 WHEN 0 THEN 'vacant' END AS office,
        CASE p_partkey % 29 WHEN 0 THEN 'bus_stop' WHEN 1 THEN 'primary_link' WHEN 2 THEN 'secondary' END AS highway, CASE p_partkey % 58 WHEN 0 THEN 'bus_stop' END AS disused_highway, CASE p_partkey % 37 WHEN 0 THEN 'yes' END AS construction,
        CASE p_partkey % 41 WHEN 0 THEN 'yes' END AS abandoned_building, CASE p_partkey % 43 WHEN 0 THEN 'house' END AS disused_building, CASE p_partkey % 47 WHEN 0 THEN 'yes' END AS disused, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS name,
        CASE WHEN p_partkey % 4 = 1 THEN 55.5e0 + (p_partkey % 500) / 1e3 END AS c_lat, CASE WHEN p_partkey % 4 = 1 THEN 37.3e0 + (p_partkey % 700) / 1e3 END AS c_lon,
        CASE WHEN p_partkey % 4 > 1 THEN 55.4e0 + (p_partkey % 700) / 1e3 END AS e_lat, CASE WHEN p_partkey % 4 > 1 THEN 37.3e0 + (p_partkey % 500) / 1e3 END AS e_lon FROM {part}""",
    "annotations": """SELECT concat('crops/', doc_id % 5000, '.jpg') AS image_path, CASE quality * 2 + toxic WHEN 0 THEN 'active_urban' WHEN 1 THEN 'meadow' WHEN 2 THEN 'natural_areas' ELSE 'frozen_construction' END AS vlm_label,
        CASE WHEN doc_id % 4 = 1 THEN CAST(NULL AS BOOLEAN) ELSE doc_id % 4 <> 0 END AS vlm_confident, concat(CASE WHEN toxic = 1 THEN 'Unsure: ' ELSE 'Answer: ' END, CASE WHEN quality = 1 THEN 'ACTIVE_CONSTRUCTION site' ELSE 'natural_areas' END, ' ', doc_id) AS raw FROM {labels}""",
    "corrections": """SELECT concat('p', user_id) AS parcel_key, event_id AS seq, concat('C', event_id % 5) AS class_ui, CASE WHEN event_id % 3 = 0 THEN concat('S', event_id % 3) END AS subclass_ui, concat('X', event_id % 4) AS class_corrected_ui,
        CASE WHEN event_id % 2 = 0 THEN 'Y' END AS subclass_corrected_ui, 'photo' AS photos_ui, CASE WHEN event_id % 4 = 0 THEN event_type END AS panorama_status_ui FROM {events}""",
    "tiles": "SELECT concat('i', l_orderkey) AS image_id, l_linenumber % 4 AS x, CAST(floor(l_linenumber / 4e0) AS INT) AS y, CASE l_returnflag WHEN 'R' THEN 'black' ELSE 'ok' END AS status FROM {lineitem}",
}


def bound(spark: SparkSession, sf_dir: str, name: str, line: str | None = None) -> DataFrame:
    """The logical table; line: with a column of that name, the place of each row in the table's files (of a single table)."""
    text = BINDINGS[name]
    of = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", text))}
    if line:
        ((t, df),) = of.items()
        of, text = {t: df.select("*", place_in_files().alias(line))}, text.replace(f" FROM {{{t}}}", f", {line} FROM {{{t}}}")
    return spark.sql(text, **of)


def oracle(body: str) -> str:
    """SQL in which the logical tables that the body names are common table expressions."""
    used = [n for n in BINDINGS if re.search(rf"\b{n}\b", body)]
    ctes = ", ".join(f"{n} AS ({re.sub(r'\{(\w+)\}', r'\1', BINDINGS[n])})" for n in used)
    body = body.strip()
    if not ctes:
        return body
    start = next((x for x in ("WITH RECURSIVE ", "WITH ") if body.upper().startswith(x)), "")
    return f"{start or 'WITH '}{ctes}{', ' if start else ' '}{body[len(start):]}"
