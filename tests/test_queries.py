"""Registered queries against their SQL, and the invariants of those without."""

import datetime
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry
from landmosaic.plans.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLE = entry.oracle_sql()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (decimal.Decimal, float)):
        return None if v != v else round(float(v), 5) + 0.0
    return str(v) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n in ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    r = duck.sql(ORACLE[name])
    cols = sorted(df.columns)
    assert sorted(r.columns) == cols
    at = [r.columns.index(c) for c in cols]
    got = sorted((tuple(plain(x[c]) for c in cols) for x in df.collect()), key=repr)
    assert got == sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_cleaning_keeps_or_drops_every_row(spark):
    rows = QUERIES["g2_clean_dataset"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert len({r.seq for r in rows}) == len(rows)


def test_probe_learns(spark):
    rows = QUERIES["g8_linear_probe"](spark, SF).collect()
    assert len(rows) == 7 and all(0 <= r.accuracy <= 1 for r in rows)
    assert [r.accuracy for r in rows if r.is_best] == [max(r.accuracy for r in rows)]


@pytest.mark.parametrize("name", ["g6_heuristic_fill", "g7_parcel_classification", "a23_heuristic_report"])
def test_rules_stay_small_plans(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("CASE WHEN") < 80
