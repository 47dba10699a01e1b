"""Exact percentiles against numpy and DuckDB."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from landmosaic.operators import selection


@pytest.mark.parametrize("share", [0.0, 0.03, 0.5, 0.999, 1.0])
def test_percentiles_equal_numpy(spark, share):
    rng = random.Random(5)
    lists = [
        [rng.gauss(0, 1) for _ in range(999)], [float(rng.randrange(4)) for _ in range(500)], [-3.5], [1.0, 1e300, -1e300, 1e-300, 0.0, -0.0],
        [1 + k * 2**-52 for k in range(300)], [2.0**k for k in range(-1000, 1000, 7)], [7.0] * 400 + [8.0],
    ]
    for values in lists:
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "sharpness double")
        got = selection.exact_percentile(df, "sharpness", share)
        assert got == pytest.approx(float(np.percentile(values, share * 100)), rel=1e-12, abs=0)


def test_passes_are_few_on_ten_million_values(spark):
    df = spark.range(10_000_000).select((F.pmod(F.xxhash64("id"), F.lit(1 << 50)) / 1e7 - 3e7).alias("x"))
    value, less, passes = selection.order_statistic(df, 299_999)
    assert passes <= 6 and df.where(F.col("x") < value).count() == less <= 299_999 < df.where(F.col("x") <= value).count()


def test_percentile_equals_sql(spark):
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003 / 7.0).alias("sharpness"))
    want = duckdb.sql("SELECT quantile_cont(x, 0.03) FROM (SELECT (i * 7919 % 200003) / 7e0 AS x FROM range(200000) r(i))").fetchall()[0][0]
    assert selection.exact_percentile(df, "sharpness", 0.03) == pytest.approx(want, rel=1e-12)


def test_odd_values(spark):
    df = lambda v: spark.createDataFrame([(x,) for x in v], "x double")
    assert selection.exact_percentile(df([]), "x", 0.5) is None and selection.exact_percentile(df([None]), "x", 0.5) is None
    odd = df([math.nan, math.inf, -math.inf, 1.0, None])
    assert [selection.order_statistic(odd.where("x IS NOT NULL"), i)[0] for i in range(3)] == [-math.inf, 1.0, math.inf]
    assert math.isnan(selection.exact_percentile(odd, "x", 1.0))
