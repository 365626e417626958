"""Numbers as texts, against printf of DuckDB."""

import math

import duckdb

from wayfold.operators import evaluate

VALUES = [0.35, 12.25, 12.35, 2.255, 11.305, 0.125, 0.375, 1.005, 0.0, -0.05, -2.25, 99.995, 1234567.25, 1234567.125, 3.0]


def test_halves_round_as_in_sql(spark):
    df = spark.createDataFrame([(v,) for v in VALUES], "v double")
    got = df.select("v", evaluate.metres_text(df.v).alias("m"), evaluate.metres_text(df.v, 0).alias("m0"), evaluate.percent_text(df.v).alias("p")).collect()
    for r in got:
        want = duckdb.execute("SELECT printf('%.1f m', $1::DOUBLE), printf('%.0f m', $1::DOUBLE), printf('%.2f%%', $1::DOUBLE)", [r.v]).fetchone()
        assert (r.m, r.m0, r.p) == want, r.v


def test_missing_numbers(spark):
    df = spark.createDataFrame([(math.nan,), (None,)], "v double")
    assert [tuple(r) for r in df.select(evaluate.metres_text(df.v), evaluate.percent_text(df.v)).collect()] == [("—", "—"), (None, None)]
