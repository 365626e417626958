"""Sums of long sessions by spans, against exact ones."""

import math
import random

from pyspark.sql import functions as F

from wayfold.operators import spans


def test_sums_of_long_sessions_are_the_nearest_doubles(spark):
    rng = random.Random(7)
    values = [rng.uniform(0, 9e5) for _ in range(6000)]
    df = spark.createDataFrame(list(enumerate(values)), "t long, v double").withColumn("k", F.lit(1))
    got = spans.running(spans.cut(df, "t", 700), ["k"], ["t"], {"s": F.col("v"), "n": F.lit(1).cast("long")}).orderBy("t").collect()
    assert [r.n for r in got] == list(range(1, len(values) + 1))
    off = [abs(r.s - math.fsum(values[: r.t + 1])) for r in got[::97] + got[-50:]]
    assert max(off) <= math.ulp(got[-1].s) and sum(x == 0 for x in off) > 0.9 * len(off)


def test_infinities_and_nulls_stay_in_sums(spark):
    rows = [(0, 1.5), (1, None), (2, math.inf), (3, 2.0), (4, math.nan)]
    df = spark.createDataFrame(rows, "t long, v double").withColumn("k", F.lit(1))
    got = [r.s for r in spans.running(spans.cut(df, "t", 2), ["k"], ["t"], {"s": F.col("v")}).orderBy("t").collect()]
    assert got[:4] == [1.5, 1.5, math.inf, math.inf] and math.isnan(got[4])
