"""Ordered analytics by window expressions: distances, latches, steps, runs, decimation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.geo import haversine_m


def _sofar(keys: list[str], order: list):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def step_distance(keys: list[str], order: list) -> Column:
    """Metres from the previous row of the session; 0 for the first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    lat, lon = F.col("lat"), F.col("lon")
    return F.coalesce(haversine_m(F.lag(lat).over(w), F.lag(lon).over(w), lat, lon), F.lit(0.0))


def running_distance(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """``df`` with ``step_m`` and their running sum ``distance_m``."""
    return df.withColumn("step_m", step_distance(keys, order)).withColumn("distance_m", F.sum("step_m").over(_sofar(keys, order)))


def first_latch(value: Column, keys: list[str], order: list) -> Column:
    return F.first(value, ignorenulls=True).over(_sofar(keys, order))


def last_hold(value: Column, keys: list[str], order: list) -> Column:
    return F.last(value, ignorenulls=True).over(_sofar(keys, order))


def cumulative_mean(value: Column, keys: list[str], order: list) -> Column:
    return F.avg(value).over(_sofar(keys, order))


def detect_steps(df: DataFrame, keys: list[str], order: list, value: str, sensitivity: float) -> DataFrame:
    """``df`` with ``is_step``: the value rises above its running mean plus the sensitivity
    after it last was below the mean less it. The first row only sets the mean."""
    mean, w = cumulative_mean(F.col(value), keys, order), Window.partitionBy(*keys).orderBy(*order)
    edge = F.when(F.col(value) > F.col("_mean") + sensitivity, 1).when(F.col(value) < F.col("_mean") - sensitivity, 0)
    made = df.withColumn("_mean", mean).withColumn("_edge", edge)
    latched = F.coalesce(F.last("_edge", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return made.withColumn("is_step", F.coalesce((F.col("_edge") == 1) & (latched == 0), F.lit(False))).drop("_mean", "_edge")


def gyro_bias(df: DataFrame, keys: list[str], order: list, value: str, samples: int = 199) -> DataFrame:
    """``df`` with ``bias``: the running mean of the first ``samples`` rows, kept after."""
    made = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    used = F.when(F.col("_n") <= samples, F.col(value))
    return made.withColumn("bias", F.avg(used).over(_sofar(keys, order))).drop("_n")


def gyro_delta(df: DataFrame, keys: list[str], order: list, value: str, nanos: str, bias: str, dead: float = 0.0025) -> DataFrame:
    """``df`` with ``dt`` and ``delta``, the angle since the previous row: rates within
    ``dead`` of the bias count as nil, intervals of 0 or over 0.2 s as 0.01 s; the first
    row has none."""
    gap = (F.col(nanos) - F.lag(nanos).over(Window.partitionBy(*keys).orderBy(*order))).cast("double") / 1e9
    rate = F.col(value) - F.col(bias)
    made = df.withColumn("dt", F.when((gap <= 0) | (gap > 0.2), F.lit(0.01)).otherwise(gap))
    return made.withColumn("delta", F.coalesce(F.when(F.abs(rate) <= dead, F.lit(0.0)).otherwise(rate) * F.col("dt"), F.lit(0.0)))


def runs(df: DataFrame, keys: list[str], order: list, condition: Column) -> DataFrame:
    """``df`` with ``run_no`` (rows since the condition last failed share one) and
    ``run_rows``, how long it has held so far; 0 where it fails."""
    made = df.withColumn("_holds", F.coalesce(condition, F.lit(False)))
    made = made.withColumn("run_no", F.sum(F.when(F.col("_holds"), 0).otherwise(1)).over(_sofar(keys, order)))
    w = Window.partitionBy(*keys, "run_no").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return made.withColumn("run_rows", F.sum(F.when(F.col("_holds"), 1).otherwise(0)).over(w)).drop("_holds")


def standstill(df: DataFrame, keys: list[str], order: list, quiet: Column, dt: str, speed: str, least_s: float = 1.2, long_s: float = 2.5, slow: float = 1.2) -> DataFrame:
    """``df`` with ``still_s``, how long it has been quiet, and ``stationary``: quiet for
    ``least_s`` at a speed below ``slow``, or for ``long_s`` at any."""
    made = runs(df, keys, order, quiet)
    w = Window.partitionBy(*keys, "run_no").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    made = made.withColumn("still_s", F.sum(F.when(F.col("run_rows") > 0, F.col(dt)).otherwise(0.0)).over(w)).drop("run_no", "run_rows")
    return made.withColumn("stationary", (F.col("still_s") >= least_s) & ((F.col(speed) < slow) | (F.col("still_s") >= long_s)))


def interval(gap: Column, kind: str) -> Column:
    """Seconds since the previous sample, guarded: ``glitch`` takes gaps of 0 or over 0.2 s for
    0.01, ``clamp`` keeps them within 0.001 and 0.2 (the first is 0.01), ``elapsed`` counts
    those between 0 and 5 only."""
    return {
        "glitch": F.when(gap.isNull() | (gap <= 0) | (gap > 0.2), 0.01).otherwise(gap),
        "clamp": F.when(gap.isNull(), 0.01).otherwise(F.greatest(F.lit(0.001), F.least(F.lit(0.2), gap))),
        "elapsed": F.when((gap > 0) & (gap < 5), gap).otherwise(0.0),
    }[kind]


def mount_heading(yaw: Column, keys: list[str], order: list) -> Column:
    """Heading of the vehicle: the yaw less what it was at first."""
    return ((yaw - first_latch(yaw, keys, order)) % 360 + 360) % 360


def stride_decimate(df: DataFrame, keys: list[str], order: list, time_ms: str, most: int = 20_000, per_second: float = 5.0) -> DataFrame:
    """Every k-th row of a session: k is rows over ``most``, and for spans over a second at
    least rows over ``per_second`` a second."""
    own = Window.partitionBy(*keys)
    made = df.withColumn("_n", F.count("*").over(own)).withColumn("_s", (F.max(time_ms).over(own) - F.min(time_ms).over(own)).cast("double") / 1000)
    plain = F.greatest(F.lit(1), F.floor(F.col("_n") / most))
    stride = F.when(F.col("_s") > 1, F.greatest(plain, F.floor(F.try_divide(F.col("_n").cast("double"), F.col("_s") * per_second)))).otherwise(plain)
    place = F.row_number().over(own.orderBy(*order)) - 1
    return made.withColumn("_k", stride).withColumn("_i", place).where("_i % _k = 0").drop("_n", "_s", "_k", "_i")


def tail(df: DataFrame, keys: list[str], order_desc: list, most: int = 10_000) -> DataFrame:
    """The last rows of each session."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order_desc))).where(F.col("_r") <= most).drop("_r")


def chunk_retained(df: DataFrame, keys: list[str], order_desc: list, most: int, chunk: int) -> DataFrame:
    """What a buffer keeps that drops its oldest ``chunk`` rows whenever it exceeds ``most``."""
    own = Window.partitionBy(*keys)
    made = df.withColumn("_n", F.count("*").over(own)).withColumn("_r", F.row_number().over(own.orderBy(*order_desc)))
    left = F.when(F.col("_n") <= most, F.col("_n")).otherwise(most + 1 - chunk + (F.col("_n") - most - 1) % chunk)
    return made.where(F.col("_r") <= left).drop("_n", "_r")


def rates(df: DataFrame, keys: list[str], time_ms: str, width_ms: int = 1000) -> DataFrame:
    """Rows and rate in Hz of each window of time."""
    slot = (F.floor(F.col(time_ms) / width_ms) * width_ms).cast("long")
    made = df.groupBy(*keys, slot.alias("window_ms")).agg(F.count("*").alias("n"))
    return made.withColumn("hz", F.col("n") * 1000.0 / width_ms)


def strapdown(df: DataFrame, keys: list[str], order: list, dt: str, east: str, north: str) -> DataFrame:
    """Baseline inertial navigation: world accelerations summed to velocity, then to place.
    Adds ``vel_east``, ``vel_north``, ``x_east``, ``y_north`` and ``confidence_m``."""
    w = _sofar(keys, order)
    made = df.withColumns({"vel_east": F.sum(F.col(east) * F.col(dt)).over(w), "vel_north": F.sum(F.col(north) * F.col(dt)).over(w)})
    made = made.withColumns({"x_east": F.sum(F.col("vel_east") * F.col(dt)).over(w), "y_north": F.sum(F.col("vel_north") * F.col(dt)).over(w)})
    return made.withColumn("confidence_m", 2 + 0.5 * F.sum(dt).over(w))
