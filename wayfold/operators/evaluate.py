"""Scoring of estimated tracks against true ones, and the export tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions.geo import drift_percent, haversine_m
from wayfold.operators.asof import nearest_in_time
from wayfold.operators.ordered import running_distance, stride_decimate


def matched(gps: DataFrame, dr: DataFrame, gate_ms: int, inner: bool = True) -> DataFrame:
    """Fixes with the nearest estimate and the distance to it, ``error_m``."""
    made = nearest_in_time(gps, dr, ["session_id"], "t_ms", ["lat", "lon"], gate_ms, inner=inner, order="event_id")
    return made.withColumn("error_m", haversine_m(F.col("lat"), F.col("lon"), F.col("m_lat"), F.col("m_lon")))


def session_stats(gps: DataFrame, dr: DataFrame, gate_ms: int) -> DataFrame:
    """Per session: last, largest and mean error of matched fixes, path length over all
    fixes, drift in percent. Sessions without a match have NaN errors."""
    nan, order = F.lit(math.nan), F.struct("t_ms", "event_id")
    errors = matched(gps, dr, gate_ms).groupBy("session_id").agg(F.max_by("error_m", order).alias("final"), F.max("error_m").alias("worst"), F.avg("error_m").alias("mean"), F.count("*").alias("n"))
    paths = running_distance(gps, ["session_id"], ["t_ms", "event_id"]).groupBy("session_id").agg(F.sum("step_m").alias("distance_travelled_m"))
    made = paths.join(errors, "session_id", "left").withColumn("final_error_m", F.coalesce("final", nan))
    return made.select(
        "session_id", F.coalesce("n", F.lit(0)).alias("matches"), F.col("final_error_m").alias("current_error_m"), "final_error_m", F.coalesce("worst", nan).alias("max_error_m"), F.coalesce("mean", nan).alias("mean_error_m"),
        "distance_travelled_m", drift_percent(F.col("final_error_m"), F.col("distance_travelled_m")).alias("drift_pct"),
    )


def nav_table(gps: DataFrame, dr: DataFrame, gate_ms: int) -> DataFrame:
    """Export rows: every fix with its match, then the decimated estimates. An error that is
    undefined is NaN in the first and null in the second."""
    nan = F.lit(math.nan)
    first = running_distance(matched(gps, dr, gate_ms, inner=False), ["session_id"], ["t_ms", "event_id"])
    error = F.coalesce("error_m", nan)
    first = first.select("session_id", F.lit("gps").alias("row_kind"), "t_ms", "event_id", F.col("lat").alias("gps_lat"), F.col("lon").alias("gps_lon"), F.col("m_lat").alias("dr_lat"), F.col("m_lon").alias("dr_lon"), error.alias("position_error_m"), "distance_m", drift_percent(error, F.col("distance_m")).alias("drift_pct"))
    second = running_distance(stride_decimate(dr, ["session_id"], ["t_ms", "event_id"], "t_ms"), ["session_id"], ["t_ms", "event_id"])
    none = F.lit(None).cast("double")
    second = second.select("session_id", F.lit("dr").alias("row_kind"), "t_ms", "event_id", none.alias("gps_lat"), none.alias("gps_lon"), F.col("lat").alias("dr_lat"), F.col("lon").alias("dr_lon"), none.alias("position_error_m"), "distance_m", none.alias("drift_pct"))
    return first.unionByName(second)


#: The columns of the export of motion samples and of engine states.
IMU_COLUMNS = (
    "timestamp_nanos accel_x accel_y accel_z gyro_x gyro_y gyro_z mag_x mag_y mag_z quat_x quat_y quat_z quat_w "
    "linear_x linear_y linear_z gravity_x gravity_y gravity_z"
).split()
STATE_COLUMNS = (
    "timestamp_nanos acc_mag step_detected stride_length gyro_heading_rad mag_heading_rad fused_heading_rad dr_x_east dr_y_north dr_lat dr_lon "
    "forward_speed_mps yaw_rate_deg_s lateral_vel_mps snap_mode bias_omega_mag bias_acc_mag nhc_residual_lat"
).split()


def imu_table(samples: DataFrame) -> DataFrame:
    """Export rows of raw motion samples; a sensor that was absent is null."""
    return samples.select("session_id", *IMU_COLUMNS)


def state_table(states: DataFrame) -> DataFrame:
    """Export rows of engine states (columns of ``STATE_COLUMNS``), steps as 1 and 0."""
    return states.withColumn("step_detected", F.col("step_detected").cast("int")).select("session_id", *STATE_COLUMNS)


def live_snapshot(gps: DataFrame, dr: DataFrame, gate_ms: int) -> DataFrame:
    """What a live view shows of each session: the last fix and estimate, how many there
    are, what the view follows (the fix, else the estimate) and the error statistics."""
    order = F.struct("t_ms", "event_id")
    end = lambda df, s: df.groupBy("session_id").agg(F.count("*").alias(f"n_{s}"), F.max_by(F.struct("lat", "lon"), order).alias(s))
    made = end(gps, "gps").join(end(dr, "dr"), "session_id", "full").join(session_stats(gps, dr, gate_ms), "session_id", "left")
    count = lambda s: F.coalesce(f"n_{s}", F.lit(0)).alias(f"n_{s}")
    follow = F.coalesce("gps", "dr")
    return made.select("session_id", count("gps"), count("dr"), F.col("gps.lat").alias("gps_lat"), F.col("gps.lon").alias("gps_lon"), F.col("dr.lat").alias("dr_lat"), F.col("dr.lon").alias("dr_lon"), follow["lat"].alias("follow_lat"), follow["lon"].alias("follow_lon"), "current_error_m", "distance_travelled_m")


def _fixed_text(v, digits: int):
    """``v`` to so many places as C's ``printf`` has it: by its exact binary value, halves to even
    (``format_string`` rounds the shortest decimal text of it, halves up)."""
    return F.call_function("format_number", v, F.lit("0." + "0" * digits if digits else "0"))


def metres_text(v, digits: int = 1):
    """``12.3 m``; a dash for NaN."""
    return F.when(F.isnan(v), "—").otherwise(F.concat(_fixed_text(v, digits), F.lit(" m")))


def percent_text(v):
    return F.when(F.isnan(v), "—").otherwise(F.concat(_fixed_text(v, 2), F.lit("%")))


def status_text(status, snap_mode, **flags):
    """What an engine says of itself: its status, where it snaps, and the flags that hold
    (a text each), apart by middle dots."""
    return F.concat_ws(" · ", status, F.concat(F.lit("snap="), snap_mode), *(F.when(flag, F.lit(text.replace("_", " "))) for text, flag in flags.items()))


def may_recalculate(source, confidence, most_m: float = 200.0):
    """A route may be asked for anew from a fix, or from an estimate of known confidence."""
    return (source != "DR") | F.coalesce(~F.isnan(confidence) & (confidence <= most_m), F.lit(False))


def usable_accuracy(accuracy, default: float = 5.0, least: float = 1.0, most: float = 30.0):
    """Accuracy of a fix in metres; null for one to be left alone."""
    a = F.greatest(F.coalesce(accuracy, F.lit(default)), F.lit(least))
    return F.when(a <= most, a)


def write_csv(table: DataFrame, path: str) -> None:
    """One folder of CSV with header; null is empty, NaN is ``NaN``."""
    table.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").option("nanValue", "NaN").csv(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """What ``write_csv`` wrote, by its schema; lines may break within quoted texts."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "").option("nanValue", "NaN").option("multiLine", True).option("escape", "\\").csv(path)


def export_name(start_ms, kind: str):
    """``session_<yyyyMMdd_HHmmss>_<kind>.csv`` of a start time."""
    return F.concat(F.lit("session_"), F.date_format(F.timestamp_millis(F.lit(start_ms) if isinstance(start_ms, int) else start_ms), "yyyyMMdd_HHmmss"), F.lit(f"_{kind}.csv"))
