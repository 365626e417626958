"""Pedestrian navigation by steps: window expressions around one fold.

Only two parts need a fold, as their order matters: the product of small rotations and the
low-pass that stands in for gravity. Steps, biases, headings, places and speeds are window
expressions over the session.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.engines.arrays import columns
from wayfold.functions import geo, linalg
from wayfold.operators import folds, ordered

KEY, ORDER = ["session_id"], ["_row"]
STRIDE, FIRST_STEP_S, STANDS_AFTER_S, GRAVITY_PASS = 0.75, 0.6, 2.0, 0.05


def _triple(name: str) -> Column:
    """A vector column of three sensor columns; null unless all are there."""
    parts = [F.col(f"{name}_{axis}").cast("double") for axis in "xyz"]
    return F.when(parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull(), F.array(*parts))


def _start(many: int) -> dict:
    return {"c": np.tile(np.eye(3), (many, 1, 1)), "low": np.full((many, 3), np.nan)}


def _step(s: dict, r: dict) -> tuple[dict, dict]:
    """The gyro heading after one more small rotation (series to the fourth order), and the
    low-pass of the acceleration: it moves once for the heading where no gravity is known,
    and once before if the linear acceleration needs it too."""
    w = np.stack([r["delta_y"], r["delta_x"], -np.asarray(r["delta_z"], float)], axis=1)
    b = np.zeros((len(w), 3, 3))
    b[:, 0, 1], b[:, 0, 2], b[:, 1, 2] = w[:, 2], -w[:, 1], w[:, 0]
    b -= b.transpose(0, 2, 1)
    square = (w * w).sum(axis=1)[:, None, None]
    c = s["c"] @ (np.eye(3) + (1 - square / 6 + square**2 / 120) * b + (0.5 - square / 24 + square**2 / 720) * (b @ b))
    acc, low = columns(r, "accel_x", "accel_y", "accel_z"), s["low"]
    made = {}
    for name, due in (("first", r["low_first"]), ("last", r["low_last"])):
        due = np.asarray(due, bool)[:, None]
        low = np.where(due, np.where(np.isnan(low), acc, low + GRAVITY_PASS * (acc - low)), low)
        made |= {f"{name}_{axis}": low[:, k] for k, axis in enumerate("xyz")}
    return {"c": c, "low": low}, {"session_id": r["session_id"], "_row": r["_row"], "turned": np.arctan2(c[:, 1, 0], c[:, 0, 0]), **made}


_SCHEMA = "session_id long, _row int, turned double, first_x double, first_y double, first_z double, last_x double, last_y double, last_z double"


def walk(samples: DataFrame, seeds: DataFrame, stride: Column | float = STRIDE, sensitivity: float = 1.0, bias_samples: int = 199) -> DataFrame:
    """State of each motion sample: places by steps of ``stride`` metres, a number or a column
    of ``samples``, along the fused heading. Samples of one time are taken in an order of their
    own, each once.

    ``seeds`` has ``session_id``, ``lat``, ``lon``. Gravity comes from its sensor, else from the
    attitude, else from a low-pass of the acceleration.
    """
    w = Window.partitionBy(*KEY).orderBy(*ORDER)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    numbered = Window.partitionBy(*KEY).orderBy("timestamp_nanos", F.xxhash64(*(F.col(c) for c in samples.columns)))
    df = samples.withColumn("_row", F.row_number().over(numbered)).withColumn("stride_length", stride if isinstance(stride, Column) else F.lit(float(stride)))
    for axis in "xyz":
        df = ordered.gyro_bias(df.withColumn(f"gyro_{axis}", F.col(f"gyro_{axis}").cast("double")), KEY, ORDER, f"gyro_{axis}", bias_samples)
        df = ordered.gyro_delta(df, KEY, ORDER, f"gyro_{axis}", "timestamp_nanos", "bias").withColumnRenamed("delta", f"delta_{axis}").drop("bias", "dt")
    quat = F.array(*(F.col(f"quat_{x}").cast("double") for x in "xyzw"))
    attitude = F.when(F.col("quat_w").isNotNull() & _triple("quat").isNotNull(), linalg.gravity_phone(linalg.quat_matrix(*(linalg.at(quat, i) for i in range(4)))))
    df = df.withColumn("_gravity", F.coalesce(_triple("gravity"), attitude)).withColumn("_linear", _triple("linear"))
    df = df.withColumn("low_last", F.col("_gravity").isNull()).withColumn("low_first", F.col("low_last") & F.col("_linear").isNull())
    fold_in = df.select("session_id", "_row", "delta_x", "delta_y", "delta_z", *(F.col(f"accel_{x}").cast("double").alias(f"accel_{x}") for x in "xyz"), "low_first", "low_last")
    folded = folds.scan(fold_in, KEY, ORDER, _SCHEMA, _start, _step)
    df = df.join(folded, [*KEY, *ORDER])
    raw, vector = _triple("accel"), lambda name: F.array(*(F.col(f"{name}_{x}") for x in "xyz"))
    linear = F.coalesce("_linear", F.zip_with(raw, F.coalesce("_gravity", vector("first")), lambda a, g: a - g))
    df = df.withColumn("acc_mag", linalg.norm3(linear))
    df = ordered.detect_steps(df, KEY, ORDER, "acc_mag", sensitivity).withColumnRenamed("is_step", "step_detected")
    magnetic = F.nanvl(linalg.magnetic_heading(F.coalesce("_gravity", vector("last")), _triple("mag")), F.lit(None).cast("double"))
    df = df.withColumn("_mag", magnetic)
    df = df.withColumn("mag_heading_rad", F.last("_mag", ignorenulls=True).over(so_far)).withColumn("_first", F.first("_mag", ignorenulls=True).over(so_far))
    df = df.withColumn("gyro_heading_rad", F.col("turned") + F.coalesce("_first", F.lit(0.0)))
    df = df.withColumn("fused_heading_rad", F.when(F.col("mag_heading_rad").isNull(), F.col("gyro_heading_rad")).otherwise(linalg.complementary(F.col("mag_heading_rad"), F.col("gyro_heading_rad"))))
    # A step moves the place; its speed holds until the next, or for two seconds.
    step, nanos = F.col("step_detected"), F.col("timestamp_nanos")
    df = df.withColumn("_e", F.when(step, F.col("stride_length") * F.cos("fused_heading_rad"))).withColumn("_n", F.when(step, F.col("stride_length") * F.sin("fused_heading_rad")))
    df = df.withColumn("_since", (nanos - F.last(F.when(step, nanos), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).cast("double") / 1e9)
    took = F.coalesce(linalg.clamp(F.col("_since"), 0.2, 5.0), F.lit(FIRST_STEP_S))
    df = df.withColumns({"_ve": F.last(F.col("_e") / took, ignorenulls=True).over(so_far), "_vn": F.last(F.col("_n") / took, ignorenulls=True).over(so_far)})
    stands = F.when(step, F.lit(False)).otherwise(F.coalesce(F.col("_since") > STANDS_AFTER_S, F.lit(True)))
    gap = (nanos - F.lag(nanos).over(w)).cast("double") / 1e9
    df = df.withColumn("_dt", F.when((gap > 0) & (gap < 5), gap).otherwise(0.0))
    df = df.withColumns({"dr_x_east": F.coalesce(F.sum("_e").over(so_far), F.lit(0.0)), "dr_y_north": F.coalesce(F.sum("_n").over(so_far), F.lit(0.0)), "confidence_m": 2 + 0.5 * F.sum("_dt").over(so_far)})
    df = df.withColumns({"vel_east": F.when(stands, 0.0).otherwise(F.coalesce("_ve", F.lit(0.0))), "vel_north": F.when(stands, 0.0).otherwise(F.coalesce("_vn", F.lit(0.0)))})
    at = seeds.select("session_id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    moved = geo.move_enu(F.col("_lat"), F.col("_lon"), F.col("dr_x_east"), F.col("dr_y_north"))
    nan = F.lit(math.nan)
    return df.join(at, "session_id").select(
        "session_id", "timestamp_nanos", moved["lat"].alias("dr_lat"), moved["lon"].alias("dr_lon"), "vel_east", "vel_north", geo.to_compass_deg(F.col("fused_heading_rad")).alias("heading_deg"), "confidence_m",
        "acc_mag", "step_detected", "stride_length", "gyro_heading_rad", F.coalesce("mag_heading_rad", nan).alias("mag_heading_rad"), "fused_heading_rad", "dr_x_east", "dr_y_north",
        *(nan.alias(n) for n in ("forward_speed_mps", "yaw_rate_deg_s", "lateral_vel_mps")), F.lit("PDR").alias("snap_mode"), *(nan.alias(n) for n in ("bias_omega_mag", "bias_acc_mag", "nhc_residual_lat")),
    )
