"""Ordered analytics of sessions that are too long for one task.

A session is cut into spans of time. What a row needs of all rows before it is what its span
has before it, by a window over that span, and what the earlier spans came to, from a table
with one row a span. So a session is as many tasks as it has spans. Doubles are
added in two parts (see :func:`parts`), so their sums are the nearest doubles, or next to them,
however long a session is and wherever it is cut.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from wayfold.functions import linalg
from wayfold.functions.geo import SPHERE, haversine_m
from wayfold.operators import folds, ordered
from wayfold.operators.lineage import settled

#: A double's upper part is a multiple of 1 / UPPER: below 2^53 / UPPER (8.6e9) sums of those are exact.
UPPER = float(1 << 20)
#: Rows of a chunk of :func:`affine`; powers of a factor over it must stay within a double.
CHUNK = 256


def cut(df: DataFrame, time: str, width: int) -> DataFrame:
    """``df`` with its span."""
    return df.withColumn("_span", F.floor(F.col(time) / width))


def _told(df: DataFrame, keys: list[str], spans: DataFrame) -> DataFrame:
    """``df`` with the columns of its span; null keys are keys like others."""
    given = spans.select(*(F.col(k).alias(f"_k_{k}") for k in [*keys, "_span"]), *(c for c in spans.columns if c not in [*keys, "_span"]))
    met = None
    for k in [*keys, "_span"]:
        same = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        met = same if met is None else met & same
    return df.join(given, met, "left").drop(*(f"_k_{k}" for k in [*keys, "_span"]))


def parts(value: Column) -> tuple[Column, Column]:
    """Upper and lower part of a double. Upper parts add up without error, and the lower ones
    are so small that the error of their sum does not count."""
    upper = F.rint(value * UPPER) / UPPER
    return upper, F.nanvl(value - upper, F.lit(0.0))  # of infinities and NaN all is the upper part


def carried(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None) -> DataFrame:
    """``df`` (cut) with running sums, the own row included, under the names of ``sums``, and with
    the last non-null value before each row under those of ``lasts``.

    ``df`` is read twice, for the spans and for the rows; where a step follows another one, the
    first has to be ``settled``."""
    sums, lasts = sums or {}, lasts or {}
    seen = {f"_v_{n}": c for n, c in lasts.items()}
    df = df.withColumns({f"_v_{n}": c for n, c in sums.items()} | seen)
    halves = [n for n in sums if isinstance(df.schema[f"_v_{n}"].dataType, DoubleType)]
    df = df.withColumns({f"{s}_v_{n}": c for n in halves for s, c in zip(("", "_l"), parts(F.col(f"_v_{n}")), strict=True)})
    added = [*(f"_v_{n}" for n in sums), *(f"_l_v_{n}" for n in halves)]
    place = F.struct(*order)
    known = lambda n, c: F.when(F.col(n).isNotNull(), c)
    spans = df.groupBy(*keys, "_span").agg(*(F.sum(n).alias(n) for n in added), *(F.max_by(known(n, F.col(n)), known(n, place)).alias(n) for n in seen))
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(*keys, "_span", *(F.sum(n).over(before).alias(f"_b{n}") for n in added), *(F.last(n, ignorenulls=True).over(before).alias(f"_b{n}") for n in seen))
    within = Window.partitionBy(*keys, "_span").orderBy(*order)
    upto, prior = within.rowsBetween(Window.unboundedPreceding, 0), within.rowsBetween(Window.unboundedPreceding, -1)
    total = lambda n: F.coalesce(F.sum(n).over(upto), F.lit(0)) + F.coalesce(F.col(f"_b{n}"), F.lit(0))
    made = _told(df, keys, spans).withColumns(
        {n: total(f"_v_{n}") + total(f"_l_v_{n}") if n in halves else total(f"_v_{n}") for n in sums}
        | {n: F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(prior), F.col(f"_b_v_{n}")) for n in lasts}
    )
    return made.drop(*added, *seen, *(f"_b{n}" for n in [*added, *seen]))


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    return carried(df, keys, order, sums=sums)


def last_before(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    return carried(df, keys, order, lasts=values)


def numbered(df: DataFrame, keys: list[str], order: list, name: str = "row_no") -> DataFrame:
    """``df`` (cut) with the number of each row in its session, from 1 on."""
    return running(df, keys, order, {name: F.lit(1).cast("long")})


def running_distance(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``step_m`` and ``distance_m`` as ``ordered.running_distance`` has them."""
    made = last_before(df, keys, order, {"_p": F.struct("lat", "lon")})
    made = made.withColumn("step_m", F.coalesce(haversine_m(F.col("_p.lat"), F.col("_p.lon"), F.col("lat"), F.col("lon")), F.lit(0.0))).drop("_p")
    return running(settled(made), keys, order, {"distance_m": F.col("step_m")})


def detect_steps(df: DataFrame, keys: list[str], order: list[str], value: str, sensitivity: float) -> DataFrame:
    """``is_step`` as ``ordered.detect_steps`` has it."""
    made = running(df, keys, order, {"_n": F.when(F.col(value).isNotNull(), 1).otherwise(0), "_sum": F.col(value)})
    mean = F.try_divide("_sum", "_n")
    made = made.withColumn("_edge", F.when(F.col(value) > mean + sensitivity, 1).when(F.col(value) < mean - sensitivity, 0))
    made = last_before(settled(made), keys, order, {"_latched": F.col("_edge")})
    step = (F.col("_edge") == 1) & (F.coalesce("_latched", F.lit(0)) == 0)
    return made.withColumn("is_step", F.coalesce(step, F.lit(False))).drop("_n", "_sum", "_edge", "_latched")


def strapdown(df: DataFrame, keys: list[str], order: list[str], dt: str, east: str, north: str) -> DataFrame:
    """Velocity, place and confidence as ``ordered.strapdown`` has them."""
    made = running(df, keys, order, {"vel_east": F.col(east) * F.col(dt), "vel_north": F.col(north) * F.col(dt), "_t": F.col(dt)})
    made = running(settled(made), keys, order, {"x_east": F.col("vel_east") * F.col(dt), "y_north": F.col("vel_north") * F.col(dt)})
    return made.withColumn("confidence_m", 2 + 0.5 * F.col("_t")).drop("_t")


def attitude_strapdown(df: DataFrame, keys: list[str], order: list[str], nanos: str) -> DataFrame:
    """``df`` (cut; ``accel_*``, ``quat_*`` and the start ``lat0``, ``lon0``, ``ve0``, ``vn0``,
    ``heading0`` on each row) with ``vel_east``, ``vel_north``, ``lat``, ``lon``, ``heading`` and
    ``confidence_m`` of the plain strapdown engine.

    The attitude is the last whole quaternion so far; until there is one nothing accelerates.
    Less gravity, the acceleration is turned to the world and summed to velocity and place. Above
    0.5 m/s the heading is that of the velocity less the yaw of the first attitude; below, it stays.
    Gaps of 0 or over 0.2 s count as 0.01 s.
    """
    q = [F.col(f"quat_{x}").cast("double") for x in "xyzw"]
    whole = F.when(q[0].isNotNull() & q[1].isNotNull() & q[2].isNotNull() & q[3].isNotNull(), F.array(*q))
    known = F.when(whole.isNotNull(), F.lit(1)).otherwise(0)
    made = carried(df, keys, order, {"_known": known}, {"_q": whole, "_nanos": F.col(nanos)}).withColumn("_attitude", F.coalesce(whole, F.col("_q")))
    matrix = linalg.quat_matrix(*(linalg.at(F.col("_attitude"), i) for i in range(4)))
    down = linalg.gravity_phone(matrix)
    linear = F.array(*(F.col(f"accel_{x}").cast("double") - linalg.at(down, i) for i, x in enumerate("xyz")))
    world = linalg.mat_vec(matrix, linear)
    gap = (F.col(nanos) - F.col("_nanos")).cast("double") / 1e9
    push = lambda i: F.coalesce(F.when(F.col("_attitude").isNotNull(), linalg.at(world, i)), F.lit(0.0)) * F.col("_dt")
    made = made.withColumns({"_own": F.when((F.col("_known") == 1) & whole.isNotNull(), linalg.yaw_deg(matrix)), "_dt": ordered.interval(gap, "glitch")})
    made = settled(made.withColumns({"_pe": push(0), "_pn": push(1)}))
    made = carried(made, keys, order, {"_se": F.col("_pe"), "_sn": F.col("_pn"), "_t": F.col("_dt")}, {"_yaw": F.col("_own")})
    made = made.withColumns({"vel_east": F.col("ve0") + F.col("_se"), "vel_north": F.col("vn0") + F.col("_sn"), "_mount": F.coalesce("_own", "_yaw", F.lit(0.0))})
    way = F.degrees(F.atan2("vel_east", "vel_north"))
    heading = F.when(F.hypot("vel_east", "vel_north") > 0.5, ((way - F.col("_mount")) % 360 + 360) % 360)
    made = settled(made.withColumns({"_heading": heading, "_dn": F.degrees(F.col("vel_north") * F.col("_dt") / SPHERE)}))
    made = carried(made, keys, order, {"_up": F.col("_dn")}, {"_held": F.col("_heading")}).withColumn("lat", F.col("lat0") + F.col("_up"))
    across = F.degrees(F.col("vel_east") * F.col("_dt") / (SPHERE * F.cos(F.radians(F.col("lat") - F.col("_dn")))))
    made = carried(settled(made), keys, order, {"_across": across}).withColumn("lon", F.col("lon0") + F.col("_across"))
    made = made.withColumns({"heading": F.coalesce("_heading", "_held", "heading0"), "confidence_m": 2 + 0.5 * F.col("_t")})
    return made.drop("_q", "_nanos", "_attitude", "_known", "_own", "_yaw", "_mount", "_dt", "_pe", "_pn", "_se", "_sn", "_t", "_dn", "_up", "_across", "_heading", "_held")


def _chained(many: int) -> dict:
    return {"y": np.zeros(many)}


def _chain(s: dict, r: dict) -> tuple[dict, dict]:
    """A chunk begins with what the one before ended with."""
    return {"y": r["a"] * s["y"] + r["b"]}, {"_session": r["_session"], "_chunk": r["_chunk"], "_begin": s["y"]}


def affine(df: DataFrame, keys: list[str], order: list[str], factor: Column, added: Column, name: str = "y") -> DataFrame:
    """``df`` (cut) with ``y = factor * (y before) + added``, 0 before the first row; factors lie
    above 0 and at most 1. Rows that are numbered from 1 on (``_no``) aren't numbered again.

    Rows are numbered and cut into chunks. Within one, ``y`` is a sum weighted by products of
    factors, which a window takes as sums of their logarithms; a chunk as a whole is one affine map,
    and only those are chained one after the other. Keys may hold nulls.
    """
    made = df if "_no" in df.columns else numbered(df, keys, order, "_no")
    made = made.withColumns({"_a": F.log(factor), "_add": added})
    made = made.withColumns({"_chunk": F.floor((F.col("_no") - 1) / CHUNK), "_session": F.to_json(F.struct(*keys))})
    w = Window.partitionBy("_session", "_chunk").orderBy("_no").rowsBetween(Window.unboundedPreceding, 0)
    made = made.withColumn("_s", F.sum("_a").over(w))
    made = settled(made.withColumn("_b", F.exp("_s") * F.sum(F.col("_add") * F.exp(-F.col("_s"))).over(w)))
    ends = made.groupBy("_session", "_chunk").agg(F.exp(F.max_by("_s", "_no")).alias("a"), F.max_by("_b", "_no").alias("b"))
    begun = folds.scan(ends, ["_session"], ["_chunk"], "_session string, _chunk long, _begin double", _chained, _chain)
    made = made.join(begun, ["_session", "_chunk"]).withColumn(name, F.col("_b") + F.exp("_s") * F.col("_begin"))
    return made.drop("_session", "_chunk", "_no", "_a", "_add", "_s", "_b", "_begin")


def low_pass(df: DataFrame, keys: list[str], order: list[str], value: str, share: Column, name: str = "y") -> DataFrame:
    """``df`` (cut) with the first-order filter of ``value`` that ``folds.low_pass`` (a fixed
    share) and ``folds.smooth`` (a share by time) fold; the first row is its own result."""
    made = numbered(df, keys, order, "_no")
    first = F.col("_no") == 1
    kept = F.when(first, F.lit(1.0)).otherwise(1 - share)
    return affine(made, keys, order, kept, F.when(first, F.col(value)).otherwise(share * F.col(value)), name)
