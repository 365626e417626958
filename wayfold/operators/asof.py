"""Joins in time: nearest within a gate, zero-order hold, pose resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_in_time(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str], gate: int, inner: bool = False, backward: bool = False, order: str | None = None) -> DataFrame:
    """``left`` with the row of ``right`` nearest in time, at most ``gate`` away.

    ``values`` of that row become ``m_<name>``, its time ``m_<time>``; of rows at one time
    the first by ``order`` counts, and of two equally near the earlier. Sessions are cut
    into spans of time, with rows near a border in both, so that no task holds a whole
    session; both sides are shuffled once.
    """
    span = max(64 * gate, 1)
    bucket = lambda t: F.floor(t / span)
    picked = F.struct(F.col(time).alias("t"), *(F.col(v).alias(v) for v in values))
    once = right.groupBy(*keys, time).agg(F.min_by(picked, F.col(order) if order else F.struct(*values)).alias("r"))
    once = once.withColumn("_span", F.explode(F.array_distinct(F.array(bucket(F.col(time) - gate), bucket(F.col(time) + gate)))))
    rows = left.select(*keys, time, F.struct(*(F.col(f"`{c}`") for c in left.columns)).alias("l"), bucket(F.col(time)).alias("_span"))
    both = rows.unionByName(once, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_span").orderBy(time, F.col("l").isNotNull())
    before = F.last("r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("r", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    both = both.withColumn("_b", before).withColumn("_a", after).where("l is not null")
    back, ahead = F.col(time) - F.col("_b.t"), F.col("_a.t") - F.col(time)
    nearest = F.when(F.col("_a").isNull() | (back <= ahead), F.col("_b")).otherwise(F.col("_a"))
    both = both.withColumn("_n", F.col("_b") if backward else nearest)
    both = both.withColumn("_n", F.when(F.abs(F.col("_n.t") - F.col(time)) <= gate, F.col("_n")))
    both = both.where("_n is not null") if inner else both
    return both.select("l.*", F.col("_n.t").alias(f"m_{time}"), *(F.col(f"_n.{v}").alias(f"m_{v}") for v in values))


def latest_before(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str], span: int, order: str | None = None) -> DataFrame:
    """``left`` with the last row of ``right`` at or before it, however old (``m_<name>``).

    Sessions are cut into spans of time; each span is told the last row before it, from a
    small table of spans, so no task holds a whole session."""
    slot = F.floor(F.col(time) / span)
    picked = F.struct(F.col(time).alias("t"), *(F.col(v).alias(v) for v in values))
    once = right.groupBy(*keys, time).agg(F.min_by(picked, F.col(order) if order else F.struct(*values)).alias("r")).withColumn("_span", slot)
    rows = left.select(*keys, time, F.struct(*(F.col(f"`{c}`") for c in left.columns)).alias("l"), slot.alias("_span"))
    tops = once.groupBy(*keys, "_span").agg(F.max_by("r", time).alias("r"))
    spans = rows.select(*keys, "_span").distinct().unionByName(tops, allowMissingColumns=True).groupBy(*keys, "_span").agg(F.first("r", ignorenulls=True).alias("r"))
    earlier = F.last("r", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))
    carried = spans.withColumn("r", earlier).where("r is not null").withColumn(time, (F.col("_span") * span).cast("long"))
    both = rows.unionByName(once, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_span").orderBy(time, F.col("l").isNotNull(), F.col("r.t")).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_n", F.last("r", ignorenulls=True).over(w)).where("l is not null")
    return both.select("l.*", F.col("_n.t").alias(f"m_{time}"), *(F.col(f"_n.{v}").alias(f"m_{v}") for v in values))


def zero_order_hold(events: DataFrame, keys: list[str], order: list, kind: str, value: str, triggers: list[str], carried: list[str]) -> DataFrame:
    """One row for each event of a trigger kind once every trigger kind was seen, with the
    latest value of each kind up to it (``h_<kind>``)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    held = {f"h_{k}": F.last(F.when(F.col(kind) == k, F.col(value)), ignorenulls=True).over(w) for k in [*triggers, *carried]}
    made = events.withColumns(held).where(F.col(kind).isin(*triggers))
    for k in triggers:
        made = made.where(F.col(f"h_{k}").isNotNull())
    return made


def resolve_pose(asked: DataFrame, gps: DataFrame, dr: DataFrame, keys: list[str], time: str, fresh: int = 8000) -> DataFrame:
    """Position of a fix less than ``fresh`` ms old, else of the last estimate, however old;
    heading and speed rather from the estimate, no speed counts as 0. Rows without position
    or heading are left out."""
    values = ["lat", "lon", "heading", "value"]
    one = nearest_in_time(asked, gps, keys, time, values, fresh - 1, backward=True, order="event_id")
    one = one.select(*asked.columns, *(F.col(f"m_{v}").alias(f"g_{v}") for v in values))
    two = latest_before(one, dr, keys, time, values, 64 * fresh, order="event_id")
    side = lambda v, *names: F.coalesce(*(F.col(n + v) for n in names))
    source = F.when(F.col("g_lat").isNotNull(), "GPS").otherwise("DR")
    made = two.select(*asked.columns, side("lat", "g_", "m_").alias("pose_lat"), side("lon", "g_", "m_").alias("pose_lon"), side("heading", "m_", "g_").alias("pose_heading"), F.coalesce(side("value", "m_", "g_"), F.lit(0.0)).alias("pose_speed"), source.alias("source"))
    return made.where("pose_lat is not null and pose_heading is not null")
