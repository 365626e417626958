"""The fold engines on streams of samples, fixes, routes and seeds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.engines import registry
from wayfold.functions.geo import move_enu
from wayfold.streaming import folds


def run_stream(rows: DataFrame, engine: str = "iekf", roads: Callable | None = None, delay: str = folds.DELAY, blocks: int = folds.BLOCKS, **hooks) -> DataFrame:
    """State of every motion sample, by the named engine, as the watermark passes it.

    ``rows`` is a stream of what ``registry.event_rows`` makes of samples, seeds, fixes, routes and
    resets, with ``event_time`` (a timestamp). Rows may come out of order by less than ``delay``,
    which is how late fixes are delivered. Seeds have to come with the first rows of their session,
    with an event time of those (the watermark begins at 1970, and what is not after it is late).
    """
    start, step = registry.stepper(engine, roads=roads, **hooks)
    made = folds.scan_stream(rows, ["session_id"], ["t_nanos", "kind"], registry.SCHEMA, start, step, "event_time", delay, blocks).where(F.col("kind") == registry.SAMPLE)
    moved = move_enu(F.col("lat0"), F.col("lon0"), F.col("dr_x_east"), F.col("dr_y_north"))
    return made.select("session_id", "timestamp_nanos", moved["lat"].alias("dr_lat"), moved["lon"].alias("dr_lon"), *registry.STATE, *registry.DEBUG, "snap_mode", *registry.FLAGS)
