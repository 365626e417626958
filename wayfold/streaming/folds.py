"""Folds over streams: the same steps as :mod:`wayfold.operators.folds`, with the states kept by
Structured Streaming between triggers.

Sessions are hashed to blocks, and a block is one state: its sessions advance in lockstep
within a trigger, as they do in a batch. With an event time, rows wait in the state until the
watermark has passed them and are then taken in order, so rows that arrive out of order by less
than the delay give what a batch gives. Rows behind the watermark are dropped by Spark,
which counts them (``numRowsDroppedByWatermark`` of the query's progress, see ``late_rows``).
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from wayfold.operators.folds import advance, grown

#: How late a position fix may be delivered.
DELAY = "2 seconds"
BLOCKS = 64


def lockstep(state: dict | None, slots: dict, table: pd.DataFrame, keys: list[str], names: list[str], start: Callable, step: Callable) -> tuple[dict | None, pd.DataFrame]:
    """Advances the sessions of ``table`` (sorted) by all its rows: the first of each, then the
    second ones, and so on. ``slots`` gets the place of each session in the state."""
    if not len(table):
        return state, pd.DataFrame({n: [] for n in names})
    ids = list(zip(*(table[k].tolist() for k in keys), strict=True))
    place = np.array([slots.setdefault(i, len(slots)) for i in ids])
    state = grown(state, start, len(slots))
    turn = pd.Series(place).groupby(place).cumcount().to_numpy()
    rows, made = {c: table[c].to_numpy() for c in table.columns}, []
    order = np.argsort(turn, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(turn[order])) + 1):
        made.append(advance(state, place[at], {c: v[at] for c, v in rows.items()}, step))
    return state, pd.DataFrame({n: np.concatenate([m[n] for m in made]) for n in names})


def scan_stream(df: DataFrame, keys: list[str], order: list[str], schema: str, start: Callable[[int], dict], step: Callable[[dict, dict], tuple], event_time: str | None = None, delay: str = DELAY, blocks: int = BLOCKS) -> DataFrame:
    """Runs ``step`` (see ``folds.scan``) over each session of a stream, in ``order``.

    Without ``event_time`` rows are taken as triggers bring them: arrival is the truth, as for
    a sensor. With it (a timestamp column) they wait until the watermark, ``delay`` behind the
    latest one, has passed. A task holds the states of its blocks, and of each session the rows of
    one trigger and of the delay.
    """
    names = [field.split()[0] for field in schema.split(", ")]
    timed = df.withWatermark(event_time, delay).withColumn("_ms", F.unix_millis(event_time)) if event_time else df
    columns = timed.columns
    timeout = GroupStateTimeout.EventTimeTimeout if event_time else GroupStateTimeout.NoTimeout

    def run(_, batches, held):
        state, slots, waiting = pickle.loads(held.get[0]) if held.exists else (None, {}, None)
        tables = [t for t in (waiting, *(b[columns] for b in batches)) if t is not None and len(t)]
        table = pd.concat(tables, ignore_index=True) if tables else pd.DataFrame({c: [] for c in columns})
        waiting = None
        if event_time and len(table):
            passed = table["_ms"] <= held.getCurrentWatermarkMs()
            table, waiting = table[passed], table[~passed]
        state, out = lockstep(state, slots, table.sort_values(order, kind="stable") if len(table) else table, keys, names, start, step)
        held.update((pickle.dumps((state, slots, waiting)),))
        if waiting is not None and len(waiting):
            held.setTimeoutTimestamp(int(waiting["_ms"].min()) + 1)
        yield out

    block = F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int")
    return timed.withColumn("_block", block).groupBy("_block").applyInPandasWithState(run, schema, "body binary", "append", timeout)


def late_rows(query: StreamingQuery) -> int:
    """Rows that were behind the watermark so far."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
