"""Order-dependent folds: a state per session, carried from row to row.

Sessions advance in lockstep. They are hashed to blocks of a few hundred; within a block the
first rows of all sessions stand first, then the second ones, and so on, and a step works on
arrays with one entry a session. A task streams its blocks in Arrow batches and keeps the
state of one block, so memory grows neither with a session nor with their number.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Sessions of a block.
BLOCK = 256
State = dict[str, np.ndarray]


def grown(state: State | None, start: Callable[[int], State], many: int) -> State:
    """``state`` with room for ``many`` sessions."""
    have = len(next(iter(state.values()))) if state else 0
    if have >= many:
        return state
    new = start(max(16, 2 * have, many))
    for name, values in (state or {}).items():
        new[name][:have] = values
    return new


def advance(state: State, place: np.ndarray, rows: State, step: Callable) -> State:
    """One step of the sessions at ``place``, whose states are replaced; returns the output."""
    own, out = step({name: values[place] for name, values in state.items()}, rows)
    for name, values in own.items():
        state[name][place] = values
    return out


def scan(df: DataFrame, keys: list[str], order: list, schema: str, start: Callable[[int], State], step: Callable[[State, State], tuple[State, State]]) -> DataFrame:
    """Runs ``step(state, rows) -> (state, output)`` over each session's rows.

    ``rows`` and both states are arrays by name with one entry a session, ``start(many)`` gives
    first states. The output has the columns of ``schema``."""
    spark, columns = df.sparkSession, df.columns
    many = df.select(F.approx_count_distinct(F.xxhash64(*keys))).first()[0]
    blocks = max(1, -(-many // BLOCK), min(many, spark.sparkContext.defaultParallelism))
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches):
        now, state, slots = None, None, {}
        for batch in batches:
            if not len(batch):
                continue
            block, turn = batch["_block"].to_numpy(), batch["_turn"].to_numpy()
            cuts = [0, *(np.flatnonzero((block[1:] != block[:-1]) | (turn[1:] != turn[:-1])) + 1).tolist(), len(batch)]
            rows = {c: batch[c].to_numpy() for c in columns}
            ids = list(zip(*(batch[k].tolist() for k in keys), strict=True))
            made: dict[str, list] = {n: [] for n in names}
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if block[a] != now:
                    now, state, slots = block[a], None, {}
                place = np.array([slots.setdefault(i, len(slots)) for i in ids[a:b]])
                state = grown(state, start, len(slots))
                out = advance(state, place, {c: v[a:b] for c, v in rows.items()}, step)
                for n in names:
                    made[n].append(out[n])
            yield pd.DataFrame({n: np.concatenate(v) for n, v in made.items()})

    dealt = df.withColumn("_block", F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int")).repartition("_block")
    dealt = dealt.withColumn("_turn", F.row_number().over(Window.partitionBy("_block", *keys).orderBy(*order)))
    return dealt.sortWithinPartitions("_block", "_turn", *keys).mapInPandas(run, schema)


def _start(**first):
    """First states: each field filled with its value."""
    return lambda many: {name: np.full(many, value) for name, value in first.items()}


def _named(rows: State, **made) -> State:
    return {"session_id": rows["session_id"], "event_id": rows["event_id"], **made}


def low_pass(alpha: float):
    """First-order filter, started with the first value. Rows: ``event_id``, ``value``."""

    def step(s, r):
        y = np.where(np.isnan(s["y"]), r["value"], s["y"] + alpha * (r["value"] - s["y"]))
        return {"y": y}, _named(r, y=y)

    return _start(y=np.nan), step, "session_id long, event_id long, y double"


def smooth(tau: float):
    """Filter with the time constant ``tau`` (seconds), started with the first value. Rows:
    ``event_id``, ``value``, ``dt``."""

    def step(s, r):
        y = np.where(np.isnan(s["y"]), r["value"], s["y"] + r["dt"] / (tau + r["dt"]) * (r["value"] - s["y"]))
        return {"y": y}, _named(r, y=y)

    return _start(y=np.nan), step, "session_id long, event_id long, y double"


def throttle(gap_ms: int):
    """Accepts the first row, each one ``gap_ms`` after the last it accepted, and every step.
    Rows: ``t_ms`` and, if there are steps, ``is_step``."""

    def step(s, r):
        take = ~s["seen"] | (r["t_ms"] - s["t"] >= gap_ms) | np.asarray(r.get("is_step", np.zeros(len(r["t_ms"]), bool)), bool)
        return {"seen": s["seen"] | take, "t": np.where(take, r["t_ms"], s["t"])}, _named(r, accepted=take)

    return _start(seen=False, t=np.int64(0)), step, "session_id long, event_id long, accepted boolean"


def spaced(least_m: float, least_speed: float = 0.0):
    """Keeps the first place and each one ``least_m`` from the last it kept, while the speed
    is not below ``least_speed``. Rows: ``east``, ``north``, ``speed``."""

    def step(s, r):
        far = np.isnan(s["e"]) | (np.hypot(r["east"] - s["e"], r["north"] - s["n"]) >= least_m)
        take = far & (r["speed"] >= least_speed)
        return {"e": np.where(take, r["east"], s["e"]), "n": np.where(take, r["north"], s["n"])}, _named(r, kept=take)

    return _start(e=np.nan, n=np.nan), step, "session_id long, event_id long, kept boolean"


def rate_windows(width_ms: int = 1000):
    """Measured rate: a window ends with the first row ``width_ms`` or more after it began,
    and gives its rows a second; NaN elsewhere. Rows: ``t_ms``."""

    def step(s, r):
        begin = np.where(s["count"] < 0, r["t_ms"], s["begin"])
        count, span = np.maximum(s["count"], 0) + 1, r["t_ms"] - begin
        ends = span >= width_ms
        hz = np.where(ends, count * 1000.0 / np.maximum(span, 1), np.nan)
        return {"begin": np.where(ends, r["t_ms"], begin), "count": np.where(ends, 0, count)}, _named(r, hz=hz)

    return _start(begin=np.int64(0), count=np.int64(-1)), step, "session_id long, event_id long, hz double"


def gnss_gate(floor_m: float = 15.0, streak: int = 5):
    """Plausible fixes, blended into a place. A fix without an accuracy counts as 5 m, one
    below 1 m as 1 m; beyond 30 m it is left alone. A jump beyond 3 accuracies + speed (25 at
    most) x time + ``floor_m`` is rejected, unless ``streak`` were in a row. The first fix is
    the place; later ones move it by 5 / accuracy, 0.15 to 1, of the way. Rows: ``t_ms``,
    ``east``, ``north``, ``accuracy``, ``speed``."""

    def step(s, r):
        accuracy = np.maximum(np.where(np.isnan(r["accuracy"]), 5.0, r["accuracy"]), 1.0)
        first, used = np.isnan(s["e"]), accuracy <= 30
        jump = np.where(first, 0.0, np.hypot(r["east"] - s["e"], r["north"] - s["n"]))
        gate = 3 * accuracy + np.minimum(r["speed"], 25.0) * np.clip((r["t_ms"] - s["t"]) / 1000, 0, 3600) + floor_m
        take = used & (first | (jump <= gate) | (s["rejected"] >= streak))
        k = np.where(first, 1.0, np.clip(5 / accuracy, 0.15, 1.0)) * take
        e, n = (np.where(first & take, r[x], s[x[0]] + np.where(take, k * (r[x] - s[x[0]]), 0.0)) for x in ("east", "north"))
        rejected = np.where(take, 0, s["rejected"] + used)
        return {"t": np.where(take, r["t_ms"], s["t"]), "e": e, "n": n, "rejected": rejected}, _named(r, accepted=take, jump_m=jump, east=e, north=n)

    return _start(t=np.int64(0), e=np.nan, n=np.nan, rejected=np.int64(0)), step, "session_id long, event_id long, accepted boolean, jump_m double, east double, north double"


def off_route(threshold_m: float = 35.0, near_m: float = 17.5, interval_ms: int = 2000, cooldown_ms: int = 20_000, turn_ms: int = 4000, least_speed: float = 1.0, streak: int = 4, turn_deg: float = 30.0):
    """Off-route decisions. In order: a route of two points, check interval, cooldown; a slow
    or undefined speed ends the streak; the heading reference is latched anew ``turn_ms``
    after the last; beyond the threshold the streak grows and fires at ``streak`` or with a
    turn, within ``near_m`` it ends. Rows: ``t_ms``, ``deviation_m``, ``heading``, ``speed`` and,
    if some routes may be shorter, ``route_points``."""

    def step(s, r):
        t = r["t_ms"]
        check = (s["checked"] < 0) | (t - s["checked"] >= interval_ms)
        check &= np.asarray(r.get("route_points", np.full(len(t), 2))) >= 2
        checked = np.where(check, t, s["checked"])
        awake = check & (t >= s["until"])
        slow = awake & ~(np.isfinite(r["speed"]) & (r["speed"] >= least_speed))
        moving = awake & ~slow
        latch = moving & (np.isnan(s["ref"]) | (t - s["ref_t"] >= turn_ms))
        ref, ref_t = np.where(latch, r["heading"], s["ref"]), np.where(latch, t, s["ref_t"])
        turn = np.where(moving, np.abs((r["heading"] - ref + 180) % 360 - 180), 0.0)
        away = moving & (r["deviation_m"] > threshold_m)
        count = np.where(away, s["count"] + 1, s["count"])
        fire = away & ((count >= streak) | (turn >= turn_deg))
        count = np.where(slow | fire | (moving & (r["deviation_m"] < near_m)), 0, count)
        made = {"checked": checked, "until": np.where(fire, t + cooldown_ms, s["until"]), "count": count, "ref": ref, "ref_t": ref_t}
        return made, _named(r, decision=np.where(fire, "RECALCULATE", "HOLD"), turn_deg=turn)

    return _start(checked=np.int64(-1), until=np.int64(-1), count=np.int64(0), ref=np.nan, ref_t=np.int64(0)), step, "session_id long, event_id long, decision string, turn_deg double"


def stood(s: State, elapsed, east, north, speed, fresh, stationary, least_m: float = 0.5, after_s: float = 30.0, least_speed: float = 1.0) -> tuple[State, np.ndarray]:
    """State (``e``, ``n``, ``since``, ``told``) and alert of places that should move: see ``frozen``."""
    still = np.asarray(stationary, bool)
    moved = (np.isnan(s["e"]) | (np.hypot(east - s["e"], north - s["n"]) > least_m)) & ~still
    calm = still | moved
    since = np.where(calm, elapsed, s["since"])
    alert = ~calm & ~s["told"] & (elapsed - since > after_s) & ~np.asarray(fresh, bool) & (speed > least_speed)
    return {"e": np.where(moved, east, s["e"]), "n": np.where(moved, north, s["n"]), "since": since, "told": (s["told"] | alert) & ~calm}, alert


def frozen(least_m: float = 0.5, after_s: float = 30.0, least_speed: float = 1.0):
    """Alerts once if a moving session's place stays within ``least_m`` for longer than
    ``after_s`` without a fresh fix. Rows: ``elapsed_s``, ``east``, ``north``, ``speed``, ``fresh``,
    ``stationary``."""

    def step(s, r):
        made, alert = stood(s, r["elapsed_s"], r["east"], r["north"], r["speed"], r["fresh"], r["stationary"], least_m, after_s, least_speed)
        return made, _named(r, alert=alert)

    return _start(e=np.nan, n=np.nan, since=0.0, told=False), step, "session_id long, event_id long, alert boolean"
