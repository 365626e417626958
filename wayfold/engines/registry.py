"""The engines by name, and how to run one.

An engine is ``(start, seed, fix, sample)``: first states, and what a session's seed, a
position fix and a motion sample do to them (routes are alike in all); ``sample`` gives the debug columns. New ones join
``ENGINES``. The pedestrian engine and the plain strapdown are window expressions instead.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.engines import fusion, iekf, pdr, snapping
from wayfold.engines import roads as network
from wayfold.functions.geo import move_enu
from wayfold.operators import folds

ENGINES = {"fusion": (fusion.start, fusion.seed, fusion.fix, fusion.sample), "iekf": (iekf.start, iekf.seed, iekf.fix, iekf.sample)}
#: Kinds of rows, in the order in which rows of one time are taken.
SEED, ROUTE, FIX, SAMPLE = 0, 1, 2, 3
SENSORS = [f"{s}_{x}" for s in ("accel", "gyro", "linear") for x in "xyz"] + [f"quat_{x}" for x in "xyzw"]
FIELDS = ["lat", "lon", "speed", "bearing", "accuracy"]
DEBUG = "acc_mag step_detected stride_length gyro_heading_rad mag_heading_rad fused_heading_rad forward_speed_mps yaw_rate_deg_s lateral_vel_mps bias_omega_mag bias_acc_mag nhc_residual_lat".split()
STATE = "dr_x_east dr_y_north vel_east vel_north heading_deg confidence_m".split()
FLAGS = "stationary off_line frozen too_fast gnss_rejects steps zupts".split()
SCHEMA = (
    "session_id long, timestamp_nanos long, kind int, lat0 double, lon0 double, " + ", ".join(f"{n} {'boolean' if n == 'step_detected' else 'double'}" for n in [*DEBUG, *STATE])
    + ", snap_mode string, stationary boolean, off_line boolean, frozen boolean, too_fast boolean, gnss_rejects long, steps long, zupts long"
)
POINTS = "array<struct<lat:double,lon:double>>"


def stepper(engine: str, roads: Callable | None = None, **hooks) -> tuple[Callable, Callable]:
    """``start`` and ``step`` of an engine for ``folds.scan``. ``roads`` gives the network
    (:class:`wayfold.engines.roads.Roads`) of all sessions; further ``hooks`` go to the
    engine's ``sample``. A seed begins a session, or begins it anew: all counters start over,
    route and network stay. A route replaces the last one, an empty one ends it."""
    start, seed, fix, sample = ENGINES[engine]

    def begin(s: dict, r: dict) -> None:
        memory = [snapping.kept(m) for m in s["memory"]]
        for n, v in start(len(memory)).items():
            s[n] = v
        s["memory"][:] = memory
        seed(s, r)

    def reroute(s: dict, r: dict) -> None:
        for k, points in enumerate(r["route"]):
            snapping.set_route(s, k, points)

    def move(s: dict, r: dict) -> dict:
        return sample(s, r, roads=roads() if roads else None, **hooks)

    def step(s: dict, r: dict) -> tuple[dict, dict]:
        kind, many = np.asarray(r["kind"]), len(r["kind"])
        debug = {n: np.full(many, np.nan) for n in DEBUG} | {"step_detected": np.zeros(many, bool)}
        for value, act in ((SEED, begin), (ROUTE, reroute), (FIX, fix), (SAMPLE, move)):
            at = np.flatnonzero(kind == value)
            if len(at):
                own = {n: v[at] for n, v in s.items()}
                made = act(own, {n: v[at] for n, v in r.items()})
                for n, v in own.items():
                    s[n][at] = v
                for n, v in (made or {}).items():
                    debug[n][at] = v
        out = {"session_id": r["session_id"], "timestamp_nanos": r["t_nanos"], "kind": kind, "lat0": s["lat_lon"][:, 0], "lon0": s["lat_lon"][:, 1], **debug}
        out |= {"dr_x_east": s["out_x"], "dr_y_north": s["out_y"], "vel_east": s["out_v"][:, 0], "vel_north": s["out_v"][:, 1], "heading_deg": s["out_heading"], "confidence_m": s["confidence"]}
        return s, out | {"snap_mode": s["mode"]} | {n: s["rejects" if n == "gnss_rejects" else n] for n in FLAGS}

    return start, step


def event_rows(samples: DataFrame, seeds: DataFrame, gps: DataFrame | None = None, routes: DataFrame | None = None, changes: DataFrame | None = None, resets: DataFrame | None = None, own_roads: DataFrame | None = None) -> DataFrame:
    """Everything that happens to sessions as rows of one table, as ``stepper`` takes them; see
    ``run`` for the inputs."""
    number = lambda df, names: [F.col(n).cast("double").alias(n) if n in df.columns else F.lit(None).cast("double").alias(n) for n in names]
    nothing = lambda names: [F.lit(None).cast("double").alias(n) for n in names]
    none, no_edges = F.lit(None).cast(POINTS).alias("route"), F.lit(None).cast(f"array<{network.EDGE}>").alias("roads")
    offset = seeds.select("session_id", F.coalesce("boot_offset_ms", F.lit(0)).alias("_boot"))
    nanos = ((F.col("t_ms") - F.col("_boot")) * 1_000_000).alias("t_nanos")
    places = seeds if routes is None else seeds.join(routes.select("session_id", F.col("points").cast(POINTS).alias("route")), "session_id", "left")
    places = places if own_roads is None else places.join(own_roads, "session_id", "left")
    given = lambda name, other: F.col(name) if name in places.columns else other
    least = F.lit(-(1 << 62)).cast("long")
    rows = places.select("session_id", F.lit(SEED).alias("kind"), least.alias("t_nanos"), F.lit(0).cast("long").alias("t_ms"), *number(places, FIELDS), *nothing(SENSORS), given("route", none).alias("route"), given("roads", no_edges).alias("roads"))
    moves = samples.join(offset, "session_id")
    wall = (F.expr("timestamp_nanos div 1000000") + F.col("_boot")).alias("t_ms")
    rows = rows.union(moves.select("session_id", F.lit(SAMPLE).alias("kind"), F.col("timestamp_nanos").alias("t_nanos"), wall, *nothing(FIELDS), *number(moves, SENSORS), none, no_edges))
    for more, kind in ((gps, FIX), (resets, SEED), (changes, ROUTE)):
        if more is not None:
            timed = more.join(offset, "session_id")
            route = F.col("points").cast(POINTS).alias("route") if kind == ROUTE else none
            rows = rows.union(timed.select("session_id", F.lit(kind).alias("kind"), nanos, "t_ms", *number(timed, FIELDS), *nothing(SENSORS), route, no_edges))
    return rows


def run(samples: DataFrame, seeds: DataFrame, gps: DataFrame | None = None, engine: str = "iekf", gnss_mode: str = "off", routes: DataFrame | None = None, changes: DataFrame | None = None, resets: DataFrame | None = None, roads: tuple[DataFrame, DataFrame, DataFrame] | None = None, **hooks) -> DataFrame:
    """State of every motion sample of each session, by the named engine.

    ``seeds`` has ``session_id``, ``lat``, ``lon``, ``bearing``, ``speed`` and the clock's
    ``boot_offset_ms``; ``gps`` (used with ``gnss_mode='fused'`` only) ``session_id``, ``t_ms`` and
    the fields of a fix; ``routes`` ``session_id`` and ``points``, an array of (lat, lon), from
    the start on. ``changes`` (``session_id, t_ms, points``) replace the route at a time (null
    or one point: none), ``resets`` (``session_id, t_ms`` and the fields of a seed) begin the
    session anew. ``roads`` is a catalog of graphs (origins, nodes, edges): where a session has
    neither route nor trail it is matched to the network. Of rows at one time seeds come first,
    then routes, then fixes. Fixes are fresh for 8 s of the samples' own time.
    """
    if engine == "pdr":
        return pdr.walk(samples, seeds, **hooks)
    gps, own_roads = gps if gnss_mode == "fused" else None, None
    if roads is not None:
        table = network.network(*roads)
        if network.small(table):
            index = samples.sparkSession.sparkContext.broadcast(network.packed(table))
            hooks["roads"] = lambda: index.value
        else:
            places = [x.select("session_id", "lat", "lon") for x in (seeds, gps, resets) if x is not None]
            spans = samples.groupBy("session_id").agg(((F.max("timestamp_nanos") - F.min("timestamp_nanos")) / 1e9).alias("seconds"))
            own_roads = network.within_reach(table, reduce(DataFrame.union, places).where("lat is not null"), spans)
    start, step = stepper(engine, **hooks)
    rows = event_rows(samples, seeds, gps, routes, changes, resets, own_roads)
    made = folds.scan(rows, ["session_id"], ["t_nanos", "kind"], SCHEMA, start, step).where(F.col("kind") == SAMPLE)
    moved = move_enu(F.col("lat0"), F.col("lon0"), F.col("dr_x_east"), F.col("dr_y_north"))
    return made.select("session_id", "timestamp_nanos", moved["lat"].alias("dr_lat"), moved["lon"].alias("dr_lon"), *STATE, *DEBUG, "snap_mode", *FLAGS)
