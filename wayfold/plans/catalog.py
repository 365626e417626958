"""Registered queries of the library and the SQL that states the same results.

Doubles are rounded to six places on both sides. Every ordering is total.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.engines import registry
from wayfold.functions import geo, linalg
from wayfold.operators import asof, evaluate, folds, graph, ordered, sessions, spans, spatial
from wayfold.operators.lineage import settled
from wayfold.plans import oracle
from wayfold.sources import telemetry

KEY, ORDER = ["session_id"], ["t_ms", "event_id"]
GATE_MS = 3_600_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = oracle.SQL


def query(f):
    QUERIES[f.__name__] = f
    return f


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + oracle.TIE, 6) + F.lit(0.0)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


@query
def session_stats(spark, sf_dir):
    """Error statistics by session."""
    f = telemetry.fixes(spark, sf_dir)
    made = evaluate.session_stats(telemetry.truth(f), telemetry.estimates(f), GATE_MS)
    return rounded(made, "current_error_m", "final_error_m", "max_error_m", "mean_error_m", "distance_travelled_m", "drift_pct")


@query
def nearest_match_error(spark, sf_dir):
    """J1, G1."""
    f = telemetry.fixes(spark, sf_dir)
    made = evaluate.matched(telemetry.truth(f), telemetry.estimates(f), GATE_MS)
    return made.select("event_id", "session_id", "t_ms", "m_t_ms", r6("error_m").alias("error_m"))


@query
def running_distance(spark, sf_dir):
    """W1, W2."""
    made = ordered.running_distance(telemetry.fixes(spark, sf_dir), KEY, ORDER)
    return made.select("event_id", r6("step_m").alias("step_m"), r6("distance_m").alias("distance_m"))


@query
def nav_export(spark, sf_dir):
    """K1, U1, L2."""
    f = telemetry.fixes(spark, sf_dir)
    return rounded(evaluate.nav_table(telemetry.truth(f), telemetry.estimates(f), GATE_MS), "gps_lat", "gps_lon", "dr_lat", "dr_lon", "position_error_m", "distance_m", "drift_pct")


@query
def zoh_align(spark, sf_dir):
    """An event type for each sensor; clicks and views trigger."""
    f = telemetry.fixes(spark, sf_dir)
    made = asof.zero_order_hold(f, KEY, ORDER, "event_type", "value", ["click", "view"], ["purchase"])
    return made.select("event_id", "session_id", "t_ms", "h_click", "h_view", "h_purchase")


@query
def pose_resolution(spark, sf_dir):
    """A pose for every other event."""
    f = telemetry.fixes(spark, sf_dir)
    asked = f.where("event_type not in ('click', 'view')").select("event_id", "session_id", "t_ms")
    made = asof.resolve_pose(asked, telemetry.truth(f), telemetry.estimates(f), KEY, "t_ms", GATE_MS)
    return rounded(made.select("event_id", "pose_lat", "pose_lon", "pose_heading", "pose_speed", "source"), "pose_lat", "pose_lon", "pose_heading", "pose_speed")


@query
def step_detect(spark, sf_dir):
    """E1, W3."""
    made = ordered.detect_steps(telemetry.fixes(spark, sf_dir), KEY, ORDER, "value", 20.0)
    return made.select("event_id", "is_step")


@query
def stride_decimate(spark, sf_dir):
    """L1, L2 with a small limit."""
    return ordered.stride_decimate(telemetry.fixes(spark, sf_dir), KEY, ORDER, "t_ms", 20).select("event_id", "session_id", "t_ms")


@query
def tail_points(spark, sf_dir):
    """L3."""
    return ordered.tail(telemetry.fixes(spark, sf_dir), KEY, [F.desc("t_ms"), F.desc("event_id")], 10).select("event_id", "session_id", "t_ms")


@query
def chunk_retention(spark, sf_dir):
    """L4."""
    return ordered.chunk_retained(telemetry.fixes(spark, sf_dir), KEY, [F.desc("t_ms"), F.desc("event_id")], 50, 7).select("event_id", "session_id")


@query
def greedy_throttle(spark, sf_dir):
    """L5."""
    f = telemetry.fixes(spark, sf_dir).select("session_id", "event_id", "t_ms")
    start, step, schema = folds.throttle(12 * 3_600_000)
    return folds.scan(f, KEY, ORDER, schema, start, step)


@query
def iir_lowpass(spark, sf_dir):
    """E7."""
    f = telemetry.fixes(spark, sf_dir).select("session_id", "event_id", "t_ms", "value")
    start, step, schema = folds.low_pass(0.25)
    return rounded(folds.scan(f, KEY, ORDER, schema, start, step), "y")


@query
def gnss_gate(spark, sf_dir):
    """Gate and blend of places in local metres, accuracy from the heading."""
    f = telemetry.fixes(spark, sf_dir)
    enu = geo.to_enu(F.col("lat"), F.col("lon"), F.lit(48.0), F.lit(11.0))
    rows = f.select("session_id", "event_id", "t_ms", enu["east"].alias("east"), enu["north"].alias("north"), (1 + F.col("heading") / 4).alias("accuracy"), F.lit(0.0).alias("speed"))
    start, step, schema = folds.gnss_gate()
    return rounded(folds.scan(rows, KEY, ORDER, schema, start, step), "jump_m", "east", "north")


@query
def off_route_events(spark, sf_dir):
    """The value is the deviation; hours take the place of seconds."""
    f = telemetry.fixes(spark, sf_dir)
    rows = f.select("session_id", "event_id", "t_ms", F.col("value").alias("deviation_m"), "heading", (F.col("value") / 10).alias("speed"))
    start, step, schema = folds.off_route(threshold_m=200.0, near_m=100.0, interval_ms=7_200_000, cooldown_ms=72_000_000, turn_ms=36_000_000)
    return rounded(folds.scan(rows, KEY, ORDER, schema, start, step), "turn_deg")


@query
def rate_hz(spark, sf_dir):
    """Events of each day."""
    return rounded(ordered.rates(telemetry.fixes(spark, sf_dir), KEY, "t_ms", 86_400_000), "hz")


@query
def session_counts(spark, sf_dir):
    """R3, R5."""
    f = telemetry.fixes(spark, sf_dir)
    kinds = {f"n_{k}": F.count_if(F.col("event_type") == k) for k in ("click", "view", "purchase")}
    return f.groupBy("session_id").agg(F.count("*").alias("n_rows"), *(c.alias(n) for n, c in kinds.items()))


@query
def geo_functions(spark, sf_dir):
    """G1 to G13 on every fix."""
    f = telemetry.fixes(spark, sf_dir)
    lat, lon, h, v = (F.col(c) for c in ("lat", "lon", "heading", "value"))
    moved = geo.move_enu(lat, lon, v, v / 2)
    back = geo.to_enu(moved["lat"], moved["lon"], lat, lon)
    wide = geo.to_enu(lat, lon, F.lit(48.0), F.lit(11.0), geo.EQUATOR)
    flat = geo.local_metres(lat, lon, F.lit(48.0), F.lit(11.0))
    made = {
        "hav_m": geo.haversine_m(lat, lon, F.lit(48.0), F.lit(11.0)), "moved_lat": moved["lat"], "moved_lon": moved["lon"], "back_east": back["east"], "back_north": back["north"],
        "wide_east": wide["east"], "flat_north": flat["north"], "normal": geo.normalize_heading(h - 500), "turn": geo.angle_diff_deg(h, v), "abs_turn": geo.abs_angle_diff_deg(h, v),
        "bearing": geo.bearing_from_enu(v - 250, h - 180), "drift": geo.drift_percent(v, h), "compass": geo.to_compass_deg(v / 100),
    }
    return f.select("event_id", *(r6(c).alias(n) for n, c in made.items()), geo.valid_coordinates(lat, lon).alias("valid"))


def _parts(spark, sf_dir) -> DataFrame:
    """Three-vectors, a unit quaternion and a matrix of every embedding."""
    part = lambda a, n: F.slice("v", a + 1, n)
    v = telemetry.vectors(spark, sf_dir).where("size(v) >= 32").select("vec_id", part(0, 3).alias("a"), part(3, 3).alias("b"), part(6, 4).alias("q"), part(10, 9).alias("m"))
    size = F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, x: s + x * x))
    return v.withColumn("q", F.transform("q", lambda x: F.try_divide(x, size)))


@query
def rotation_functions(spark, sf_dir):
    """Matrix of a quaternion, both products, yaw, gravity."""
    v = _parts(spark, sf_dir)
    v = v.withColumn("r", linalg.quat_matrix(*(linalg.at(F.col("q"), i) for i in range(4))))
    turned, back, down = linalg.mat_vec(F.col("r"), F.col("a")), linalg.mat_t_vec(F.col("r"), F.col("a")), linalg.gravity_phone(F.col("r"))
    made = {f"{n}{i}": linalg.at(c, i) for n, c in (("turned", turned), ("back", back), ("down", down)) for i in range(3)}
    return v.select("vec_id", *(r6(c).alias(n) for n, c in made.items()), r6(linalg.yaw_deg(F.col("r"))).alias("yaw"), r6(linalg.norm3(F.col("a"))).alias("length"))


@query
def vector_functions(spark, sf_dir):
    """Products, the rotation of a vector, shortening."""
    v = _parts(spark, sf_dir).withColumn("e", linalg.so3_exp(F.col("a")))
    cross, short, prod = linalg.cross(F.col("a"), F.col("b")), linalg.clamp_length(F.col("a"), 0.1), linalg.mat_mat(F.col("e"), F.col("m"))
    made = {f"{n}{i}": linalg.at(c, i) for n, c in (("cross", cross), ("short", short)) for i in range(3)} | {f"exp{i}": linalg.at(F.col("e"), i) for i in range(9)} | {f"prod{i}": linalg.at(prod, i) for i in (0, 4, 8)}
    return v.select("vec_id", *(r6(c).alias(n) for n, c in made.items()), r6(linalg.dot(F.col("a"), F.col("b"))).alias("dot"))


@query
def heading_functions(spark, sf_dir):
    """Magnetic and blended heading."""
    v = _parts(spark, sf_dir)
    mag = linalg.magnetic_heading(F.col("a"), F.col("b"))
    return v.select("vec_id", r6(mag).alias("mag"), r6(linalg.complementary(linalg.at(F.col("a"), 0) * 20, linalg.at(F.col("b"), 0) * 20)).alias("fused"))


@query
def gyro_chain(spark, sf_dir):
    """E2, E3, F2, F3 at 100 Hz."""
    f = telemetry.fixes(spark, sf_dir).withColumn("rate", F.col("value") / 1000)
    f = ordered.gyro_bias(f, KEY, ORDER, "rate", 20)
    f = ordered.gyro_delta(f, KEY, ORDER, "rate", "t_ms", "bias")
    return f.select("event_id", r6("bias").alias("bias"), r6("dt").alias("dt"), r6("delta").alias("delta"))


@query
def standstill_runs(spark, sf_dir):
    """W7, E9's still time: how long the value has stayed below 250."""
    made = ordered.runs(telemetry.fixes(spark, sf_dir), KEY, ORDER, F.col("value") < 250)
    return made.select("event_id", "run_no", "run_rows", (F.col("run_rows") >= 3).alias("still"))


@query
def baseline_dr(spark, sf_dir):
    """Strapdown at 100 Hz; accelerations from value and heading."""
    f = telemetry.fixes(spark, sf_dir)
    f = f.withColumns({"dt": F.lit(0.01), "ae": F.col("value") / 100 * F.sin(F.radians("heading")), "an": F.col("value") / 100 * F.cos(F.radians("heading"))})
    made = ordered.strapdown(f, KEY, ORDER, "dt", "ae", "an")
    return rounded(made.select("event_id", "vel_east", "vel_north", "x_east", "y_north", "confidence_m"), "vel_east", "vel_north", "x_east", "y_north", "confidence_m")


def _routes(spark, sf_dir) -> DataFrame:
    """A polyline of the click places of each session, in local metres."""
    f = telemetry.truth(telemetry.fixes(spark, sf_dir))
    enu = geo.to_enu(F.col("lat"), F.col("lon"), F.lit(48.0), F.lit(11.0))
    f = f.withColumn("seg_no", F.row_number().over(ordered.Window.partitionBy("session_id").orderBy(*ORDER)))
    return spatial.segments(f.select(F.col("session_id").alias("route_id"), "seg_no", enu["east"].alias("east"), enu["north"].alias("north")))


@query
def arc_length(spark, sf_dir):
    """W4."""
    return _routes(spark, sf_dir).select("route_id", "seg_no", r6("len").alias("len"), r6("cum_s").alias("cum_s"))


@query
def polyline_match(spark, sf_dir):
    """Every view against the route of its session."""
    f = telemetry.estimates(telemetry.fixes(spark, sf_dir))
    enu = geo.to_enu(F.col("lat"), F.col("lon"), F.lit(48.0), F.lit(11.0))
    points = f.select("event_id", F.col("session_id").alias("route_id"), enu["east"].alias("east"), enu["north"].alias("north"))
    made = spatial.polyline_match(points, _routes(spark, sf_dir))
    return made.select("event_id", "seg_no", r6("distance_m").alias("distance_m"), r6("bearing").alias("bearing"), r6("route_s").alias("route_s"))


def _roads(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Nations as nodes on a plane, joined by a rule on their keys, a third one-way."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("k"))
    nodes = n.select(F.lit(0).alias("graph_id"), F.col("k").alias("node_id"), ((F.col("k") * 37) % 100).cast("double").alias("east"), ((F.col("k") * 53) % 90).cast("double").alias("north"))
    hop = F.explode(F.array(F.lit(1), F.lit(7)))
    links = n.select("k", hop.alias("h")).select(F.lit(0).alias("graph_id"), F.col("k").alias("a"), ((F.col("k") + F.col("h")) % 25).alias("b"), F.when(F.col("k") % 3 == 0, "YES").otherwise("-1").alias("oneway"))
    return nodes, telemetry.directed(nodes, links)


@query
def graph_edges(spark, sf_dir):
    """S5, J10, X3."""
    return _roads(spark, sf_dir)[1].select("a", "b", r6("cost").alias("cost"))


@query
def road_snap(spark, sf_dir):
    """Suppliers on the plane of the road graph."""
    nodes, edges = _roads(spark, sf_dir)
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("point_id"))
    points = s.select("point_id", ((F.col("point_id") * 17) % 110).cast("double").alias("east"), ((F.col("point_id") * 29) % 95).cast("double").alias("north"), ((F.col("point_id") * 7) % 360).cast("double").alias("heading"))
    made = spatial.road_snap(points, nodes, edges, 30.0)
    return rounded(made.select("point_id", "a", "b", "score", "px", "py"), "score", "px", "py")


@query
def nearest_node(spark, sf_dir):
    """J9, F6."""
    nodes, _ = _roads(spark, sf_dir)
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("point_id"))
    points = s.select("point_id", ((F.col("point_id") * 17) % 110).cast("double").alias("east"), ((F.col("point_id") * 29) % 95).cast("double").alias("north"))
    return rounded(graph.nearest_nodes(points, nodes, 40.0).select("point_id", "node_id", "off"), "off")


@query
def shortest_path(spark, sf_dir):
    """Least cost from every node to every other."""
    nodes, edges = _roads(spark, sf_dir)
    made = graph.distances(nodes.select("graph_id", F.col("node_id").alias("source")), edges)
    return made.select("source", "node", r6("dist").alias("dist"))


@query
def heading_route(spark, sf_dir):
    """From each supplier, by its heading, to a common place."""
    nodes, edges = _roads(spark, sf_dir)
    made = graph.first_graph(graph.heading_routes(_asked(spark, sf_dir), nodes, edges, radius=30.0))
    return rounded(made.select("point_id", "source", "px", "py", "node", "dist", "fallback"), "px", "py", "dist")


def _asked(spark, sf_dir) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("point_id"))
    return s.select("point_id", ((F.col("point_id") * 17) % 110).cast("double").alias("east"), ((F.col("point_id") * 29) % 95).cast("double").alias("north"), ((F.col("point_id") * 7) % 360).cast("double").alias("heading"), F.lit(50.0).alias("goal_east"), F.lit(45.0).alias("goal_north"))


@query
def route_points(spark, sf_dir):
    """The points of those routes."""
    nodes, edges = _roads(spark, sf_dir)
    found = graph.first_graph(graph.heading_routes(_asked(spark, sf_dir), nodes, edges, radius=30.0, with_path=True))
    return rounded(graph.route_points(found, nodes), "east", "north")


@query
def step_throttle(spark, sf_dir):
    """L5 with steps: values over 450 pass at once."""
    f = telemetry.fixes(spark, sf_dir).select("session_id", "event_id", "t_ms", (F.col("value") > 450).alias("is_step"))
    start, step, schema = folds.throttle(12 * 3_600_000)
    return folds.scan(f, KEY, ORDER, schema, start, step)


@query
def distance_decimate(spark, sf_dir):
    """Places 300 m apart, at a speed of 100 or more."""
    f = telemetry.fixes(spark, sf_dir)
    enu = geo.to_enu(F.col("lat"), F.col("lon"), F.lit(48.0), F.lit(11.0))
    start, step, schema = folds.spaced(300.0, 100.0)
    return folds.scan(f.select("session_id", "event_id", "t_ms", enu["east"].alias("east"), enu["north"].alias("north"), F.col("value").alias("speed")), KEY, ORDER, schema, start, step)


@query
def rate_windows(spark, sf_dir):
    """R4 as it is measured: a window ends with the first event a day after it began."""
    start, step, schema = folds.rate_windows(86_400_000)
    return rounded(folds.scan(telemetry.fixes(spark, sf_dir).select("session_id", "event_id", "t_ms"), KEY, ORDER, schema, start, step), "hz")


@query
def time_constant(spark, sf_dir):
    """A filter of 0.4 s over guarded intervals."""
    f = telemetry.fixes(spark, sf_dir)
    gap = (F.col("t_ms") - F.lag("t_ms").over(ordered.Window.partitionBy(*KEY).orderBy(*ORDER))).cast("double") / 1e9
    f = f.select("session_id", "event_id", "t_ms", "value", ordered.interval(gap, "clamp").alias("dt"))
    start, step, schema = folds.smooth(0.4)
    return rounded(folds.scan(f, KEY, ORDER, schema, start, step), "y")


@query
def still_time(spark, sf_dir):
    """Quiet below 250, each event half a second."""
    f = telemetry.fixes(spark, sf_dir).withColumns({"dt": F.lit(0.5), "speed": F.col("heading") / 100})
    made = ordered.standstill(f, KEY, ORDER, F.col("value") < 250, "dt", "speed")
    return made.select("event_id", r6("still_s").alias("still_s"), "stationary")


@query
def nearest_gate(spark, sf_dir):
    """J1 at its own gate of 2 s, included: an event each 500 ms."""
    f = telemetry.fixes(spark, sf_dir)
    f = f.withColumn("t_ms", F.row_number().over(ordered.Window.partitionBy(*KEY).orderBy(*ORDER)).cast("long") * 500)
    made = evaluate.matched(telemetry.truth(f), telemetry.estimates(f), 2000)
    return made.select("event_id", "t_ms", "m_t_ms", r6("error_m").alias("error_m"))


@query
def session_seed(spark, sf_dir):
    """Where each session begins."""
    f = telemetry.fixes(spark, sf_dir)
    last = lambda kind: f.where(F.col("event_type") == kind).groupBy("session_id").agg(F.max_by(F.struct("lat", "lon", "heading", "value"), F.struct("t_ms", "event_id")).alias("r"))
    begun = f.select("session_id").distinct().join(last("purchase"), "session_id", "left")
    begun = begun.select("session_id", "r.lat", "r.lon", F.when(F.col("r.heading") > 90, F.col("r.heading")).alias("bearing"), F.col("r.value").alias("speed"), (F.col("session_id") % 360).cast("double").alias("device_yaw"))
    made = telemetry.seed(begun, last("click").select("session_id", "r.lat", "r.lon"), (16.3067, 80.4365))
    return rounded(made, "lat", "lon", "heading", "vel_east", "vel_north")


@query
def matrix_functions(spark, sf_dir):
    """Transpose, orthonormal rows, pitch and roll."""
    v = _parts(spark, sf_dir).withColumn("r", linalg.quat_matrix(*(linalg.at(F.col("q"), i) for i in range(4)))).withColumn("o", linalg.orthonormal(F.col("m")))
    made = {f"t{i}": linalg.at(linalg.transpose(F.col("m")), i) for i in (1, 2, 5)} | {f"o{i}": linalg.at(F.col("o"), i) for i in range(6)} | {"pitch": linalg.pitch_deg(F.col("r")), "roll": linalg.roll_deg(F.col("r"))}
    return v.select("vec_id", *(r6(c).alias(n) for n, c in made.items()))


@query
def filter_functions(spark, sf_dir):
    """Latched heading, intervals, accuracy, recalculation guard."""
    f = telemetry.fixes(spark, sf_dir)
    gap = (F.col("t_ms") - F.lag("t_ms").over(ordered.Window.partitionBy(*KEY).orderBy(*ORDER))).cast("double") / 1e7
    accuracy = F.when(F.col("heading") > 20, F.col("heading") / 5)
    return f.select(
        "event_id", *(r6(ordered.interval(gap, k)).alias(k) for k in ("glitch", "clamp", "elapsed")), r6(ordered.mount_heading(F.col("heading"), KEY, ORDER)).alias("mount"), r6(evaluate.usable_accuracy(accuracy)).alias("accuracy"),
        evaluate.may_recalculate(F.when(F.col("event_type") == "view", "DR").otherwise("GPS"), F.col("value")).alias("may"), F.expr("t_ms div 1000").alias("whole_s"),
    )


@query
def status_texts(spark, sf_dir):
    """Numbers and flags as the screen shows them, names of exports."""
    s = session_stats(spark, sf_dir)
    flags = {"ZUPT_active": F.col("matches") == 0, "mount_aligned": F.col("matches") > 1}
    begun = telemetry.fixes(spark, sf_dir).groupBy("session_id").agg(F.min("t_ms").alias("start_ms"))
    return s.join(begun, "session_id").select(
        "session_id", evaluate.metres_text(F.col("max_error_m")).alias("worst"), evaluate.percent_text(F.col("drift_pct")).alias("drift"),
        evaluate.status_text(F.lit("waiting for GNSS"), F.lit("FREE"), **flags).alias("health"), evaluate.export_name(F.col("start_ms"), "nav").alias("file"),
    )


def _motion(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Events as motion samples at 100 Hz, accelerations and rates from value and heading, and
    where each session begins."""
    f = telemetry.fixes(spark, sf_dir)
    nanos = F.row_number().over(ordered.Window.partitionBy(*KEY).orderBy(*ORDER)).cast("long") * 10_000_000
    push, angle = (F.col("value") - 250) / 100, F.radians("heading")
    made = {"accel_x": push * F.sin(angle), "accel_y": push * F.cos(angle), "accel_z": 9.80665 + (F.col("heading") - 180) / 60, "gyro_x": push / 100, "gyro_y": -push / 200, "gyro_z": (F.col("heading") - 180) / 1000, "mag_x": 20 * F.cos(angle), "mag_y": 20 * F.sin(angle), "mag_z": F.lit(-40.0)}
    none = {f"{s}_{x}": F.lit(None).cast("double") for s in ("linear", "gravity") for x in "xyz"} | {f"quat_{x}": F.lit(None).cast("double") for x in "xyzw"}
    seeds = f.select("session_id").distinct().select("session_id", F.lit(48.0).alias("lat"), F.lit(11.0).alias("lon"), (F.col("session_id") % 360).cast("double").alias("bearing"), F.lit(5.0).alias("speed"), F.lit(0).alias("boot_offset_ms"))
    return f.select("session_id", nanos.alias("timestamp_nanos"), *(c.alias(n) for n, c in (made | none).items())), seeds


@query
def imu_export(spark, sf_dir):
    """Raw motion samples."""
    made = evaluate.imu_table(_motion(spark, sf_dir)[0])
    return rounded(made, *(f"{s}_{x}" for s in ("accel", "gyro", "mag") for x in "xyz"))


@query
def pdr_dr(spark, sf_dir):
    """The pedestrian engine's states as they are exported."""
    made = evaluate.state_table(registry.run(*_motion(spark, sf_dir), engine="pdr"))
    return rounded(made, *(n for n, kind in made.dtypes if kind == "double"))


@query
def fusion_dr(spark, sf_dir):
    """Route-aware fusion."""
    return evaluate.state_table(registry.run(*_motion(spark, sf_dir), engine="fusion"))


@query
def iekf_dr(spark, sf_dir):
    """The invariant filter."""
    return evaluate.state_table(registry.run(*_motion(spark, sf_dir), engine="iekf"))


@query
def live_snapshot(spark, sf_dir):
    """K6, K7's follow target: the state of every session at the end."""
    f = telemetry.fixes(spark, sf_dir)
    made = evaluate.live_snapshot(telemetry.truth(f), telemetry.estimates(f), GATE_MS)
    return rounded(made, "gps_lat", "gps_lon", "dr_lat", "dr_lon", "follow_lat", "follow_lon", "current_error_m", "distance_travelled_m")


@query
def route_synthesis(spark, sf_dir):
    """From each supplier to a common place."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("point_id"))
    line = graph.straight_route(((F.col("point_id") * 17) % 1100).cast("double"), ((F.col("point_id") * 29) % 950).cast("double"), F.lit(500.0), F.lit(500.0))
    made = s.select("point_id", F.posexplode(line).alias("i", "p"))
    return made.select("point_id", "i", r6("p.east").alias("east"), r6("p.north").alias("north"))


@query
def health_text(spark, sf_dir):
    """A status line by session."""
    f = telemetry.fixes(spark, sf_dir)
    s = f.groupBy("session_id").agg(F.count("*").alias("n"), F.round(F.max("value"), 1).alias("top"), F.count_if(F.col("heading") > 180).alias("back"))
    text = F.concat_ws(" | ", F.concat(F.lit("rows "), F.col("n").cast("string")), F.when(F.col("back") > 0, F.concat(F.lit("turned "), F.col("back").cast("string"))), F.when(F.col("top") > 480, F.lit("FAST @ limit")))
    return s.select("session_id", text.alias("health"), F.substring_index(text, " @", 1).alias("short"), F.expr("try_cast(top as int)").alias("top_whole"))


@query
def json_roundtrip(spark, sf_dir):
    """Built and parsed JSON."""
    f = telemetry.fixes(spark, sf_dir)
    body = F.to_json(F.struct(F.array("lat", "lon").alias("start"), F.array(F.lit(1.0), F.lit(2.0)).alias("destination"), F.lit("cache").alias("source"), F.col("t_ms").alias("timestamp"), F.array(F.array("lat", "lon")).alias("points")))
    points = telemetry.cached_route(body, (48.005, 11.005), (1.0, 2.0))
    return f.select("event_id", F.size(F.coalesce(points, F.array().cast("array<array<double>>"))).alias("n_points"), F.from_json(body, telemetry.ROUTE)["timestamp"].alias("stored_ms"))


#: Commands by the last digit of an event's number.
VERBS = ["START", "START", "STOP", "RESET", "ENGINE_ON", "START", "ENGINE_ON", "STOP", "ENGINE_OFF", "START"]
DAY_MS = 86_400_000


@query
def recorded_samples(spark, sf_dir):
    """F1, E26, the session verbs: errors are commands, other events samples."""
    f = telemetry.fixes(spark, sf_dir)
    verb = F.get(F.array(*map(F.lit, VERBS)), (F.col("event_id") % 10).cast("int"))
    verbs = f.where("event_type = 'error'").select("session_id", "t_ms", "event_id", verb.alias("verb"))
    samples = f.where("event_type <> 'error'").select("session_id", "t_ms", "event_id")
    return sessions.recorded(samples, verbs, KEY, "t_ms", "event_id", 3 * DAY_MS).select("event_id", "recording_no", "sample_no", "since_ms", "engine_on")


def _asked_routes(f: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Purchases set or clear destinations; signups answer requests of three days each."""
    destinations = f.where("event_type = 'purchase'").select("session_id", "t_ms", F.col("event_id").alias("order"), F.when(F.col("event_id") % 4 > 0, F.col("event_id") % 4).alias("dest"))
    request = F.expr(f"t_ms div {3 * DAY_MS}")
    source = F.when(F.col("event_id") % 2 == 0, "online").otherwise("offline")
    answers = f.where("event_type = 'signup'").select("session_id", "t_ms", request.alias("request_id"), (1 + request % 3).alias("dest"), source.alias("source"), (F.col("event_id") % 5).alias("n_points"))
    return destinations, answers


@query
def route_choice(spark, sf_dir):
    """Which route a session follows at each event."""
    f = telemetry.fixes(spark, sf_dir)
    timeline = sessions.route_timeline(*_asked_routes(f), KEY, "t_ms", 3 * DAY_MS)
    samples = f.where("event_type not in ('purchase', 'signup')").select("session_id", "t_ms", "event_id")
    return sessions.followed(samples, timeline, KEY, "t_ms", 3 * DAY_MS).select("event_id", "dest", "source", "request_id")


def _catalog(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two graphs with origins some fifty metres apart, the second one mirrored."""
    nodes, edges = _roads(spark, sf_dir)
    origins = spark.range(2).select(F.col("id").cast("int").alias("graph_id"), (48.0 + F.col("id") / 2000).alias("lat0"), (11.0 + F.col("id") / 2000).alias("lon0"))
    mirrored = nodes.select(F.lit(1).alias("graph_id"), "node_id", (100 - F.col("east")).alias("east"), "north")
    return origins, nodes.union(mirrored), edges.union(edges.select(F.lit(1).alias("graph_id"), "a", "b", "cost"))


@query
def road_catalog(spark, sf_dir):
    """Suppliers on the best edge of two graphs."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("point_id"))
    lat, lon = 48.0 + ((F.col("point_id") * 29) % 150).cast("double") / 100_000, 11.0 + ((F.col("point_id") * 17) % 210).cast("double") / 100_000
    made = spatial.catalog_snap(s.select("point_id", lat.alias("lat"), lon.alias("lon"), ((F.col("point_id") * 7) % 360).cast("double").alias("heading")), *_catalog(spark, sf_dir), radius=30.0)
    return rounded(made.select("point_id", F.col("graph_id").cast("int").alias("graph_id"), "a", "b", "score", "off", "lat", "lon"), "score", "off", "lat", "lon")


def _track(made: DataFrame) -> DataFrame:
    return rounded(made.select("session_id", "timestamp_nanos", "snap_mode", "dr_lat", "dr_lon", "dr_x_east", "dr_y_north", "heading_deg", "steps", "zupts", "frozen", "too_fast"), "dr_lat", "dr_lon", "dr_x_east", "dr_y_north", "heading_deg")


@query
def road_fusion_dr(spark, sf_dir):
    """Fusion without a destination, matched to a catalog of two graphs."""
    return _track(registry.run(*_motion(spark, sf_dir), engine="fusion", roads=_catalog(spark, sf_dir)))


@query
def rerouted_dr(spark, sf_dir):
    """Purchases set a route ahead or clear it, signups of one number in twenty
    begin the session anew."""
    f = telemetry.fixes(spark, sf_dir)
    at = F.row_number().over(ordered.Window.partitionBy(*KEY).orderBy(*ORDER)).cast("long") * 10
    f = f.withColumn("at", at)
    step = lambda k: F.struct((48.0 + F.col("event_id") % 7 * k / 100_000).alias("lat"), (11.0 + F.col("event_id") % 5 * k / 100_000).alias("lon"))
    points = F.when(F.col("event_id") % 4 > 0, F.array(F.struct(F.lit(48.0).alias("lat"), F.lit(11.0).alias("lon")), step(20), step(40)))
    changes = f.where("event_type = 'purchase'").select("session_id", F.col("at").alias("t_ms"), points.alias("points"))
    resets = f.where("event_type = 'signup' and event_id % 20 = 0").select("session_id", F.col("at").alias("t_ms"), F.lit(48.0001).alias("lat"), F.lit(11.0001).alias("lon"), F.lit(45.0).alias("bearing"), F.lit(3.0).alias("speed"))
    return _track(registry.run(*_motion(spark, sf_dir), engine="fusion", changes=changes, resets=resets))


@query
def long_session(spark, sf_dir):
    """E7, E14, W2, W3 by spans: a third of all sessions is one."""
    f = telemetry.fixes(spark, sf_dir).withColumn("session_id", F.when(F.col("session_id") % 3 == 0, -1).otherwise(F.col("session_id")))
    f = f.withColumns({"dt": F.lit(0.01), "ae": F.col("value") / 100 * F.sin(F.radians("heading")), "an": F.col("value") / 100 * F.cos(F.radians("heading"))})
    f = settled(spans.running_distance(spans.cut(f, "t_ms", DAY_MS), KEY, ORDER))
    f = settled(spans.detect_steps(f, KEY, ORDER, "value", 20.0))
    f = settled(spans.strapdown(f, KEY, ORDER, "dt", "ae", "an"))
    f = spans.low_pass(f, KEY, ORDER, "value", F.lit(0.25))
    return rounded(f.select("event_id", "session_id", "distance_m", "is_step", "vel_east", "vel_north", "x_east", "y_north", "confidence_m", "y"), "distance_m", "vel_east", "vel_north", "x_east", "y_north", "confidence_m", "y")


@query
def imu_merge(spark, sf_dir):
    """Five sensors as tables of their own, held to motion samples by spans."""
    f = telemetry.fixes(spark, sf_dir)
    a, b, c = F.col("value") / 500, F.col("heading") / 1000, F.col("lat") - 48
    vector = {"click": F.array(a, b, c), "view": F.array(b, c, a), "error": F.array(c, a, b), "purchase": F.array(a, c, b), "signup": F.when(F.col("event_id") % 2 == 0, F.array(a / 2, b, c)).otherwise(F.array(a, b, c, a))}
    names = {"accel": "click", "gyro": "view", "mag": "error", "linear": "purchase", "quat": "signup"}
    tables = {n: f.where(F.col("event_type") == kind).select("session_id", (F.col("t_ms") * 1_000_000).alias("timestamp_nanos"), vector[kind].alias("v")) for n, kind in names.items()}
    made = telemetry.merged_sensors(tables, 3 * DAY_MS * 1_000_000)
    values = [n for n in made.columns if n[-2:] in ("_x", "_y", "_z", "_w")]
    return rounded(made.select("session_id", "timestamp_nanos", "sensor", *(n for n in values if not n.startswith("gravity"))), *(n for n in values if not n.startswith("gravity")))


@query
def trail_match(spark, sf_dir):
    """Events on the earlier trail of their session; places 60 m apart make the trail."""
    f = telemetry.fixes(spark, sf_dir)
    enu = geo.to_enu(F.col("lat"), F.col("lon"), F.lit(48.0), F.lit(11.0))
    f = f.select("session_id", "event_id", "t_ms", enu["east"].alias("east"), enu["north"].alias("north"), "heading", F.col("value").alias("speed"))
    start, step, schema = folds.spaced(60.0, 50.0)
    kept = folds.scan(f, KEY, ORDER, schema, start, step).select("event_id", "kept")
    w = ordered.Window.partitionBy(*KEY).orderBy(*ORDER)
    e, n = F.col("east") - F.lag("east").over(w), F.col("north") - F.lag("north").over(w)
    way = F.when(F.hypot(e, n) >= 300, F.hypot(e, n))
    f = f.withColumns({"way_e": e / way, "way_n": n / way, "row_no": F.row_number().over(w)})
    made = spatial.trail_match(f.join(kept, "event_id"), KEY, "row_no", within=50.0)
    return made.select("session_id", "row_no", "edge_no", r6("off").alias("off"), "reversed")


@query
def route_windowed(spark, sf_dir):
    """Every view along the route of its session, from match to match."""
    f = telemetry.estimates(telemetry.fixes(spark, sf_dir))
    enu = geo.to_enu(F.col("lat"), F.col("lon"), F.lit(48.0), F.lit(11.0))
    row = F.row_number().over(ordered.Window.partitionBy(*KEY).orderBy(*ORDER))
    points = f.select(F.col("session_id").alias("route_id"), row.alias("row_no"), enu["east"].alias("east"), enu["north"].alias("north"))
    made = spatial.route_windowed(points, _routes(spark, sf_dir), "row_no", gate=60.0, back=300.0, ahead=2000.0)
    return made.select("route_id", "row_no", "seg_no", r6("route_s").alias("route_s"), r6("off").alias("off"))


@query
def attitude_dr(spark, sf_dir):
    """The plain strapdown engine with attitudes, which clicks and views bring."""
    f = telemetry.fixes(spark, sf_dir)
    motion, _ = _motion(spark, sf_dir)
    row = F.row_number().over(ordered.Window.partitionBy(*KEY).orderBy(*ORDER)).cast("long")
    half, tilt = F.radians("heading") / 2, F.col("value") / 4000
    size = F.sqrt(1 + tilt * tilt)
    quat = {"quat_x": tilt / size, "quat_y": F.lit(0.0), "quat_z": F.sin(half) / size, "quat_w": F.cos(half) / size}
    own = f.select("session_id", "event_id", (row * 10_000_000).alias("timestamp_nanos"), *(F.when(F.col("event_type").isin("click", "view"), c).alias(n) for n, c in quat.items()))
    rows = motion.drop(*quat).join(own, ["session_id", "timestamp_nanos"])
    rows = rows.withColumns({"lat0": F.lit(48.0), "lon0": F.lit(11.0), "ve0": F.lit(3.0), "vn0": F.lit(4.0), "heading0": F.lit(30.0)})
    made = spans.attitude_strapdown(spans.cut(rows, "timestamp_nanos", 200_000_000), KEY, ["timestamp_nanos"], "timestamp_nanos")
    return rounded(made.select("event_id", "vel_east", "vel_north", "lat", "lon", "heading", "confidence_m"), "vel_east", "vel_north", "lat", "lon", "heading", "confidence_m")


@query
def session_counters(spark, sf_dir):
    """Rejected fixes, recalculations, steps and rows at a standstill of each session."""
    count = lambda df, condition, name: df.groupBy("session_id").agg(F.count_if(condition).alias(name))
    f = telemetry.fixes(spark, sf_dir).select("session_id", "event_id")
    parts = [
        count(gnss_gate(spark, sf_dir), ~F.col("accepted"), "rejects"), count(off_route_events(spark, sf_dir), F.col("decision") == "RECALCULATE", "recalculations"),
        count(step_detect(spark, sf_dir).join(f, "event_id"), F.col("is_step"), "steps"), count(still_time(spark, sf_dir).join(f, "event_id"), F.col("stationary"), "zupts"),
    ]
    made = parts[0]
    for part in parts[1:]:
        made = made.join(part, "session_id")
    return made


@query
def route_readback(spark, sf_dir):
    """A planned route as it is kept (local metres about its start) and read back."""
    f = telemetry.truth(telemetry.fixes(spark, sf_dir))
    start = F.first(F.struct("lat", "lon")).over(ordered.Window.partitionBy(*KEY).orderBy(*ORDER).rowsBetween(ordered.Window.unboundedPreceding, 0))
    f = f.withColumn("start", start)
    kept = geo.to_enu(F.col("lat"), F.col("lon"), F.col("start.lat"), F.col("start.lon"), geo.EQUATOR)
    back = geo.move_enu(F.col("start.lat"), F.col("start.lon"), kept["east"], kept["north"])
    return f.select("event_id", "session_id", r6(kept["east"]).alias("east"), r6(kept["north"]).alias("north"), r6(back["lat"]).alias("lat"), r6(back["lon"]).alias("lon"))


@query
def exports_joined(spark, sf_dir):
    """The exports of samples and states, joined on their sensor time."""
    made = imu_export(spark, sf_dir).join(pdr_dr(spark, sf_dir), ["session_id", "timestamp_nanos"])
    return made.select("session_id", "timestamp_nanos", "accel_x", "accel_z", "gyro_z", "acc_mag", "step_detected", "dr_x_east", "dr_y_north")
