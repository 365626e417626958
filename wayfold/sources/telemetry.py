"""Sources: schemas, adapters that read the star-schema tables as telemetry, JSON files."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions.linalg import quat_w
from wayfold.operators import spans

IMU = (
    "device_id string, session_id long, timestamp_nanos long, accel_x float, accel_y float, accel_z float, gyro_x float, gyro_y float, gyro_z float, "
    "mag_x float, mag_y float, mag_z float, quat_x float, quat_y float, quat_z float, quat_w float, linear_x float, linear_y float, linear_z float, gravity_x float, gravity_y float, gravity_z float"
)
GPS = "device_id string, session_id long, timestamp_ms long, latitude double, longitude double, altitude double, speed float, bearing float, accuracy float, provider string"
GRAPH = "origin array<double>, nodes map<string, array<double>>, edges array<struct<a: string, b: string, oneway: string>>"
ROUTE = "start array<double>, destination array<double>, source string, timestamp long, points array<array<double>>"
OSRM = "code string, routes array<struct<distance: double, geometry: struct<coordinates: array<array<double>>>>>"


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as position fixes: one session a user, places and headings by arithmetic
    on the keys."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        "event_id", F.col("user_id").alias("session_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("t_ms"), "event_type", F.col("value").cast("double").alias("value"),
        (48.0 + ((F.col("event_id") * 37) % 1000).cast("double") / 100000.0).alias("lat"),
        (11.0 + ((F.col("event_id") * 91) % 1000).cast("double") / 100000.0).alias("lon"),
        (F.get_json_object("props", "$.k").cast("double") * 3.6).alias("heading"),
    )


def truth(all_fixes: DataFrame) -> DataFrame:
    return all_fixes.where("event_type = 'click'")


def estimates(all_fixes: DataFrame) -> DataFrame:
    return all_fixes.where("event_type = 'view'")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as vectors of doubles."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def road_graph(text: DataFrame, graph_id: str = "graph_id", body: str = "json") -> tuple[DataFrame, DataFrame]:
    """Nodes (``graph_id, node_id, east, north``) and directed edges (``graph_id, a, b,
    cost``) of JSON documents; a document that does not parse gives nothing. An edge goes
    both ways unless ``oneway`` is yes, true or 1."""
    parsed = text.select(F.col(graph_id).alias("graph_id"), F.from_json(body, GRAPH).alias("g")).where("g.nodes is not null and g.edges is not null")
    nodes = parsed.select("graph_id", F.explode("g.nodes").alias("node_id", "p")).select("graph_id", "node_id", F.get("p", F.lit(0)).alias("east"), F.get("p", F.lit(1)).alias("north"))
    links = parsed.select("graph_id", F.explode("g.edges").alias("e")).select("graph_id", "e.a", "e.b", "e.oneway")
    return nodes, directed(nodes, links)


def directed(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Edges with their length; both directions unless one-way."""
    one = F.lower(F.coalesce("oneway", F.lit(""))).isin("yes", "true", "1")
    back = links.where(~one).select("graph_id", F.col("b").alias("a"), F.col("a").alias("b"))
    every = links.select("graph_id", "a", "b").union(back)
    end = lambda s: nodes.select("graph_id", F.col("node_id").alias(s), F.col("east").alias("e" + s), F.col("north").alias("n" + s))
    joined = every.join(end("a"), ["graph_id", "a"]).join(end("b"), ["graph_id", "b"])
    return joined.select("graph_id", "a", "b", F.hypot(F.col("ea") - F.col("eb"), F.col("na") - F.col("nb")).alias("cost"))


def osrm_route(body: Column) -> Column:
    """Points (lat, lon) of a stored routing answer; null unless it is Ok with two points."""
    answer = F.from_json(body, OSRM)
    line = F.get(answer["routes"], F.lit(0))["geometry"]["coordinates"]
    points = F.transform(line, lambda c: F.array(F.get(c, F.lit(1)), F.get(c, F.lit(0))))
    return F.when((answer["code"] == "Ok") & (F.size(points) >= 2), points)


def cached_route(body: Column, start: tuple[float, float], destination: tuple[float, float]) -> Column:
    """Points of a stored route that starts within 0.01 degrees of ``start`` and ends
    within 1e-6 of ``destination`` on both axes; else null."""
    route = F.from_json(body, ROUTE)
    near = lambda name, p, most: (F.abs(F.get(route[name], F.lit(0)) - p[0]) <= most) & (F.abs(F.get(route[name], F.lit(1)) - p[1]) <= most)
    return F.when(near("start", start, 0.01) & near("destination", destination, 1e-6), route["points"])


def save_routes(routes: DataFrame, folder: str) -> None:
    """Replaces the route cache in ``folder`` (``start``, ``destination``, ``source``, ``timestamp``,
    ``points``, a JSON line each). Readers see the old cache or the new one: the new one is
    written beside it and renamed."""
    spark, beside = routes.sparkSession, f"{folder.rstrip('/')}-{uuid.uuid4().hex}"
    routes.select(F.to_json(F.struct("start", "destination", "source", "timestamp", "points")).alias("value")).write.text(beside)
    path, new = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (folder, beside))
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.delete(path, True)
    if not system.rename(new, path):
        raise OSError(f"{beside} could not be renamed to {folder}")


def read_routes(spark: SparkSession, folder: str) -> DataFrame:
    """The route cache as its JSON, column ``json`` (see ``cached_route``)."""
    return spark.read.text(folder).withColumnRenamed("value", "json")


def imu_source(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """Motion samples (``IMU``) in JSON files, read or streamed. Sensors that lack are null."""
    reader = (spark.readStream if stream else spark.read).schema(IMU)
    return reader.json(folder)


def gps_source(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """Position fixes (``GPS``) in JSON files, read or streamed, as engines take them (``t_ms``,
    ``lat``, ``lon``, ``speed``, ``bearing``, ``accuracy``) with ``event_time``. Speeds below 0, bearings
    outside 0 to 360 and accuracies of 0 or less are not known; fixes without a place are left out."""
    reader = (spark.readStream if stream else spark.read).schema(GPS)
    known = lambda c, condition: F.when(condition, F.col(c).cast("double"))
    fix = reader.json(folder).where("latitude between -90 and 90 and longitude between -180 and 180")
    return fix.select(
        "session_id", F.col("timestamp_ms").alias("t_ms"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), "altitude", known("speed", F.col("speed") >= 0).alias("speed"),
        known("bearing", F.col("bearing").between(0, 360)).alias("bearing"), known("accuracy", F.col("accuracy") > 0).alias("accuracy"), "provider", F.timestamp_millis("timestamp_ms").alias("event_time"),
    )


def seed(last: DataFrame, cached: DataFrame, default: tuple[float, float]) -> DataFrame:
    """Start of each session of ``last`` (``session_id, lat, lon, bearing, speed,
    device_yaw``): the last fix, else the cached one, else ``default``; ``seed_source``
    says which. Velocity follows speed and heading."""
    old = cached.select("session_id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    heading = F.coalesce("bearing", "device_yaw", F.lit(0.0))
    speed = F.coalesce("speed", F.lit(0.0))
    source = F.when(F.col("lat").isNotNull(), "last").when(F.col("_lat").isNotNull(), "cached").otherwise("default")
    return last.join(old, "session_id", "left").select(
        "session_id", F.coalesce("lat", "_lat", F.lit(default[0])).alias("lat"), F.coalesce("lon", "_lon", F.lit(default[1])).alias("lon"), heading.alias("heading"),
        (speed * F.sin(F.radians(heading))).alias("vel_east"), (speed * F.cos(F.radians(heading))).alias("vel_north"), source.alias("seed_source"),
    )


#: Sensors that make up a motion sample, in the order in which rows of one time are taken; the
#: last two make a sample once both were heard.
SENSORS = ("mag", "linear", "gravity", "quat", "accel", "gyro")


def merged_sensors(tables: dict[str, DataFrame], span: int) -> DataFrame:
    """Motion samples of separate sensors: a row for each event of ``accel`` or ``gyro`` once both
    were heard, with the latest values of every sensor (``<sensor>_x`` and so on), null for those
    not heard yet.

    ``tables`` has for each of ``SENSORS`` (those that lack are never heard) ``session_id``,
    ``timestamp_nanos`` and ``v``, an array of three values; that of ``quat`` is a rotation vector
    of three or four. Shorter arrays count as not heard. Sessions are cut into spans of
    ``span`` nanoseconds, all sensors are held in one pass.
    """
    parts = []
    for rank, name in enumerate(SENSORS):
        if name in tables:
            v = F.col("v")
            whole = F.when(F.size(v) >= 4, F.slice(v, 1, 4)).when(F.size(v) == 3, F.concat(v, F.array(quat_w(*(F.get(v, F.lit(i)) for i in range(3)))))) if name == "quat" else F.when(F.size(v) >= 3, F.slice(v, 1, 3))
            parts.append(tables[name].select("session_id", "timestamp_nanos", F.lit(rank).alias("_rank"), whole.alias("_v")).where("_v is not null"))
    rows = spans.cut(reduce(DataFrame.union, parts), "timestamp_nanos", span)
    own = {name: F.when(F.col("_rank") == rank, F.col("_v")) for rank, name in enumerate(SENSORS)}
    rows = spans.last_before(rows, ["session_id"], ["timestamp_nanos", "_rank"], {f"_h_{n}": c for n, c in own.items()})
    held = {n: F.coalesce(c, F.col(f"_h_{n}")) for n, c in own.items()}
    made = rows.where(F.col("_rank") >= SENSORS.index("accel")).where(held["accel"].isNotNull() & held["gyro"].isNotNull())
    columns = [F.get(held[n], F.lit(i)).alias(f"{n}_{x}") for n in ("accel", "gyro", "mag", "quat", "linear", "gravity") for i, x in enumerate("xyzw" if n == "quat" else "xyz")]
    return made.select("session_id", "timestamp_nanos", F.element_at(F.array(F.lit("accel"), F.lit("gyro")), F.col("_rank") - SENSORS.index("accel") + 1).alias("sensor"), *columns)
