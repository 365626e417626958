"""Folds and joins in time against plain loops."""

import random

from pyspark.sql import functions as F

from wayfold.operators import asof, folds, graph
from wayfold.sources import telemetry
from wayfold.streaming import folds as stream_folds


def test_off_route_fires_after_a_streak_then_cools_down(spark):
    rows = [(1, i, i * 2000, 50.0, 0.0, 5.0) for i in range(20)]
    df = spark.createDataFrame(rows, "session_id long, event_id long, t_ms long, deviation_m double, heading double, speed double")
    start, step, schema = folds.off_route()
    out = {r["event_id"]: r["decision"] for r in folds.scan(df, ["session_id"], ["t_ms"], schema, start, step).collect()}
    assert [i for i in sorted(out) if out[i] == "RECALCULATE"] == [3, 16]


def test_off_route_holds_near_the_route_and_when_slow(spark):
    rows = [(1, i, i * 2000, 10.0, 0.0, 5.0) for i in range(10)] + [(2, i, i * 2000, 90.0, 0.0, 0.5) for i in range(10)]
    df = spark.createDataFrame(rows, "session_id long, event_id long, t_ms long, deviation_m double, heading double, speed double")
    start, step, schema = folds.off_route()
    assert folds.scan(df, ["session_id"], ["t_ms"], schema, start, step).where("decision <> 'HOLD'").count() == 0


def test_glitch_is_rejected_once(spark):
    rows = [(1, 0, 0, 0.0, 0.0, 4.0, 0.0), (1, 1, 1000, 0.0, 810.0, 4.0, 0.0), (1, 2, 2000, 1.0, 1.0, 4.0, 0.0)]
    df = spark.createDataFrame(rows, "session_id long, event_id long, t_ms long, east double, north double, accuracy double, speed double")
    start, step, schema = folds.gnss_gate()
    assert [r["accepted"] for r in folds.scan(df, ["session_id"], ["t_ms"], schema, start, step).orderBy("event_id").collect()] == [True, False, True]


def test_nearest_in_time_is_brute_force(spark):
    r = random.Random(3)
    left = [(s, r.randrange(5000)) for s in range(3) for _ in range(40)]
    right = [(s, r.randrange(5000), i) for s in range(3) for i in range(40)]
    a = spark.createDataFrame(left, "k long, t long").distinct()
    b = spark.createDataFrame(right, "k long, t long, v long")
    got = {(x["k"], x["t"]): (x["m_t"], x["m_v"]) for x in asof.nearest_in_time(a, b, ["k"], "t", ["v"], 20, order="v").collect()}
    for k, t in set(left):
        near = min(((abs(t - u), u, v) for s, u, v in right if s == k and abs(t - u) <= 20), default=(0, None, None))
        assert got[k, t] == near[1:]


def test_unreachable_goal_falls_back_to_the_closest_node(spark):
    text = spark.createDataFrame([("g", '{"origin":[0,0],"nodes":{"a":[0,0],"b":[10,0],"c":[20,0],"d":[30,0]},"edges":[{"a":"a","b":"b"},{"a":"c","b":"b","oneway":"Yes"}]}'), ("bad", "{")], "graph_id string, json string")
    nodes, edges = telemetry.road_graph(text)
    assert sorted((e["a"], e["b"]) for e in edges.collect()) == [("a", "b"), ("b", "a"), ("c", "b")]
    asked = spark.createDataFrame([(1, "g", "a", "d"), (2, "g", "c", "a")], "request_id long, graph_id string, source string, goal string")
    out = {r["request_id"]: (r["node"], r["dist"], r["fallback"]) for r in graph.routes(asked, nodes, edges, 5).collect()}
    assert out == {1: ("b", 10.0, True), 2: ("a", 20.0, False)}


def test_stored_routing_answer(spark):
    body = '{"code":"Ok","routes":[{"distance":1.0,"geometry":{"coordinates":[[11.0,48.0],[11.1,48.1]]}}]}'
    df = spark.createDataFrame([(body,), ('{"code":"NoRoute"}',)], "b string").select(telemetry.osrm_route(F.col("b")).alias("p"))
    assert [r["p"] for r in df.collect()] == [[[48.0, 11.0], [48.1, 11.1]], None]


def test_stream_folds_like_the_batch(spark, tmp_path):
    r = random.Random(9)
    rows = [(s, s * 100 + i, i * 1000, r.random()) for s in range(3) for i in range(30)]
    schema = "session_id long, event_id long, t_ms long, value double"
    whole = spark.createDataFrame(rows, schema)
    start, step, out = folds.low_pass(0.25)
    for part in range(3):
        spark.createDataFrame([x for x in rows if x[2] // 10_000 == part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    made = stream_folds.scan_stream(stream, ["session_id"], ["t_ms"], out, start, step)
    made.writeStream.format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(90)
    want = folds.scan(whole, ["session_id"], ["t_ms"], out, start, step)
    assert sorted(map(tuple, spark.table("folded").collect())) == sorted(map(tuple, want.collect()))


def test_route_starts_ahead_on_the_first_graph(spark):
    nodes = spark.createDataFrame([(g, n, e, 0.0) for g in (1, 2) for n, e in (("a", 0.0), ("b", 100.0), ("c", 200.0))], "graph_id long, node_id string, east double, north double")
    edges = spark.createDataFrame([(g, x, y, 100.0) for g in (1, 2) for x, y in (("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"))], "graph_id long, a string, b string, cost double")
    asked = spark.createDataFrame([(1, 40.0, 3.0, 90.0, 200.0, 0.0), (2, 40.0, 3.0, None, 200.0, 0.0), (3, 9e6, 0.0, 90.0, 200.0, 0.0)], "point_id long, east double, north double, heading double, goal_east double, goal_north double")
    found = graph.heading_routes(asked, nodes, edges, 4)
    assert found.count() == 4
    out = {r["point_id"]: (r["graph_id"], r["source"], r["px"], r["dist"]) for r in graph.first_graph(found).collect()}
    assert out == {1: (1, "b", 40.0, 100.0), 2: (1, "a", None, 200.0)}
