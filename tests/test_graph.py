"""Road graphs that are larger than the stand-in of the catalog."""

import math

from wayfold.functions import geo
from wayfold.operators import graph
from wayfold.plans import catalog


def test_paths_of_more_than_twelve_edges(spark, monkeypatch):
    nodes = spark.createDataFrame([(0, i, float(i), 0.0) for i in range(16)], "graph_id int, node_id long, east double, north double")
    edges = spark.createDataFrame([(0, i, i + 1, 1.0) for i in range(15)], "graph_id int, a long, b long, cost double")
    monkeypatch.setattr(catalog, "_roads", lambda *_: (nodes, edges))
    made = {(r["source"], r["node"]): r["dist"] for r in catalog.QUERIES["shortest_path"](spark, "").collect()}
    assert made == {(i, j): float(j - i) for i in range(16) for j in range(i, 16)}
    asked = spark.createDataFrame([(1, 0, 0, 15)], "request_id long, graph_id int, source long, goal long")
    assert [tuple(r) for r in graph.routes(asked, nodes, edges).collect()] == [(1, 15, 15.0, False)]


def test_latlon_routes_use_the_first_graph_that_covers_both_ends(spark):
    lat0, lon0 = 16.3, 80.4
    east = math.degrees(1 / (geo.EQUATOR * math.cos(math.radians(lat0))))  # of a metre
    origins = spark.createDataFrame([(0, 48.0, 11.0), (1, lat0, lon0), (2, lat0, lon0)], "graph_id int, lat0 double, lon0 double")
    nodes = spark.createDataFrame([(g, i, 100.0 * i, 0.0) for g in (0, 1, 2) for i in range(4)], "graph_id int, node_id long, east double, north double")
    edges = spark.createDataFrame([(g, i, i + 1, 100.0) for g in (0, 1, 2) for i in range(3)], "graph_id int, a long, b long, cost double")
    # At the first node without a heading, along an edge, against it, and far from every graph.
    asked = [(1, 5.0, None), (2, 50.0, 90.0), (3, 60.0, 270.0), (4, 500_000.0, 90.0)]
    north = math.degrees(3 / geo.EQUATOR)
    rows = [(k, lat0 + north, lon0 + e * east, h, lat0, lon0 + 301 * east) for k, e, h in asked]
    requests = spark.createDataFrame(rows, "point_id long, lat double, lon double, heading double, goal_lat double, goal_lon double")
    made = {}
    for r in graph.latlon_routes(requests, origins, nodes, edges).orderBy("point_id", "i").collect():
        made.setdefault(r["point_id"], []).append((r["i"], round((r["lon"] - lon0) / east, 3), round(r["lat"] - lat0, 9)))
    place = lambda e: [(0, e, round(north, 9))]
    nodes_from = lambda first, i: [(i + k, 100.0 * n, 0.0) for k, n in enumerate(range(first, 4))]
    assert made == {1: place(5.0) + nodes_from(0, 1), 2: place(50.0) + [(1, 50.0, 0.0)] + nodes_from(1, 2), 3: place(60.0) + nodes_from(1, 1)}
