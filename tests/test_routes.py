"""Aimed searches and catalogs of graphs, against plain Python."""

import heapq
import math
import random

import pytest

from wayfold.functions.geo import EQUATOR
from wayfold.operators import graph, spatial


def grid(spark, many=24, seed=1, cut=0.0):
    """A street grid with one-way streets and, perhaps, some that lack."""
    r = random.Random(seed)
    nodes = {(i * many + j): (100.0 * i + r.random(), 100.0 * j + r.random()) for i in range(many) for j in range(many)}
    links = [(a, a + d) for a in nodes for d in (1, many) if a + d in nodes and not (d == 1 and (a + 1) % many == 0)]
    both = [x for a, b in links if r.random() >= cut for x in ([(a, b), (b, a)] if r.random() < 0.8 else [(a, b)])]
    edges = [(a, b, math.dist(nodes[a], nodes[b])) for a, b in both]
    return nodes, edges, spark.createDataFrame([(0, k, *p) for k, p in nodes.items()], "graph_id int, node_id long, east double, north double"), spark.createDataFrame([(0, *e) for e in edges], "graph_id int, a long, b long, cost double")


def dijkstra(edges, source):
    out, dist, heap = {}, {}, [(0.0, source)]
    for a, b, c in edges:
        out.setdefault(a, []).append((b, c))
    while heap:
        d, a = heapq.heappop(heap)
        if a not in dist:
            dist[a] = d
            for b, c in out.get(a, []):
                heapq.heappush(heap, (d + c, b))
    return dist


def test_aimed_routes_are_the_shortest_and_settle_little(spark):
    nodes, edges, places, roads = grid(spark)
    asked = [(1, 30, 34), (2, 30, 34), (3, 300, 150), (4, 10, 10)]
    requests = spark.createDataFrame([(k, 0, a, b) for k, a, b in asked], "request_id long, graph_id int, source long, goal long")
    made = {r["request_id"]: r for r in graph.routes(requests, places, roads, with_path=True).collect()}
    for k, a, b in asked:
        assert made[k]["dist"] == pytest.approx(dijkstra(edges, a)[b]) and made[k]["node"] == b and not made[k]["fallback"]
        path = made[k]["path"]
        cost = {(x, y): c for x, y, c in edges}
        assert path[0] == a and path[-1] == b and sum(cost[x, y] for x, y in zip(path, path[1:], strict=False)) == pytest.approx(made[k]["dist"])
    settled = {(r["source"], r["goal"]): r["count"] for r in graph.aimed(requests, places, roads).groupBy("source", "goal").count().collect()}
    assert settled[30, 34] <= 40 and settled[10, 10] <= 5 and settled[300, 150] < len(nodes) / 2
    whole = graph.distances(requests.select("graph_id", "source").distinct(), roads).where("source = 30")
    assert whole.count() > 500


def test_unreached_goals_fall_back_as_before(spark):
    nodes, edges, places, roads = grid(spark, many=7, seed=3, cut=0.55)
    r = random.Random(5)
    asked = [(k, r.randrange(49), r.randrange(49)) for k in range(12)]
    requests = spark.createDataFrame([(k, 0, a, b) for k, a, b in asked], "request_id long, graph_id int, source long, goal long")
    made = {x["request_id"]: x for x in graph.routes(requests, places, roads).collect()}
    fell = 0
    for k, a, b in asked:
        dist = dijkstra(edges, a)
        end = b if b in dist else min(dist, key=lambda n: (math.dist(nodes[n], nodes[b]), n))
        fell += b not in dist
        assert (made[k]["node"], made[k]["fallback"]) == (end, b not in dist) and made[k]["dist"] == pytest.approx(dist[end])
    assert 0 < fell < 12


def test_catalog_snap_is_brute_force(spark):
    r = random.Random(2)
    origins = [(0, 16.3, 80.4), (1, 16.302, 80.401), (2, -33.0, 151.0), (3, 70.0, 25.0)]
    nodes = [(g, k, r.uniform(0, 900), r.uniform(0, 900)) for g, *_ in origins for k in range(25)]
    edges = [(g, a, b, 1.0) for g, *_ in origins for a in range(25) for b in r.sample(range(25), 3) if a != b]
    place = {(g, k): (e, n) for g, k, e, n in nodes}
    points = []
    for k in range(80):
        g, lat0, lon0 = origins[k % 4]
        e, n = r.uniform(-400, 1300), r.uniform(-400, 1300)
        points.append((k, lat0 + math.degrees(n / EQUATOR), lon0 + math.degrees(e / (EQUATOR * math.cos(math.radians(lat0)))), r.uniform(0, 360)))
    points += [(100, None, 1.0, 0.0), (101, float("nan"), 1.0, 0.0), (102, 0.0, 0.0, 10.0)]
    want = {}
    for k, lat, lon, heading in points:
        if lat is None or math.isnan(lat):
            continue
        ways = []
        for g, lat0, lon0 in origins:
            e, n = math.radians(lon - lon0) * EQUATOR * math.cos(math.radians(lat0)), math.radians(lat - lat0) * EQUATOR
            for g2, a, b, _ in edges:
                (ax, ay), (bx, by) = place[g2, a], place[g2, b]
                if g2 != g or math.dist((ax, ay), (e, n)) > 150:
                    continue
                dx, dy = bx - ax, by - ay
                t = min(1, max(0, ((e - ax) * dx + (n - ay) * dy) / (dx * dx + dy * dy)))
                off = math.dist((e, n), (ax + t * dx, ay + t * dy))
                align = (dx * math.sin(math.radians(heading)) + dy * math.cos(math.radians(heading))) / math.hypot(dx, dy)
                if off <= 150:
                    ways.append((off - 150 * align, g, a, b))
        if ways:
            want[k] = min(ways)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = frame(origins, "graph_id int, lat0 double, lon0 double"), frame(nodes, "graph_id int, node_id long, east double, north double"), frame(edges, "graph_id int, a long, b long, cost double")
    made = spatial.catalog_snap(frame(points, "point_id long, lat double, lon double, heading double"), *tables)
    got = {r["point_id"]: (r["score"], r["graph_id"], r["a"], r["b"]) for r in made.collect()}
    assert {k: v[1:] for k, v in got.items()} == {k: v[1:] for k, v in want.items()} and len(got) > 30
    assert all(got[k][0] == pytest.approx(want[k][0], abs=1e-6) for k in got)
    # The packed index of the engines gives the same edges.
    from wayfold.engines import roads

    index = roads.packed(roads.network(*tables))
    asked = [p for p in points if p[1] is not None]
    import numpy as np

    found = index.snap(*np.array([p[1:] for p in asked], float).T)
    for (k, *_), edge in zip(asked, found, strict=True):
        assert np.isnan(edge[4]) == (k not in want)
        if k in want:
            assert edge[4] - 150 * edge[5] == pytest.approx(want[k][0], abs=1e-6)
