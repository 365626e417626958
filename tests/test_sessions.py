"""Routes, resets and roads in the engines; recordings and long sessions by spans."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_engines import PLACE, Drive, device, row
from wayfold.engines import registry, roads, snapping
from wayfold.functions.geo import EQUATOR
from wayfold.operators import ordered, sessions, spans

WIDE = EQUATOR * math.cos(math.radians(PLACE[0]))


def at(east, north):
    return PLACE[0] + math.degrees(north / EQUATOR), PLACE[1] + math.degrees(east / WIDE)


def streets(lines, graph=0, origin=PLACE):
    """A network of directed edges (ax, ay, bx, by) in metres about the place."""
    c = {n: [] for n in roads.FIELDS}
    for k, (ax, ay, bx, by) in enumerate(lines):
        for n, v in zip(roads.FIELDS, (graph, *origin, 2 * k, 2 * k + 1, ax, ay, bx, by), strict=True):
            c[n].append(v)
    return roads.Roads(c)


class OnRoads(Drive):
    def __init__(self, engine, network, **given):
        start, self.step = registry.stepper(engine, roads=lambda: network)
        self.s, self.t = start(1), 1_000_000_000
        self.act(row(registry.SEED, lat=PLACE[0], lon=PLACE[1], **given))


@pytest.mark.parametrize("engine", ["fusion", "iekf"])
def test_roads_hold_a_place_that_has_no_route(engine):
    # A street to the east, five metres north; the opposite lane and one across lose by heading.
    d = OnRoads(engine, streets([(-50, 5, 400, 5), (400, 2, -50, 2), (10, -80, 10, 80)]), bearing=90.0, speed=8.0)
    for _ in range(60):
        d.move(**device(90.0))
        d.s["memory"][0].trail = snapping.Places(9)  # else the place keeps to its own way
    assert d.out["snap_mode"][0] == "AUTO" and d.out["dr_y_north"][0] == pytest.approx(5.0) and d.out["dr_x_east"][0] > 3
    raw = d.s["p"][0, 1] if engine == "iekf" else d["y"]
    assert abs(raw) < 1  # the raw place is never moved


def test_roads_are_asked_again_after_ten_metres_or_two_seconds():
    asked = []

    class Counting(roads.Roads):
        def snap(self, lat, lon, heading):
            asked.append(len(lat))
            return super().snap(lat, lon, heading)

    network = Counting({n: [] for n in roads.FIELDS})
    network.graphs = streets([(-50, 5, 4000, 5)]).graphs
    s = {"memory": [snapping.Memory(), snapping.Memory()], "route_s": np.zeros(2), "stationary": np.zeros(2, bool), "lat_lon": np.array([PLACE, PLACE])}
    # One drives 6 m each half second, one stands still and is asked by time only.
    x, answers = np.zeros(2), []
    for k in range(12):
        s["elapsed"] = np.full(2, 0.5 * k + 0.5)
        before = len(asked)
        mode = snapping.place(s, x.copy(), np.zeros(2), np.full(2, 90.0), np.array([0.5, 0.5]), network)[4]
        answers.append(sum(asked[before:]))
        x = x + [6.0, 0.0]
        assert list(mode) == ["AUTO", "AUTO"]
    # First both; then the driver each second (12 m), the other after more than two.
    assert answers == [2, 0, 1, 0, 1, 1, 1, 0, 1, 0, 2, 0]


def test_no_road_within_thirty_metres_is_free():
    d = OnRoads("fusion", streets([(-50, 40, 400, 40)]), bearing=90.0, speed=8.0)
    for _ in range(20):
        d.move(**device(90.0))
        d.s["memory"][0].trail = snapping.Places(9)
    assert d.out["snap_mode"][0] == "FREE"
    assert np.isnan(streets([]).snap(np.array([1.0]), np.array([2.0]), np.array([3.0]))).all()


def test_two_destinations_a_clearing_and_a_reset():
    d = Drive("fusion", heading=90.0, speed=8.0, route=[at(0, 3), at(300, 3)])
    go = lambda many=20: [d.move(**device(90.0)) for _ in range(many)][-1]
    assert go()["snap_mode"][0] == "ROUTE" and d.out["dr_y_north"][0] == pytest.approx(3.0)
    d.act(row(registry.ROUTE, t=d.t, route=[at(0, -4), at(300, -4)]))
    assert go()["snap_mode"][0] == "ROUTE" and d.out["dr_y_north"][0] == pytest.approx(-4.0)
    d.act(row(registry.ROUTE, t=d.t, route=[at(0, 0)]))
    assert go()["snap_mode"][0] != "ROUTE" and d.s["memory"][0].line is None
    d.act(row(registry.ROUTE, t=d.t, route=[at(0, 6), at(300, 6)]))
    far = go()["dr_x_east"][0]
    # Anew at another place: counters and trail start over, the route stays where it is.
    lat, lon = at(50, 0)
    d.act(row(registry.SEED, t=d.t, lat=lat, lon=lon, bearing=90.0, speed=8.0))
    assert d["steps"] == 0 and d["elapsed"] == 0 and len(d.s["memory"][0].trail) == 0
    out = go(5)
    assert out["snap_mode"][0] == "ROUTE" and out["dr_y_north"][0] == pytest.approx(6.0, abs=1e-3) and out["dr_x_east"][0] < far


def test_a_place_that_does_not_move_is_told_once():
    d = Drive("fusion", heading=90.0, speed=5.0)
    alerts = 0
    for k in range(4000):
        d.s["x"][:], d.s["y"][:], d.s["memory"][0].trail = 0.0, 0.0, snapping.Places(9)  # something holds the place
        d.s["ve"][:], d.s["vn"][:], d.s["forward"][:] = 5.0, 0.0, 5.0
        d.move(**device(90.0, gyro_z=0.1))
        alerts += int(d.out["frozen"][0])
        assert not d.out["frozen"][0] or k > 2900
    assert alerts == 1


def test_a_filter_that_runs_away_says_so():
    d = Drive("iekf", heading=0.0, speed=54.0)
    assert not d.move(**device(0.0))["too_fast"][0]
    for _ in range(60):
        d.move(**device(0.0, north=30.0))
    assert d.out["too_fast"][0]


def test_large_networks_go_with_the_sessions(spark, monkeypatch):
    origins = spark.createDataFrame([(0, *PLACE), (1, 50.0, 8.0)], "graph_id int, lat0 double, lon0 double")
    nodes = spark.createDataFrame([(g, k, 100.0 * k - 200, 4.0) for g in (0, 1) for k in range(30)], "graph_id int, node_id long, east double, north double")
    edges = spark.createDataFrame([(g, k, k + 1, 100.0) for g in (0, 1) for k in range(29)], "graph_id int, a long, b long, cost double")
    seeds = spark.createDataFrame([(k, *PLACE, 90.0, 8.0, 0) for k in range(3)] + [(3, 50.0, 8.0, 90.0, 8.0, 0), (4, 10.0, 10.0, 90.0, 8.0, 0)], "session_id long, lat double, lon double, bearing double, speed double, boot_offset_ms long")
    still = {n: float(v) for n, v in device(90.0).items()}
    samples = spark.createDataFrame([(k, 10_000_000 * i, *still.values()) for k in range(5) for i in range(1, 40)], "session_id long, timestamp_nanos long, " + ", ".join(f"{n} double" for n in still))
    run = lambda: sorted(map(tuple, registry.run(samples, seeds, engine="fusion", roads=(origins, nodes, edges)).select("session_id", "timestamp_nanos", "snap_mode", F.round("dr_lat", 9), F.round("dr_lon", 9)).collect()))
    shared = run()
    monkeypatch.setattr(roads.small, "__defaults__", (5,))
    assert run() == shared and {r[2] for r in shared if r[0] < 4} >= {"AUTO"} and {r[2] for r in shared if r[0] == 4}.isdisjoint({"AUTO"})
    table = roads.network(origins, nodes, edges)
    near = roads.within_reach(table, seeds.select("session_id", "lat", "lon"), samples.groupBy("session_id").agg(F.lit(1.0).alias("seconds")))
    many = {r["session_id"]: len(r["roads"]) for r in near.collect()}
    assert set(many) == {0, 1, 2, 3} and all(0 < n < 29 for n in many.values())


def test_recordings_restart_their_counters(spark):
    verbs = [(1, 10, 1, "STOP"), (1, 20, 2, "START"), (1, 25, 3, "START"), (1, 27, 4, "ENGINE_ON"), (1, 40, 5, "STOP"), (1, 41, 6, "ENGINE_ON"), (1, 50, 7, "START"), (1, 60, 8, "RESET"), (1, 60, 9, "START"), (2, None, 1, "START"), (None, 5, 1, "START")]
    samples = [(s, t, 100 + t) for s in (1, 2, None) for t in range(0, 80, 5)]
    made = sessions.recorded(spark.createDataFrame(samples, "session_id long, t_ms long, event_id long"), spark.createDataFrame(verbs, "session_id long, t_ms long, event_id long, verb string"), ["session_id"], "t_ms", "event_id", 30)
    got = sorted((r["session_id"] or 0, r["t_ms"], r["recording_no"], r["sample_no"], r["since_ms"], r["engine_on"]) for r in made.where("session_id is not null").collect())
    want = [(1, t, 1, k + 1, t - 20, t >= 27) for k, t in enumerate(range(20, 40, 5))] + [(1, t, 2, k + 1, t - 50, False) for k, t in enumerate(range(50, 60, 5))]
    assert got == want + [(1, t, 3, k + 1, t - 60, False) for k, t in enumerate(range(60, 80, 5))]


def test_spans_are_the_whole_session(spark):
    rows = [(s, t, (t * 37 + (s or 3) * 11) % 101 / 7, 48 + t % 13 / 1000, 11 + t % 7 / 1000) for s in (1, 2, None) for t in range(700 if s == 1 else 40)]
    df = spark.createDataFrame(rows, "session_id long, t_ms long, value double, lat double, lon double")
    key, order = ["session_id"], ["t_ms"]
    own = {"r_step": "is_step", "r_distance": "distance_m"}
    want = ordered.detect_steps(ordered.running_distance(df, key, order), key, order, "value", 2.0).withColumnsRenamed({v: k for k, v in own.items()}).collect()
    made = spans.cut(df, "t_ms", 50)
    made = spans.low_pass(spans.detect_steps(spans.running_distance(made, key, order), key, order, "value", 2.0), key, order, "value", F.lit(0.25))
    got = {(r["session_id"], r["t_ms"]): r for r in made.collect()}
    y = {}
    for r in sorted(want, key=lambda r: (r["session_id"] or 0, r["t_ms"])):
        s = r["session_id"]
        y[s] = r["value"] if s not in y else y[s] + 0.25 * (r["value"] - y[s])
        g = got[s, r["t_ms"]]
        assert g["is_step"] == r["r_step"] and g["distance_m"] == pytest.approx(r["r_distance"], abs=1e-6) and g["y"] == pytest.approx(y[s], abs=1e-9)
    assert len(got) == len(rows)


def test_trails_of_all_sessions_are_searched_like_each_alone():
    r = np.random.default_rng(4)
    memories, x, y, heading = [], r.uniform(0, 60, 40), r.uniform(0, 60, 40), r.uniform(0, 360, 40)
    for k in range(40):
        m = snapping.Memory()
        for e, n in r.uniform(0, 60, (2 + k % 30, 2)):
            m.trail.add(e, n)
            m.trail.add(e, n) if k % 7 == 0 else None  # a segment without length
        for e, n in r.uniform(0, 5 if k % 3 else 30, (k % 4, 2)):
            m.recent.add(e, n)
        memories.append(m)
    found = snapping.trail_edges(memories, x, y, heading)
    for k, m in enumerate(memories):
        p, best, own = m.trail.points(), None, m.recent.points()
        way = own[-1] - own[0] if len(own) > 1 else np.zeros(2)
        turn = np.array([np.sin(np.radians(heading[k])), np.cos(np.radians(heading[k]))])
        for a, b in zip(p, p[1:], strict=False):
            length = np.hypot(*(b - a))
            if length < 1e-6:
                continue
            u = (b - a) / length
            t = min(max(((x[k], y[k]) - a) @ u / length, 0), 1)
            off, align = np.hypot(*((x[k], y[k]) - a - t * (b - a))), u @ turn
            if off > 20 or abs(align) < 0.5 or (np.hypot(*way) >= 6 and abs(u @ way) / np.hypot(*way) < 0.5):
                continue
            if best is None or off - 10 * abs(align) < best[0] - 1e-12:
                best = (off - 10 * abs(align), [*a, *b, float(align < 0)])
        assert (found[k] is None) == (best is None)
        assert best is None or found[k] == pytest.approx(best[1])
    assert 5 < sum(f is not None for f in found) < 40


def test_a_trail_keeps_its_last_places():
    p = snapping.Places(5)
    for k in range(100):
        assert p.far(k, 0, 1.0)
        p.add(k, 0)
        assert p.points()[:, 0].tolist() == list(range(max(0, k - 4), k + 1)) and len(p.held) <= 16
