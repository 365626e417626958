"""Engines on made motion: scenarios in numpy, and runs by Spark."""

import numpy as np
import pytest

from wayfold.engines import arrays, iekf, registry, snapping

PLACE = (16.3067, 80.4365)
GRAVITY = 9.80665


def row(kind, **given):
    names = ["lat", "lon", "speed", "bearing", "accuracy", *registry.SENSORS]
    r = {n: np.array([given.get(n, np.nan)], float) for n in names}
    r |= {"session_id": np.array([1]), "kind": np.array([kind]), "t_nanos": np.array([given.get("t", 0)]), "t_ms": np.array([given.get("ms", 0)])}
    r["route"] = np.array([given.get("route"), None], object)[:1]
    return r


def device(yaw, east=0.0, north=0.0, up=0.0, gyro_z=0.0):
    """Sensors of a level phone that points to ``yaw``, with an acceleration in the world."""
    half = np.radians(-yaw) / 2
    q = np.array([[0, 0, np.sin(half), np.cos(half)]])
    linear = arrays.rotation(q)[0].T @ [east, north, up]
    raw = linear + [0, 0, 9.81]
    values = dict(zip(("linear_x", "linear_y", "linear_z", "accel_x", "accel_y", "accel_z"), [*linear, *raw], strict=True))
    return values | dict(zip(("quat_x", "quat_y", "quat_z", "quat_w"), q[0], strict=True)) | {"gyro_x": 0, "gyro_y": 0, "gyro_z": gyro_z}


class Drive:
    def __init__(self, engine, heading=0.0, speed=0.0, **given):
        start, self.step = registry.stepper(engine)
        self.s, self.t = start(1), 1_000_000_000
        self.act(row(registry.SEED, lat=PLACE[0], lon=PLACE[1], bearing=heading, speed=speed, **given))

    def act(self, r):
        self.s, self.out = self.step(self.s, r)
        return self.out

    def fix(self, ms, lat=PLACE[0], speed=10.0, bearing=0.0, accuracy=4.0):
        return self.act(row(registry.FIX, ms=ms, lat=lat, lon=PLACE[1], speed=speed, bearing=bearing, accuracy=accuracy))

    def move(self, **sensors):
        self.t += 10_000_000
        return self.act(row(registry.SAMPLE, t=self.t, ms=self.t // 1_000_000, **sensors))

    def __getitem__(self, name):
        return self.s[name][0]


def test_standstill_stops_the_drift():
    d = Drive("fusion")
    for _ in range(140):
        d.move(accel_x=0, accel_y=0.05, accel_z=9.81, gyro_x=0.001, gyro_y=0.001, gyro_z=0.001, linear_x=0.02, linear_y=0.05, linear_z=0.01, quat_x=0, quat_y=0, quat_z=0, quat_w=1)
    assert d["stationary"] and d["forward"] == 0 and d.out["vel_east"][0] == 0 and d.out["vel_north"][0] == 0 and d.out["snap_mode"][0] == "ZUPT"


def test_a_place_beyond_a_segment_is_not_matched():
    line = snapping.Line(np.array([[0.0, 0.0], [10.0, 0.0]]))
    assert line.match(25.0, 0.0, 0.0) is None and line.match(10.4, 2.0, 0.0)[:2] == (10.0, 0.0)
    assert line.progress(25.0, 3.0, 0.0) == 10.0


def test_steps_keep_a_walker_going():
    d = Drive("fusion")
    for _ in range(5):
        for i in range(50):
            z = 14.5 if i == 10 else 7.5 if 25 <= i <= 30 else 9.81
            d.move(accel_x=0, accel_y=0.5, accel_z=z, gyro_x=0.01, gyro_y=0.01, gyro_z=0.01, linear_x=0, linear_y=0.5, linear_z=z - 9.81, quat_x=0, quat_y=0, quat_z=0, quat_w=1)
    assert d["steps"] >= 3 and d["forward"] > 0.5


def test_a_tilted_phone_accelerates_forward():
    d, pitch = Drive("fusion", speed=5.0), np.radians(45)
    y, z = 2 * np.cos(pitch), -2 * np.sin(pitch)
    for _ in range(20):
        d.move(accel_x=0, accel_y=y, accel_z=9.81 + z, gyro_x=0, gyro_y=0, gyro_z=0, linear_x=0, linear_y=y, linear_z=z, quat_x=np.sin(pitch / 2), quat_y=0, quat_z=0, quat_w=np.cos(pitch / 2))
    assert d["forward"] > 5 and d.out["vel_north"][0] > 5 and abs(d.out["vel_east"][0]) < 0.2


def test_an_irregular_route_holds():
    line = np.array([[0, 0], [5, 0], [125, 0], [125, 35]], float)
    points = [(PLACE[0] + np.degrees(n / arrays.EQUATOR), PLACE[1] + np.degrees(e / arrays.EQUATOR / np.cos(np.radians(PLACE[0])))) for e, n in line]
    d = Drive("fusion", heading=90.0, speed=10.0, route=points)
    for _ in range(50):
        d.move(accel_x=0, accel_y=0, accel_z=9.81, gyro_x=0, gyro_y=0, gyro_z=0, linear_x=0, linear_y=0, linear_z=0, quat_x=0, quat_y=0, quat_z=0.7071, quat_w=0.7071)
    assert not d["off_line"] and np.allclose(d["memory"].line.start, [0, 5, 125], atol=1e-6)


def test_a_moving_fix_turns_the_mount():
    d = Drive("fusion")
    d.act(row(registry.FIX, ms=2000, lat=16.3068, lon=80.4367, speed=12.0, bearing=90.0, accuracy=3.0))
    assert d["mounted"] and abs(d["forward"] - 12) < 1e-9 and d["offset"] == 90


@pytest.mark.parametrize("engine", ["fusion", "iekf"])
def test_a_glitch_is_rejected_and_five_are_believed(engine):
    d = Drive(engine, speed=10.0)
    d.fix(1000)
    assert d["rejects"] == 0
    d.fix(2000, lat=16.3140)
    assert d["rejects"] == 1
    for k in range(5):
        d.fix(3000 + k, lat=16.3140)
    assert d["rejects"] == 5 and d.out["dr_y_north"][0] > 500
    assert d.fix(9000, accuracy=31.0)["gnss_rejects"][0] == 5


def test_headings_follow_a_cruise():
    d = Drive("fusion", heading=90.0, speed=8.0)
    d.fix(1000, speed=8.0, bearing=90.0, accuracy=3.0)
    for _ in range(150):
        d.move(**device(90.0))
    assert not d["stationary"] and d["forward"] > 5
    assert abs(arrays.turned(d["dominant"], 90.0)) < 10 and abs(arrays.turned(d["heading"], 90.0)) < 10


def test_a_turn_does_not_fling_sideways():
    d, yaw = Drive("fusion", speed=10.0), 0.0
    d.fix(1000, accuracy=3.0)
    for i in range(120):
        yaw += 0.3
        d.move(**device(yaw, east=6.0 if 40 <= i < 60 else 0.0, gyro_z=-np.radians(30)))
    assert abs(d["side"]) < 1.5 and d["forward"] > 5 and abs(d["yaw_rate"]) > 10


def test_the_way_back_snaps_to_the_trail():
    d = Drive("fusion", heading=90.0, speed=8.0)
    d.fix(1000, speed=8.0, bearing=90.0, accuracy=3.0)
    for _ in range(300):
        d.move(**device(90.0))
    memory = d["memory"]
    assert len(memory.trail) >= 5
    later = d.s | {"elapsed": d.s["elapsed"] + 2}
    who, (e, n, ux, uy) = snapping.on_trails(later, [0], d.s["x"] - 10, d.s["y"] - 3, np.array([270.0]), np.array([6.0]))
    found = (e[0], n[0], ux[0], uy[0]) if len(who) else None
    assert found is not None and abs(found[1]) < 4 and found[2] < 0 and memory.reversed


@pytest.mark.parametrize("engine", ["fusion", "iekf"])
def test_every_sample_has_a_whole_row(engine):
    d = Drive(engine, heading=45.0, speed=6.0)
    d.fix(1000, speed=6.0, bearing=45.0, accuracy=3.0)
    for _ in range(30):
        out = d.move(**device(45.0))
        assert all(np.isfinite(out[n][0]) for n in ("forward_speed_mps", "yaw_rate_deg_s", "lateral_vel_mps", "fused_heading_rad", "stride_length", "confidence_m")) and out["snap_mode"][0]


def test_sessions_in_lockstep_do_not_mix():
    for engine in ("fusion", "iekf"):
        start, step = registry.stepper(engine)
        r = np.random.default_rng(3)
        both = [row(registry.SEED, lat=1.0, lon=2.0, bearing=30.0, speed=4.0), *(row(registry.SAMPLE, t=k * 10_000_000, ms=k * 10, **device(30.0 + k, *r.normal(size=3), gyro_z=0.1)) for k in range(1, 80))]
        other = [row(registry.SEED, lat=3.0, lon=4.0, bearing=200.0, speed=1.0), *(row(registry.SAMPLE, t=k * 10_000_000, ms=k * 10, **device(200.0 - k, *r.normal(size=3))) for k in range(1, 80))]
        alone, pair = start(1), start(2)
        for a, b in zip(both, other, strict=True):
            alone, one = step(alone, a)
            pair, two = step(pair, {n: np.concatenate([a[n], b[n]]) for n in a})
        assert all(np.allclose(one[n][0], two[n][0], equal_nan=True) for n in registry.STATE), engine


def test_filter_stays_sound():
    d = Drive("iekf", heading=20.0, speed=5.0)
    for k in range(400):
        d.move(**device(20.0 + 0.05 * k, gyro_z=-np.radians(5)))
    P, R = d["P"], d["R"]
    assert np.allclose(P, P.T) and np.linalg.eigvalsh(P).min() > -1e-9 and np.allclose(R @ R.T, np.eye(3), atol=1e-6)
    rest = Drive("iekf")
    for _ in range(300):
        rest.move(**device(0.0))
    assert rest["stationary"] and rest["zupts"] > 50 and np.hypot(*rest["v"][:2]) < 0.05 and abs(rest["p"][0]) < 1


def test_error_jacobian_against_differences():
    """The transition of attitude to velocity: gravity through a small rotation."""
    s = iekf.start(1)
    s["P"] = np.zeros((1, 21, 21))
    s["P"][0, 0, 0] = 1.0
    iekf.propagate(s, np.array([[0.0, 0.0, GRAVITY]]), np.zeros((1, 3)), np.array([0.01]))
    assert abs(s["P"][0, 4, 0] + GRAVITY * 0.01) < 1e-6 and s["P"][0, 3, 0] == 0


def samples(spark, sessions=2, many=120):
    rows = []
    for session in range(sessions):
        for k in range(many):
            z = 9.81 + (6.0 if k % 50 == 10 else -3.0 if 25 <= k % 50 <= 30 else 0.0)
            rows.append((session, 1_000_000_000 + k * 10_000_000, 0.0, 0.5, z, 0.01, 0.02, 0.3 * session, 20.0, 5.0, -40.0) + (None,) * 10)
    schema = "session_id long, timestamp_nanos long, " + ", ".join(f"{s}_{x} double" for s in ("accel", "gyro", "mag") for x in "xyz") + ", " + ", ".join(f"quat_{x} double" for x in "xyzw") + ", " + ", ".join(f"{s}_{x} double" for s in ("linear", "gravity") for x in "xyz")
    return spark.createDataFrame(rows, schema), spark.createDataFrame([(i, PLACE[0], PLACE[1], 10.0, 2.0, 0) for i in range(sessions)], "session_id long, lat double, lon double, bearing double, speed double, boot_offset_ms long")


def test_engines_run_on_spark(spark):
    motion, seeds = samples(spark)
    for engine in ("iekf", "pdr"):
        out = registry.run(motion, seeds, engine=engine).orderBy("session_id", "timestamp_nanos").collect()
        assert len(out) == 240 and all(np.isfinite(r["dr_lat"]) for r in out), engine
    assert sum(r["step_detected"] for r in out if r["session_id"] == 0) >= 1
    plain = plain_walk(motion.where("session_id = 1").orderBy("timestamp_nanos").collect())
    for r, want in zip([r for r in out if r["session_id"] == 1], plain, strict=True):
        assert np.allclose([r["acc_mag"], r["fused_heading_rad"], r["dr_x_east"], r["dr_y_north"]], want, atol=1e-9)


def plain_walk(rows):
    """The pedestrian engine, sample by sample."""
    low, c, first, mean, latched, x, y, sums, out = None, np.eye(3), None, 0.0, False, 0.0, 0.0, np.zeros(3), []
    for n, r in enumerate(rows, 1):
        acc, gyro, mag = (np.array([r[f"{s}_{a}"] for a in "xyz"]) for s in ("accel", "gyro", "mag"))
        low = acc if low is None else low + 0.05 * (acc - low)
        size = np.linalg.norm(acc - low)
        low = low + 0.05 * (acc - low)
        mean += (size - mean) / n
        step = size > mean + 1 and not latched
        latched = (latched or step) and not size < mean - 1
        if n <= 199:
            sums += gyro
        bias = sums / min(n, 199)
        rate = np.where(np.abs(gyro - bias) <= 0.0025, 0, gyro - bias)
        dx, dy, dz = rate * 0.01 if n > 1 else np.zeros(3)
        b = np.array([[0, -dz, -dx], [dz, 0, dy], [dx, -dy, 0]])
        q = dx * dx + dy * dy + dz * dz
        c = c @ (np.eye(3) + (1 - q / 6 + q * q / 120) * b + (0.5 - q / 24 + q * q / 720) * b @ b)
        east = np.cross(mag, low) / np.linalg.norm(np.cross(mag, low))
        head = np.arctan2(np.cross(low / np.linalg.norm(low), east)[1], east[1])
        first = head if first is None else first
        gyro_head = np.arctan2(c[1, 0], c[0, 0]) + first
        mixed = 0.02 * (np.fmod(head, 2 * np.pi) if head < 0 else head) + 0.98 * (np.fmod(gyro_head, 2 * np.pi) if gyro_head < 0 else gyro_head)
        fused = np.fmod(mixed, np.pi) - np.pi if mixed > np.pi else mixed
        if step:
            x, y = x + 0.75 * np.cos(fused), y + 0.75 * np.sin(fused)
        out.append((size, fused, x, y))
    return out
