"""Invariant extended Kalman filter for a vehicle, with 21 error states: attitude, velocity,
place, both sensors' biases, the mount's rotation and its lever arm."""

from __future__ import annotations

import numpy as np

from wayfold.engines import fixes, snapping
from wayfold.engines.arrays import GRAVITY, about_up, columns, exponential, orthonormal, rotation, skew, stepped, yaw

ROT, VEL, POS, GYRO, ACC, MOUNT, ARM = (slice(3 * k, 3 * k + 3) for k in range(7))
# Variances at the start (attitude without yaw, velocity without up), of the
# noise by block, and of the pseudo-measurements.
FIRST = np.array([1e-6] * 2 + [0] + [0.09] * 2 + [0] * 4 + [1e-4] * 3 + [9e-4] * 3 + [1e-6] * 3 + [0.01] * 3)
NOISE = np.repeat([1.96e-4, 9e-4, 1e-8, 1e-6, 1e-8, 1e-8], 3)
SIDE_VAR, UP_VAR, STILL_VAR = 0.04, 9.0, 1e-4
QUIET_GYRO, QUIET_ACC, STILL_S, STILL_LONG_S, STILL_SPEED, REST_PASS, GYRO_PASS = 0.06, 0.35, 1.2, 2.5, 1.2, 0.02, 0.1
GYRO_MOST, ACC_MOST, TOO_FAST = 0.1, 1.5, 55.0
I3, I21 = np.eye(3), np.eye(21)


def start(many: int) -> dict:
    s = {n: np.zeros((many, 3)) for n in ("v", "p", "bias_gyro", "bias_acc", "arm")}
    s |= {"R": np.tile(I3, (many, 1, 1)), "Rc": np.tile(I3, (many, 1, 1)), "P": np.tile(np.diag(FIRST), (many, 1, 1)), "lat_lon": np.zeros((many, 2))}
    s |= {n: np.zeros(many) for n in "elapsed gyro_low still route_s mean seen slide confidence out_x out_y out_heading heading".split()}
    s |= {n: np.zeros(many, bool) for n in "aligned latched stationary off_line too_fast frozen".split()} | {n: np.full(many, -1, np.int64) for n in ("nanos", "fix_ms")}
    s |= {n: np.zeros(many, np.int64) for n in ("streak", "rejects", "steps", "zupts")}
    return s | {"memory": np.array([snapping.Memory() for _ in range(many)] + [None], object)[:-1], "mode": np.full(many, "FREE", object), "out_v": np.zeros((many, 2))}


def seed(s: dict, r: dict) -> None:
    s["lat_lon"], heading, speed = columns(r, "lat", "lon"), np.nan_to_num(r["bearing"]), np.nan_to_num(r["speed"])
    s["R"], s["heading"], s["out_heading"] = about_up(heading), heading, heading
    s["v"] = np.stack([speed * np.sin(np.radians(heading)), speed * np.cos(np.radians(heading)), 0 * speed], axis=1)
    snapping.begin(s, r)


def fix(s: dict, r: dict) -> None:
    """A fix moves the place and, when moving, velocity and yaw; the covariance stays."""
    take, x, y, accuracy = fixes.taken(s, r, s["p"][:, 0], s["p"][:, 1], np.hypot(s["v"][:, 0], s["v"][:, 1]))
    s["p"] = np.stack([x, y, s["p"][:, 2]], axis=1)
    fixes.along_route(s, take, x, y)
    told = take & np.isfinite(r["speed"])
    moving = told & (r["speed"] > 1.5) & (r["speed"] <= 40) & ~np.isnan(r["bearing"])
    bearing = np.where(moving, r["bearing"], 0.0)
    level = np.stack([r["speed"] * np.sin(np.radians(bearing)), r["speed"] * np.cos(np.radians(bearing)), s["v"][:, 2]], axis=1)
    halted = told & ~moving & (r["speed"] < 0.5)
    s["v"] = np.where(moving[:, None], level, np.where(halted[:, None], s["v"] * [0.0, 0.0, 1.0], s["v"]))
    s["R"] = np.where(moving[:, None, None], about_up(bearing - yaw(s["R"])) @ s["R"], s["R"])
    s["confidence"] = np.where(take, accuracy, s["confidence"])
    s["out_x"], s["out_y"], s["out_v"] = np.where(take, x, s["out_x"]), np.where(take, y, s["out_y"]), np.where(take[:, None], s["v"][:, :2], s["out_v"])


def align(s: dict, acc: np.ndarray, q: np.ndarray) -> None:
    """Attitude from the first usable sample: a quaternion, turned to the heading, or the tilt
    of the acceleration."""
    known, size = ~np.isnan(q).any(axis=1), np.linalg.norm(acc, axis=1)
    m = rotation(np.where(known[:, None], q, [0.0, 0.0, 0.0, 1.0]))
    by_quat = about_up(s["heading"] - yaw(m)) @ m
    ax, ay, az = acc.T
    pitch, roll = np.arctan2(ay, az), np.arctan2(-ax, np.hypot(ay, az))
    o = np.zeros(len(ax))
    about_x = np.stack([o + 1, o, o, o, np.cos(pitch), -np.sin(pitch), o, np.sin(pitch), np.cos(pitch)], axis=1).reshape(-1, 3, 3)
    about_y = np.stack([np.cos(roll), o, np.sin(roll), o, o + 1, o, -np.sin(roll), o, np.cos(roll)], axis=1).reshape(-1, 3, 3)
    by_tilt = about_up(s["heading"]) @ about_x @ about_y
    usable = known | ((size > 5) & (size < 15))
    new = np.where(known[:, None, None], by_quat, by_tilt)
    s["R"] = np.where((usable & ~s["aligned"])[:, None, None], new, s["R"])
    s["aligned"] = s["aligned"] | usable


def propagate(s: dict, acc: np.ndarray, rate: np.ndarray, dt: np.ndarray) -> None:
    """State and covariance one sample on; the Jacobian uses the new attitude and the old
    velocity and place."""
    d, dd = dt[:, None], dt[:, None, None]
    a = np.einsum("kij,kj->ki", s["R"], acc) - [0.0, 0.0, GRAVITY]
    before = s["v"]
    s["p"], s["v"] = s["p"] + before * d + 0.5 * a * d * d, before + a * d
    R = s["R"] = s["R"] @ exponential(rate * d)
    by_v, by_p = skew(before) @ R, skew(s["p"] - s["v"] * d) @ R
    f, g = np.zeros((len(dt), 21, 21)), np.zeros((len(dt), 21, 18))
    f[:, 3, 1], f[:, 4, 0] = GRAVITY, -GRAVITY
    f[:, POS, VEL] = I3
    f[:, VEL, ACC], f[:, ROT, GYRO], f[:, VEL, GYRO], f[:, POS, GYRO] = -R, -R, -by_v, -by_p
    g[:, ROT, 0:3], g[:, VEL, 3:6], g[:, VEL, 0:3], g[:, POS, 0:3] = R, R, by_v, by_p
    g[:, 9:21, 6:18] = np.eye(12)
    f, g = f * dd, g * dd
    square = f @ f
    phi = I21 + f + square / 2 + square @ f / 6
    s["P"] = phi @ (s["P"] + (g * NOISE) @ g.transpose(0, 2, 1)) @ phi.transpose(0, 2, 1)


def correct(s: dict, h: np.ndarray, residual: np.ndarray, variance: np.ndarray, chosen: np.ndarray) -> None:
    """Kalman update of the chosen sessions in Joseph's form, and retraction of the error."""
    P, ht = s["P"], h.transpose(0, 2, 1)
    S = h @ P @ ht + np.diag(variance)
    sound = chosen & np.isfinite(residual).all(axis=1) & (np.abs(np.linalg.det(S)) >= 1e-20)
    K = P @ ht @ np.linalg.inv(np.where(sound[:, None, None], S, np.eye(len(variance))))
    dx = np.einsum("kij,kj->ki", K, residual)
    left = I21 - K @ h
    new = left @ P @ left.transpose(0, 2, 1) + (K * variance) @ K.transpose(0, 2, 1)
    new = (new + new.transpose(0, 2, 1)) / 2
    dR = exponential(dx[:, ROT])
    made = {
        "P": new, "R": dR @ s["R"], "v": np.einsum("kij,kj->ki", dR, s["v"]) + dx[:, VEL], "p": np.einsum("kij,kj->ki", dR, s["p"]) + dx[:, POS],
        "bias_gyro": np.clip(s["bias_gyro"] + dx[:, GYRO], -GYRO_MOST, GYRO_MOST), "bias_acc": np.clip(s["bias_acc"] + dx[:, ACC], -ACC_MOST, ACC_MOST),
        "Rc": exponential(dx[:, MOUNT]) @ s["Rc"], "arm": s["arm"] + dx[:, ARM],
    }
    for name, value in made.items():
        s[name] = np.where(sound.reshape(-1, *[1] * (value.ndim - 1)), value, s[name])


def sample(s: dict, r: dict, roads=None) -> dict:
    dt = np.where(s["nanos"] < 0, 0.01, np.clip((r["t_nanos"] - s["nanos"]) / 1e9, 0.001, 0.2))
    s["nanos"], s["elapsed"] = r["t_nanos"].astype(np.int64), s["elapsed"] + dt
    raw, gyro = columns(r, "accel_x", "accel_y", "accel_z"), columns(r, "gyro_x", "gyro_y", "gyro_z")
    align(s, raw, columns(r, "quat_x", "quat_y", "quat_z", "quat_w"))
    rate, acc = gyro - s["bias_gyro"], raw - s["bias_acc"]
    propagate(s, acc, rate, dt)
    gyro_size, size = np.linalg.norm(gyro, axis=1), np.linalg.norm(raw, axis=1)
    s["gyro_low"] = s["gyro_low"] + GYRO_PASS * (gyro_size - s["gyro_low"])
    step = stepped(s, size)
    s["steps"] = s["steps"] + step
    quiet = (gyro_size < QUIET_GYRO) & (np.abs(size - GRAVITY) < QUIET_ACC) & ~step
    s["still"] = np.where(quiet, s["still"] + dt, 0.0)
    speed = np.hypot(s["v"][:, 0], s["v"][:, 1])
    halt = s["stationary"] = (s["still"] >= STILL_S) & ((speed < STILL_SPEED) | (s["still"] >= STILL_LONG_S))
    # A vehicle neither slides nor lifts: no velocity across or up in its own frame.
    body = s["R"] @ s["Rc"]
    in_phone = np.einsum("kji,kj->ki", s["R"], s["v"])
    in_body = np.einsum("kji,kj->ki", s["Rc"], in_phone) + np.cross(s["arm"], rate)
    h = np.zeros((len(dt), 2, 21))
    for row, axis in enumerate((0, 2)):
        h[:, row, VEL] = body[:, :, axis]
        h[:, row, MOUNT] = (s["Rc"].transpose(0, 2, 1) @ skew(in_phone))[:, axis]
        h[:, row, GYRO], h[:, row, ARM] = -skew(s["arm"])[:, axis], -skew(rate)[:, axis]
    slide = s["slide"] = np.where(halt, s["slide"], -in_body[:, 0])
    still = np.zeros((len(dt), 3, 21))
    still[:, :, VEL] = I3
    correct(s, still, -s["v"], np.full(3, STILL_VAR), halt)
    rest = np.einsum("kij,kj->ki", s["R"], acc) - [0.0, 0.0, GRAVITY]
    bias = np.clip(s["bias_acc"] + REST_PASS * np.einsum("kji,kj->ki", s["R"], rest), -ACC_MOST, ACC_MOST)
    s["bias_acc"], s["zupts"] = np.where(halt[:, None], bias, s["bias_acc"]), s["zupts"] + halt
    correct(s, h, -in_body[:, [0, 2]], np.array([SIDE_VAR, UP_VAR]), ~halt)
    turn = (s["elapsed"] / dt).astype(np.int64)
    s["R"] = np.where((turn % 100 == 0)[:, None, None], orthonormal(s["R"]), s["R"])
    s["Rc"] = np.where((turn % 1000 == 0)[:, None, None], orthonormal(s["Rc"]), s["Rc"])
    s["heading"] = yaw(s["R"])
    s["out_x"], s["out_y"], _, _, s["mode"], s["off_line"] = snapping.place(s, s["p"][:, 0].copy(), s["p"][:, 1].copy(), s["heading"], speed, roads)
    s["out_v"], s["out_heading"] = s["v"][:, :2], s["heading"]
    s["too_fast"] = ~np.isfinite(speed) | (speed > TOO_FAST)
    s["confidence"] = 2 + s["elapsed"] * np.where(fixes.fresh(s, r["t_ms"]), 0.05, 0.8)
    return {
        "acc_mag": size, "step_detected": step, "stride_length": speed * dt, "gyro_heading_rad": np.radians(s["heading"]), "mag_heading_rad": np.full(len(dt), np.nan),
        "fused_heading_rad": np.radians(s["heading"]), "forward_speed_mps": speed, "yaw_rate_deg_s": np.degrees(rate[:, 2]), "lateral_vel_mps": slide,
        "bias_omega_mag": np.linalg.norm(s["bias_gyro"], axis=1), "bias_acc_mag": np.linalg.norm(s["bias_acc"], axis=1), "nhc_residual_lat": slide,
    }
