"""Route-aware fusion: inertial velocity kept to the heading, fused with fixes and maps."""

from __future__ import annotations

import numpy as np

from wayfold.engines import fixes, snapping
from wayfold.engines.arrays import GRAVITY, columns, compass, rotation, stepped, turned, yaw
from wayfold.operators import folds

# Fixed values of the filters: shares per sample, seconds, metres a second, degrees a second.
LOW_PASS, GYRO_PASS, YAW_PASS, ANCHOR, BIAS_PASS, MOUNT_PASS = 0.25, 0.1, 0.05, 0.02, 0.05, 0.08
SHOCK, FASTEST, DRAG, WALK = 20.0, 55.0, 0.02, 1.25
VELOCITY_TAU, DOMINANT_TAU, PULL_TAU, HEADING_SPEED, DOMINANT_SPEED = 0.4, 2.0, 3.0, 1.5, 2.5
TURN_RATE, TURN_GYRO, TURN_SHARE, TURN_MOST = 15.0, 0.25, 0.3, 100.0
SIDE_DAMP, SIDE_TURN, SIDE_DEAD, SIDE_MOST = 1.5, 2.0, 0.25, 8.0
QUIET_GYRO, QUIET_ACC, STILL_S, STILL_LONG_S, STILL_SPEED = 0.06, 0.35, 1.2, 2.5, 1.2
FORWARD, BRAKE, COAST = 4.5, 6.5, 0.15


def start(many: int) -> dict:
    zero = "elapsed acc_mag gyro_low yaw_rate offset forward side ve vn fve fvn gyro_heading dominant heading bias_e bias_n still x y route_s mean seen confidence out_x out_y since".split()
    no = "lp_on gyro_on mounted dominant_on latched stationary off_line told frozen too_fast".split()
    s = {n: np.zeros(many) for n in zero} | {n: np.zeros(many, bool) for n in no}
    s |= {n: np.full(many, -1, np.int64) for n in ("nanos", "fix_ms")} | {n: np.zeros(many, np.int64) for n in ("streak", "rejects", "steps", "zupts")}
    s |= {n: np.full(many, np.nan) for n in ("yaw_before", "stood_e", "stood_n")}
    s |= {"lat_lon": np.zeros((many, 2)), "lp": np.zeros((many, 3)), "memory": np.array([snapping.Memory() for _ in range(many)] + [None], object)[:-1]}
    return s | {"mode": np.full(many, "FREE", object), "out_v": np.zeros((many, 2)), "out_heading": np.zeros(many)}


def seed(s: dict, r: dict) -> None:
    """The session begins at a place with a heading and a speed."""
    s["lat_lon"] = columns(r, "lat", "lon")
    heading, speed = np.nan_to_num(r["bearing"]), np.nan_to_num(r["speed"])
    s["heading"] = s["gyro_heading"] = s["dominant"] = s["out_heading"] = compass(heading)
    s["gyro_on"], s["dominant_on"] = np.ones(len(heading), bool), np.ones(len(heading), bool)
    s["forward"], s["ve"], s["vn"] = speed, speed * np.sin(np.radians(heading)), speed * np.cos(np.radians(heading))
    s["fve"], s["fvn"] = s["ve"].copy(), s["vn"].copy()
    snapping.begin(s, r)


def fix(s: dict, r: dict) -> None:
    """A fix moves the place; a moving one sets speed and headings and turns the mount."""
    take, s["x"], s["y"], accuracy = fixes.taken(s, r, s["x"], s["y"], s["forward"])
    fixes.along_route(s, take, s["x"], s["y"])
    told = take & np.isfinite(r["speed"]) & (r["speed"] >= 0) & (r["speed"] <= 40)
    moving = told & (r["speed"] > 1.5) & ~np.isnan(r["bearing"])
    offset = turned(r["bearing"], s["heading"] - s["offset"])
    later = s["offset"] + MOUNT_PASS * turned(offset, s["offset"])
    s["offset"] = np.where(moving, np.where(s["mounted"], later, offset), s["offset"])
    s["mounted"] = s["mounted"] | moving
    halted = told & ~moving & (r["speed"] < 0.5)
    for name, value in (("forward", r["speed"]), ("ve", r["speed"] * np.sin(np.radians(r["bearing"]))), ("vn", r["speed"] * np.cos(np.radians(r["bearing"])))):
        s[name] = np.where(moving, value, np.where(halted, 0.0, s[name]))
    s["side"] = np.where(moving | halted, 0.0, s["side"])
    s["fve"], s["fvn"] = np.where(moving, s["ve"], s["fve"]), np.where(moving, s["vn"], s["fvn"])
    for name in ("heading", "gyro_heading", "dominant"):
        s[name] = np.where(moving, compass(r["bearing"]), s[name])
    s["still"] = np.where(take, 0.0, s["still"])
    s["confidence"] = np.where(take, accuracy, s["confidence"])
    s["out_x"], s["out_y"] = np.where(take, s["x"], s["out_x"]), np.where(take, s["y"], s["out_y"])


def sample(s: dict, r: dict, roads=None) -> dict:
    """One motion sample; the steps keep the order in which each uses the others' results."""
    dt = np.where(s["nanos"] < 0, 0.01, np.clip((r["t_nanos"] - s["nanos"]) / 1e9, 0.001, 0.2))
    s["nanos"], s["elapsed"] = r["t_nanos"].astype(np.int64), s["elapsed"] + dt
    raw, gyro, q = columns(r, "accel_x", "accel_y", "accel_z"), columns(r, "gyro_x", "gyro_y", "gyro_z"), columns(r, "quat_x", "quat_y", "quat_z", "quat_w")
    known = ~np.isnan(q).any(axis=1)
    m = rotation(np.where(known[:, None], q, [0.0, 0.0, 0.0, 1.0]))
    # Linear acceleration: the sensor's, else less gravity.
    linear = columns(r, "linear_x", "linear_y", "linear_z")
    down = np.where(known[:, None], -GRAVITY * m[:, 2], [0.0, 0.0, GRAVITY])
    linear = np.where(np.isnan(linear).any(axis=1)[:, None], raw - down, linear)
    s["acc_mag"] = np.linalg.norm(linear, axis=1)
    s["lp"] = np.where(s["lp_on"][:, None], s["lp"], linear)
    s["lp_on"] = np.ones(len(dt), bool)
    s["lp"] = s["lp"] + LOW_PASS * (linear - s["lp"])
    size = np.linalg.norm(s["lp"], axis=1)
    acc = s["lp"] * np.where(size > SHOCK, SHOCK / np.maximum(size, 1e-9), 1.0)[:, None]
    # Heading: device yaw, carried by its own changes where it fails.
    device = np.where(known, yaw(m), np.nan)
    gyro_size = np.linalg.norm(gyro, axis=1)
    s["gyro_low"] = s["gyro_low"] + GYRO_PASS * (gyro_size - s["gyro_low"])
    begins = known & ~s["gyro_on"]
    s["gyro_heading"] = np.where(begins, compass(device + s["offset"]), s["gyro_heading"])
    goes = known & s["gyro_on"] & ~np.isnan(s["yaw_before"])
    change = np.clip(np.where(goes, turned(device, s["yaw_before"]) / dt, 0.0), -180, 180)
    s["yaw_rate"] = np.where(goes, s["yaw_rate"] + YAW_PASS * (change - s["yaw_rate"]), s["yaw_rate"])
    s["gyro_heading"] = np.where(goes, compass(s["gyro_heading"] + change * dt), s["gyro_heading"])
    lost = s["yaw_rate"] * (1 - YAW_PASS)
    s["yaw_rate"] = np.where(known, s["yaw_rate"], np.where(s["gyro_low"] > TURN_GYRO, np.clip(lost, -40, 40), lost))
    s["yaw_before"], s["gyro_on"] = np.where(known, device, s["yaw_before"]), s["gyro_on"] | known
    fused = np.where(known, compass(device + s["offset"]), s["gyro_heading"])
    s["gyro_heading"] = np.where(known, compass(s["gyro_heading"] + ANCHOR * turned(fused, s["gyro_heading"])), s["gyro_heading"])
    # To the world, or by the heading alone.
    world = np.einsum("kij,kj->ki", m, acc)
    sin, cos = np.sin(np.radians(fused)), np.cos(np.radians(fused))
    east = np.where(known, world[:, 0], acc[:, 0] * sin + acc[:, 1] * cos)
    north = np.where(known, world[:, 1], -acc[:, 0] * cos + acc[:, 1] * sin)
    step = stepped(s, np.linalg.norm(raw, axis=1))
    s["steps"] = s["steps"] + step
    quiet = (gyro_size < QUIET_GYRO) & (size < QUIET_ACC) & ~step
    s["still"] = np.where(quiet, s["still"] + dt, 0.0)
    halt = s["stationary"] = (s["still"] >= STILL_S) & ((s["forward"] < STILL_SPEED) | (s["still"] >= STILL_LONG_S))
    s["bias_e"] = np.where(halt, s["bias_e"] + BIAS_PASS * (east - s["bias_e"]), s["bias_e"])
    s["bias_n"] = np.where(halt, s["bias_n"] + BIAS_PASS * (north - s["bias_n"]), s["bias_n"])
    s["zupts"] = s["zupts"] + halt
    # Velocity, split along and across the heading; a step lifts a walker's speed.
    lift = np.where(step, np.maximum(0.0, WALK - (s["ve"] * sin + s["vn"] * cos)), 0.0)
    ae, an = east - s["bias_e"], north - s["bias_n"]
    ve, vn = s["ve"] + lift * sin + ae * dt, s["vn"] + lift * cos + an * dt
    forward, push = ve * sin + vn * cos, np.clip(ae * sin + an * cos, -BRAKE, FORWARD)
    rate = np.radians(s["yaw_rate"])
    turning = (np.abs(s["yaw_rate"]) > TURN_RATE) | (s["gyro_low"] > TURN_GYRO)
    residual = (ae * cos - an * sin - forward * rate) * np.where(turning, TURN_SHARE, 1.0)
    side = s["side"] * np.exp(-(SIDE_DAMP + np.abs(rate) * SIDE_TURN) * dt) + residual * dt
    side = np.clip(np.where(~turning & (np.abs(side) < SIDE_DEAD), 0.0, side), -SIDE_MOST, SIDE_MOST)
    forward = np.where((np.abs(push) < COAST) & ~step, forward * (1 - DRAG * dt), forward)
    forward = np.clip(forward, 0, FASTEST)
    s["too_fast"] = ~halt & ~np.isfinite(forward)  # bounded above, so only a broken speed fails
    forward, side = np.where(halt | ~np.isfinite(forward), 0.0, forward), np.where(halt, 0.0, side)
    ve, vn = sin * forward + cos * side, cos * forward - sin * side
    # The filtered velocity steers the dominant heading, which pulls the heading when straight.
    alpha = dt / (VELOCITY_TAU + dt)
    s["fve"], s["fvn"] = np.where(halt, 0.0, s["fve"] + alpha * (ve - s["fve"])), np.where(halt, 0.0, s["fvn"] + alpha * (vn - s["fvn"]))
    filtered = np.hypot(s["fve"], s["fvn"])
    sure = ~halt & (filtered > HEADING_SPEED)
    way = compass(np.degrees(np.arctan2(s["fve"], s["fvn"])))
    straight = sure & ~turning & (filtered > DOMINANT_SPEED)
    steered = compass(s["dominant"] + turned(way, s["dominant"]) * dt / (DOMINANT_TAU + dt))
    s["dominant"] = np.where(sure & ~s["dominant_on"], way, np.where(straight & s["dominant_on"], steered, s["dominant"]))
    s["dominant_on"] = s["dominant_on"] | sure
    pulled = np.where(straight, compass(fused + turned(s["dominant"], fused) * dt / (PULL_TAU + dt)), fused)
    first = s["elapsed"] <= dt + 1e-9
    base = np.where(first, pulled, s["heading"])
    limited = compass(base + np.clip(turned(pulled, base), -TURN_MOST * dt, TURN_MOST * dt))
    s["heading"] = np.where(halt, fused, limited)
    sin, cos = np.sin(np.radians(s["heading"])), np.cos(np.radians(s["heading"]))
    s["forward"], s["side"] = forward, side
    s["ve"], s["vn"] = sin * forward + cos * side, cos * forward - sin * side
    s["x"], s["y"] = s["x"] + s["ve"] * dt, s["y"] + s["vn"] * dt
    ox, oy, ux, uy, s["mode"], s["off_line"] = snapping.place(s, s["x"], s["y"], s["heading"], forward, roads)
    free = np.isnan(ux)
    s["out_v"] = np.stack([np.where(free, s["ve"], ux * forward), np.where(free, s["vn"], uy * forward)], axis=1)
    s["out_x"], s["out_y"] = ox, oy
    s["out_heading"] = np.where(np.hypot(*s["out_v"].T) > 0.5, compass(np.degrees(np.arctan2(*s["out_v"].T))), s["heading"])
    fresh = fixes.fresh(s, r["t_ms"])
    s["confidence"] = 2 + s["elapsed"] * np.where(fresh, 0.05, 0.8)
    stood, s["frozen"] = folds.stood({"e": s["stood_e"], "n": s["stood_n"], "since": s["since"], "told": s["told"]}, s["elapsed"], ox, oy, forward, fresh, halt)
    s["stood_e"], s["stood_n"], s["since"], s["told"] = (stood[n] for n in ("e", "n", "since", "told"))
    nan = np.full(len(dt), np.nan)
    return {
        "acc_mag": s["acc_mag"], "step_detected": step, "stride_length": forward * dt, "gyro_heading_rad": np.radians(s["gyro_heading"]), "mag_heading_rad": np.radians(device),
        "fused_heading_rad": np.radians(s["out_heading"]), "forward_speed_mps": forward, "yaw_rate_deg_s": s["yaw_rate"], "lateral_vel_mps": side, "bias_omega_mag": nan, "bias_acc_mag": nan, "nhc_residual_lat": nan,
    }
