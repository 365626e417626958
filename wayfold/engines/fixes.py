"""How both engines take a position fix: accuracy filter, plausibility gate, blend."""

from __future__ import annotations

import numpy as np

from wayfold.engines.arrays import EQUATOR

FRESH_MS = 8000


def local(s: dict, lat, lon) -> tuple[np.ndarray, np.ndarray]:
    """East and north of a place about a session's start."""
    return np.radians(lon - s["lat_lon"][:, 1]) * EQUATOR * np.cos(np.radians(s["lat_lon"][:, 0])), np.radians(lat - s["lat_lon"][:, 0]) * EQUATOR


def taken(s: dict, r: dict, x, y, speed) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which fixes are taken, where the place moves to, and their accuracy. Updates the time
    of the last fix, the streak and the number of rejected ones."""
    accuracy = np.maximum(np.where(np.isnan(r["accuracy"]), 5.0, r["accuracy"]), 1.0)
    e, n = local(s, r["lat"], r["lon"])
    first = s["fix_ms"] < 0
    gap = np.where(first, 0.0, np.clip((r["t_ms"] - s["fix_ms"]) / 1000, 0, 3600))
    gate = 3 * accuracy + np.minimum(speed, 25.0) * gap + 15
    used = accuracy <= 30
    glitch = used & ~first & (s["streak"] < 5) & (np.hypot(e - x, n - y) > gate)
    take = used & ~glitch
    s["streak"] = np.where(take, 0, s["streak"] + glitch)
    s["rejects"] = s["rejects"] + glitch
    s["fix_ms"] = np.where(take, r["t_ms"], s["fix_ms"])
    k = np.clip(5 / accuracy, 0.15, 1.0) * take
    return take, x + np.where(take, k * (e - x), 0.0), y + np.where(take, k * (n - y), 0.0), accuracy


def fresh(s: dict, t_ms) -> np.ndarray:
    return (s["fix_ms"] >= 0) & (t_ms - s["fix_ms"] < FRESH_MS)


def along_route(s: dict, take: np.ndarray, x, y) -> None:
    for k in np.flatnonzero(take):
        if (line := s["memory"][k].line) is not None:
            s["route_s"][k] = line.progress(x[k], y[k], s["route_s"][k])
