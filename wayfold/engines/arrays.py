"""Arithmetic of the fold engines, on arrays with one entry a session."""

from __future__ import annotations

import numpy as np

GRAVITY = 9.80665
EQUATOR = 6_378_137.0


def turned(target: np.ndarray, current: np.ndarray) -> np.ndarray:
    """Signed turn in degrees from current to target, -180 to 180."""
    d = np.fmod(target - current, 360.0)
    return np.where(d > 180, d - 360, np.where(d < -180, d + 360, d))


def compass(degrees: np.ndarray) -> np.ndarray:
    return np.mod(degrees, 360.0)


def rotation(q: np.ndarray) -> np.ndarray:
    """Matrices of unit quaternions (x, y, z, w)."""
    x, y, z, w = q.T
    rows = [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), 2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), 2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]
    return np.stack(rows, axis=1).reshape(-1, 3, 3)


def skew(v: np.ndarray) -> np.ndarray:
    out = np.zeros((len(v), 3, 3))
    out[:, 0, 1], out[:, 0, 2], out[:, 1, 2] = -v[:, 2], v[:, 1], -v[:, 0]
    return out - out.transpose(0, 2, 1)


def exponential(v: np.ndarray) -> np.ndarray:
    """Rotations by rotation vectors, first order below 1e-7."""
    angle, k = np.linalg.norm(v, axis=1)[:, None, None], skew(v)
    near, safe = angle < 1e-7, np.maximum(angle, 1e-12)
    return np.eye(3) + np.where(near, 1.0, np.sin(angle) / safe) * k + np.where(near, 0.0, (1 - np.cos(angle)) / safe**2) * (k @ k)


def orthonormal(m: np.ndarray) -> np.ndarray:
    """Rows made orthonormal in order."""
    first = m[:, 0] / np.linalg.norm(m[:, 0], axis=1)[:, None]
    second = m[:, 1] - (m[:, 1] * first).sum(axis=1)[:, None] * first
    second /= np.linalg.norm(second, axis=1)[:, None]
    return np.stack([first, second, np.cross(first, second)], axis=1)


def yaw(m: np.ndarray) -> np.ndarray:
    return compass(np.degrees(np.arctan2(m[:, 0, 1], m[:, 1, 1])))


def about_up(degrees: np.ndarray) -> np.ndarray:
    """Rotations that turn a compass heading by ``degrees``."""
    c, s, o = np.cos(np.radians(degrees)), np.sin(np.radians(degrees)), np.zeros(len(degrees))
    return np.stack([c, s, o, -s, c, o, o, o, o + 1], axis=1).reshape(-1, 3, 3)


def columns(rows: dict, *names: str) -> np.ndarray:
    return np.stack([np.asarray(rows[n], float) for n in names], axis=1)


def stepped(s: dict, size: np.ndarray, width: float = 1.0) -> np.ndarray:
    """Steps by hysteresis about the running mean; updates ``seen``, ``mean``, ``latched``."""
    s["seen"] = s["seen"] + 1
    s["mean"] = s["mean"] + (size - s["mean"]) / s["seen"]
    found = (size > s["mean"] + width) & ~s["latched"]
    s["latched"] = (s["latched"] | found) & ~(size < s["mean"] - width)
    return found
