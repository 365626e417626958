"""Matching of an engine's place to a planned route, its own trail and the road network.

A session's route and trail are its own arrays; the network is shared (see ``roads``). A match is (east, north, unit east, unit
north) or None. The three matchers are tried in that order and never change the raw place.
"""

from __future__ import annotations

import math

import numpy as np

from wayfold.engines.arrays import EQUATOR
from wayfold.engines.roads import FIELDS, Roads

# Gates in metres and seconds, shares and weights.
ROUTE_GATE, ROUTE_BACK, ROUTE_AHEAD = 25.0, 5.0, 100.0
TRAIL_GAP, TRAIL_POINTS, TRAIL_SPEED, TRAIL_GATE, TRAIL_ALIGN, TRAIL_WEIGHT = 2.0, 2000, 1.0, 20.0, 0.5, 10.0
TRAIL_AGAIN_M, TRAIL_AGAIN_S = 5.0, 1.5
RECENT_GAP, RECENT_POINTS, RECENT_LENGTH = 1.0, 60, 6.0
ROAD_GATE, ROAD_AGAIN_M, ROAD_AGAIN_S, SHORT_EDGE = 30.0, 10.0, 2.0, 1.0
OUTSIDE = 0.05


class Line:
    """Segments of a polyline with the arc length at their start."""

    def __init__(self, points: np.ndarray) -> None:
        step = np.diff(points, axis=0)
        length = np.hypot(*step.T)
        start = np.concatenate([[0.0], np.cumsum(length)])[:-1]
        sound = length >= 1e-6
        self.a, self.step, self.length, self.start = points[:-1][sound], step[sound], length[sound], start[sound]

    def project(self, x: float, y: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unclamped place along each segment, distance from its nearest point, arc length."""
        raw = ((x - self.a[:, 0]) * self.step[:, 0] + (y - self.a[:, 1]) * self.step[:, 1]) / self.length**2
        t = np.clip(raw, 0, 1)
        off = np.hypot(x - self.a[:, 0] - t * self.step[:, 0], y - self.a[:, 1] - t * self.step[:, 1])
        return raw, off, self.start + t * self.length

    def progress(self, x: float, y: float, before: float) -> float:
        """Arc length of the nearest point of the whole line."""
        if not len(self.length):
            return before
        _, off, s = self.project(x, y)
        return float(s[np.argmin(off)])

    def match(self, x: float, y: float, s: float):
        """Nearest point of the segments beside the place, from a little behind ``s`` to some way
        ahead, with its arc length."""
        if not len(self.length):
            return None
        raw, off, at = self.project(x, y)
        off = np.where((raw >= -OUTSIDE) & (raw <= 1 + OUTSIDE) & (at + ROUTE_BACK >= s) & (at <= s + ROUTE_AHEAD), off, np.inf)
        k = int(np.argmin(off))
        if off[k] > ROUTE_GATE:
            return None
        unit = self.step[k] / self.length[k]
        place = self.a[k] + unit * (at[k] - self.start[k])
        return place[0], place[1], unit[0], unit[1], at[k]


def on_edges(edges: np.ndarray, x, y, gate: float, heading) -> tuple[np.ndarray, ...]:
    """Which places lie beside their edge (ax, ay, bx, by), the point on it, and its direction along
    the heading."""
    ax, ay, bx, by = edges.T[:4]
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    long = square >= SHORT_EDGE
    size = np.where(long, square, 1.0)
    raw = ((x - ax) * dx + (y - ay) * dy) / size
    t = np.clip(raw, 0.0, 1.0)
    qx, qy = ax + t * dx, ay + t * dy
    found = long & (raw >= -OUTSIDE) & (raw <= 1 + OUTSIDE) & (np.hypot(x - qx, y - qy) <= gate)
    ux, uy = dx / np.sqrt(size), dy / np.sqrt(size)
    sign = np.where(ux * np.sin(np.radians(heading)) + uy * np.cos(np.radians(heading)) < 0, -1.0, 1.0)
    return found, qx, qy, sign * ux, sign * uy


class Places:
    """The last ``most`` places of a session, in one array."""

    def __init__(self, most: int) -> None:
        self.most, self.start, self.stop = most, 0, 0
        self.held = np.zeros((16, 2))

    def __len__(self) -> int:
        return self.stop - self.start

    def points(self) -> np.ndarray:
        return self.held[self.start : self.stop]

    def add(self, x: float, y: float) -> None:
        if self.stop == len(self.held):
            own = self.points()
            self.held = np.zeros((max(16, 2 * min(len(own), self.most)), 2))
            self.held[: len(own)] = own
            self.start, self.stop = 0, len(own)
        self.held[self.stop] = x, y
        self.stop += 1
        self.start = max(self.start, self.stop - self.most)

    def far(self, x: float, y: float, gap: float) -> bool:
        """Whether a place is ``gap`` or more from the last one."""
        if self.stop == self.start:
            return True
        ex, ey = self.held[self.stop - 1].tolist()
        return math.hypot(x - ex, y - ey) >= gap


class Memory:
    """What a session remembers: its route, the places it has driven by and its cached edges."""

    def __init__(self) -> None:
        self.line: Line | None = None
        self.points: np.ndarray | None = None  # of the route, lat and lon
        self.roads: Roads | None = None  # a network of its own
        self.trail, self.recent = Places(TRAIL_POINTS), Places(RECENT_POINTS)
        self.edge: np.ndarray | None = None
        self.road: np.ndarray | None = None
        self.reversed = False
        self.asked, self.asked_road = (0.0, 0.0, -1.0), (0.0, 0.0, -1.0)

    def trail_due(self, x: float, y: float, elapsed: float) -> bool:
        return self.edge is None or math.hypot(x - self.asked[0], y - self.asked[1]) > TRAIL_AGAIN_M or elapsed - self.asked[2] > TRAIL_AGAIN_S

    def road_due(self, x: float, y: float, elapsed: float) -> bool:
        """Whether the network has to be asked: without an edge, or after a way or a time."""
        return self.road is None or math.hypot(x - self.asked_road[0], y - self.asked_road[1]) > ROAD_AGAIN_M or elapsed - self.asked_road[2] > ROAD_AGAIN_S

    def road_told(self, x: float, y: float, elapsed: float, edge: np.ndarray | None) -> None:
        """The answer (both ends, east and north, and the distance), or None. An edge that is
        too short leaves the last one."""
        self.asked_road = (x, y, elapsed)
        if edge is None or not edge[4] <= ROAD_GATE:
            self.road = None
        elif np.hypot(edge[2] - edge[0], edge[3] - edge[1]) > SHORT_EDGE:
            self.road = edge

    def way(self) -> tuple[float, float]:
        """Direction of the recent motion; NaN if it is too short."""
        own = self.recent.points()
        east, north = (own[-1] - own[0]).tolist() if len(own) > 1 else (0.0, 0.0)
        length = math.hypot(east, north)
        return (east / length, north / length) if length >= RECENT_LENGTH else (math.nan, math.nan)


def trail_edges(memories: list[Memory], x, y, heading) -> list[np.ndarray | None]:
    """The driven segment of each session (both ends, and 1 if it is driven the other way) that best
    explains its motion, in either direction; the segments of all sessions in one pass."""
    own = [m.trail.points() for m in memories]
    sizes = np.array([len(p) for p in own])
    points = np.concatenate(own)
    ends = np.cumsum(sizes)
    first = np.ones(len(points), bool)
    first[ends - 1] = False  # the last place of a session begins no segment
    at, owner = np.flatnonzero(first), np.repeat(np.arange(len(own)), sizes - 1)
    a = points[at]
    d = points[at + 1] - a
    length = np.hypot(*d.T)
    sound = length >= 1e-6
    unit = d / np.where(sound, length, 1.0)[:, None]
    raw = ((x[owner] - a[:, 0]) * unit[:, 0] + (y[owner] - a[:, 1]) * unit[:, 1]) / np.where(sound, length, 1.0)
    t = np.clip(raw, 0, 1)
    off = np.hypot(x[owner] - a[:, 0] - t * d[:, 0], y[owner] - a[:, 1] - t * d[:, 1])
    turn = np.radians(heading)
    align = unit[:, 0] * np.sin(turn)[owner] + unit[:, 1] * np.cos(turn)[owner]
    way = np.array([m.way() for m in memories])
    alike = unit[:, 0] * way[owner, 0] + unit[:, 1] * way[owner, 1]
    sound &= (off <= TRAIL_GATE) & (np.abs(align) >= TRAIL_ALIGN) & ~(np.abs(alike) < TRAIL_ALIGN)
    score = np.where(sound, off - TRAIL_WEIGHT * np.abs(align), np.inf)
    starts = ends - sizes - np.arange(len(own))
    least = np.minimum.reduceat(score, starts)
    best = np.flatnonzero((score == least[owner]) & sound)
    who, k = np.unique(owner[best], return_index=True)
    found: list[np.ndarray | None] = [None] * len(own)
    for m, k in zip(who.tolist(), best[k].tolist(), strict=True):
        found[m] = np.array([*a[k], *points[at[k] + 1], align[k] < 0])
    return found


def on_trails(s: dict, asked: list[int], x, y, heading, speed) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Which of the sessions ``asked`` are on their trail, and where (see ``on_edges``)."""
    memories, elapsed = s["memory"], s["elapsed"]
    able = [k for k in asked if len(memories[k].trail) > 1 and speed[k] >= TRAIL_SPEED]
    for k in set(asked).difference(able):
        memories[k].edge = None
    due = [k for k in able if memories[k].trail_due(x[k], y[k], elapsed[k])]
    if due:
        for k, edge in zip(due, trail_edges([memories[k] for k in due], x[due], y[due], heading[due]), strict=True):
            memories[k].asked, memories[k].edge = (x[k], y[k], elapsed[k]), edge
    who, found = matched(able, "edge", memories, x, y, heading, TRAIL_GATE)
    for k in who.tolist():
        memories[k].reversed = bool(memories[k].edge[4])
    return who, found


def matched(asked: list[int], name: str, memories, x, y, heading, gate: float) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Which sessions lie beside the edge ``name`` that they remember; the others forget it."""
    held = np.array([k for k in asked if getattr(memories[k], name) is not None], int)
    if not len(held):
        return held, (np.zeros(0),) * 4
    found, *place_ = on_edges(np.stack([getattr(memories[k], name)[:4] for k in held]), x[held], y[held], gate, heading[held])
    for k in held[~found]:
        setattr(memories[k], name, None)
    return held[found], tuple(v[found] for v in place_)


def set_route(s: dict, k: int, points) -> None:
    """A session's route by its points (lat, lon); fewer than two clear it. Progress starts
    over, and the points stay for a new start elsewhere."""
    memory, s["route_s"][k] = s["memory"][k], 0.0
    memory.points = None if points is None or len(points) < 2 else np.array([list(p.values() if isinstance(p, dict) else p) for p in points], float)
    memory.line = None
    if memory.points is not None:
        lat0, lon0 = s["lat_lon"][k]
        east = np.radians(memory.points[:, 1] - lon0) * EQUATOR * np.cos(np.radians(lat0))
        memory.line = Line(np.stack([east, np.radians(memory.points[:, 0] - lat0) * EQUATOR], axis=1))


def begin(s: dict, r: dict) -> None:
    """Route and network of sessions that begin, or begin anew: then what they had stays
    unless the row brings its own."""
    many = len(s["memory"])
    for k, (points, edges) in enumerate(zip(r.get("route", [None] * many), r.get("roads", [None] * many), strict=True)):
        memory = s["memory"][k]
        if edges is not None and len(edges):
            memory.roads = Roads({n: np.array([e[n] for e in edges]) for n in FIELDS})
        set_route(s, k, memory.points if points is None else points)


def kept(memory: Memory) -> Memory:
    """What a session takes along when it begins anew."""
    new = Memory()
    new.points, new.roads = memory.points, memory.roads
    return new


def ask_roads(s: dict, asked: list[int], x, y, heading, roads) -> None:
    """Asks the network, that of all sessions or a session's own, for those that are due."""
    due = [k for k in asked if s["memory"][k].road_due(x[k], y[k], s["elapsed"][k])]
    shared = [k for k in due if s["memory"][k].roads is None and roads is not None]
    for group, index in [(shared, roads), *(([k], s["memory"][k].roads) for k in due if s["memory"][k].roads is not None)]:
        if not group:
            continue
        lat0, lon0 = s["lat_lon"][group].T
        wide = EQUATOR * np.cos(np.radians(lat0))
        found = index.snap(lat0 + np.degrees(y[group] / EQUATOR), lon0 + np.degrees(x[group] / wide), heading[group])
        ends = np.stack([np.radians(found[:, 1] - lon0) * wide, np.radians(found[:, 0] - lat0) * EQUATOR, np.radians(found[:, 3] - lon0) * wide, np.radians(found[:, 2] - lat0) * EQUATOR, found[:, 4]], axis=1)
        for k, edge in zip(group, ends, strict=True):
            s["memory"][k].road_told(x[k], y[k], s["elapsed"][k], None if np.isnan(edge[4]) else edge)


def place(s: dict, x, y, heading, speed, roads=None) -> tuple[np.ndarray, ...]:
    """Output place, direction (NaN if free) and mode of each session; ``s`` holds ``memory``,
    ``route_s``, ``elapsed`` and ``stationary``. A driven place joins the trail. ``roads`` is the
    network of all sessions (:class:`wayfold.engines.roads.Roads`), if there is one."""
    out_x, out_y, ux, uy = x.copy(), y.copy(), np.full(len(x), np.nan), np.full(len(x), np.nan)
    mode, off_line = np.where(s["stationary"], "ZUPT", "FREE").astype(object), np.zeros(len(x), bool)
    memories, free = s["memory"], []
    for k, (memory, east, north) in enumerate(zip(memories, x.tolist(), y.tolist(), strict=True)):
        if memory.recent.far(east, north, RECENT_GAP):
            memory.recent.add(east, north)
        found = memory.line.match(east, north, s["route_s"][k]) if memory.line else None
        off_line[k] = memory.line is not None and found is None
        if found is None:
            free.append(k)
        else:
            out_x[k], out_y[k], ux[k], uy[k], s["route_s"][k] = found
            mode[k] = "ROUTE"

    def take(who: np.ndarray, found: tuple[np.ndarray, ...]) -> None:
        for values, own in zip((out_x, out_y, ux, uy), found, strict=True):
            values[who] = own

    if free:
        who, found = on_trails(s, free, x, y, heading, speed)
        take(who, found)
        for k in who.tolist():
            mode[k] = "TRAIL-REV" if memories[k].reversed else "TRAIL"
        left = [k for k in sorted(set(free).difference(who.tolist())) if roads is not None or memories[k].roads is not None]
        if left:
            ask_roads(s, left, x, y, heading, roads)
            who, found = matched(left, "road", memories, x, y, heading, ROAD_GATE)
            take(who, found)
            mode[who] = "AUTO"
    for k in np.flatnonzero(~s["stationary"] & (speed >= TRAIL_SPEED)).tolist():
        if memories[k].trail.far(out_x[k], out_y[k], TRAIL_GAP):
            memories[k].trail.add(out_x[k], out_y[k])
    return out_x, out_y, ux, uy, mode, off_line
