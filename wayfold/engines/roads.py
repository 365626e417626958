"""Road networks for the engines: the edge that a moving place is most likely on.

The directed edges of all graphs are packed into arrays sorted by the grid cell of their start
node, so a question looks at nine cells and many sessions ask at once. A network within
``EDGES`` goes to every task; of a larger one each session carries the part it can get to.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.engines.arrays import EQUATOR

#: Most directed edges (about 100 bytes each) that every task holds.
EDGES = 300_000
# Search radius in metres, and what full agreement with the heading is worth.
RADIUS, WEIGHT = 150.0, 150.0
#: Degrees of latitude of a band by which edges and sessions meet.
BAND = 0.05
#: Metres a second that no session moves beyond.
FASTEST = 55.0
FIELDS = ["graph_id", "lat0", "lon0", "a", "b", "ax", "ay", "bx", "by"]
EDGE = "struct<graph_id:bigint,lat0:double,lon0:double,a:bigint,b:bigint,ax:double,ay:double,bx:double,by:double>"


class Roads:
    """Edges by graph; ``snap`` answers for many places at once."""

    def __init__(self, columns: dict[str, np.ndarray]) -> None:
        self.graphs = []
        c = {n: np.asarray(columns[n]) for n in FIELDS}
        long = np.hypot(c["bx"] - c["ax"], c["by"] - c["ay"]) >= 1e-6
        for graph in np.unique(c["graph_id"]):  # of equal scores the first graph counts
            own = {n: v[(c["graph_id"] == graph) & long] for n, v in c.items()}
            if not len(own["a"]):
                continue
            cell = self._cell(np.floor(own["ax"] / RADIUS).astype(np.int64), np.floor(own["ay"] / RADIUS).astype(np.int64))
            order = np.lexsort((own["b"], own["a"], cell))
            own = {n: v[order] for n, v in own.items()}
            rank = np.empty(len(order), np.int64)
            rank[np.lexsort((own["b"], own["a"]))] = np.arange(len(order))
            box = [own["ax"].min() - RADIUS, own["ax"].max() + RADIUS, own["ay"].min() - RADIUS, own["ay"].max() + RADIUS]
            self.graphs.append((own["lat0"][0], own["lon0"][0], cell[order], rank, box, *(own[n].astype(float) for n in ("ax", "ay", "bx", "by"))))

    @staticmethod
    def _cell(east: np.ndarray, north: np.ndarray) -> np.ndarray:
        return (east << 32) + north

    def snap(self, lat: np.ndarray, lon: np.ndarray, heading: np.ndarray) -> np.ndarray:
        """Rows of ``a_lat, a_lon, b_lat, b_lon, lateral, align``; NaN where no graph has an
        edge whose start and nearest point lie within ``RADIUS``. The least ``lateral -
        WEIGHT * align`` wins, of equal ones the first graph and the smaller nodes."""
        best, out = np.full(len(lat), np.inf), np.full((len(lat), 6), np.nan)
        whole = np.isfinite(lat) & np.isfinite(lon) & np.isfinite(heading)
        for lat0, lon0, cells, rank, box, ax, ay, bx, by in self.graphs:
            wide = EQUATOR * np.cos(np.radians(lat0))
            east, north = np.radians(lon - lon0) * wide, np.radians(lat - lat0) * EQUATOR
            asked = np.flatnonzero(whole & (east >= box[0]) & (east <= box[1]) & (north >= box[2]) & (north <= box[3]))
            if not len(asked):
                continue
            e, n = east[asked], north[asked]
            ce, cn = np.floor(e / RADIUS).astype(np.int64), np.floor(n / RADIUS).astype(np.int64)
            first = np.concatenate([np.searchsorted(cells, self._cell(ce + k, cn - 1)) for k in (-1, 0, 1)])
            size = np.concatenate([np.searchsorted(cells, self._cell(ce + k, cn + 1), "right") for k in (-1, 0, 1)]) - first
            of = np.repeat(np.tile(np.arange(len(asked)), 3), size)
            at = np.arange(len(of)) + np.repeat(first - (np.cumsum(size) - size), size)
            near = np.hypot(ax[at] - e[of], ay[at] - n[of]) <= RADIUS
            of, at = of[near], at[near]
            dx, dy = bx[at] - ax[at], by[at] - ay[at]
            t = np.clip(((e[of] - ax[at]) * dx + (n[of] - ay[at]) * dy) / (dx * dx + dy * dy), 0, 1)
            off = np.hypot(e[of] - ax[at] - t * dx, n[of] - ay[at] - t * dy)
            turn = np.radians(heading[asked][of])
            align = (dx * np.sin(turn) + dy * np.cos(turn)) / np.hypot(dx, dy)
            score = np.where(off <= RADIUS, off - WEIGHT * align, np.inf)
            order = np.lexsort((rank[at], score, of))
            top = order[np.unique(of[order], return_index=True)[1]]
            top = top[score[top] < best[asked[of[top]]]]
            who, edge = asked[of[top]], at[top]
            best[who] = score[top]
            degrees = lambda x, y: (np.degrees(y / EQUATOR) + lat0, np.degrees(x / wide) + lon0)  # noqa: B023,E731
            out[who] = np.stack([*degrees(ax[edge], ay[edge]), *degrees(bx[edge], by[edge]), off[top], align[top]], axis=1)
        return out


def network(origins: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of a catalog of graphs (``origins``: ``graph_id, lat0, lon0``) with both ends."""
    end = lambda s: nodes.select("graph_id", F.col("node_id").alias(s), F.col("east").alias(s + "x"), F.col("north").alias(s + "y"))
    made = edges.select("graph_id", "a", "b").join(end("a"), ["graph_id", "a"]).join(end("b"), ["graph_id", "b"]).join(origins, "graph_id")
    number = {n: F.col(n).cast("long") for n in ("graph_id", "a", "b")}
    return made.withColumns(number).select(*FIELDS)


def packed(roads: DataFrame) -> Roads:
    """The index of a network that is known to be small."""
    table = roads.toArrow()
    return Roads({n: table[n].to_numpy() for n in FIELDS})


def small(roads: DataFrame, most: int = EDGES) -> bool:
    return roads.limit(most + 1).count() <= most


def _lat(place: str) -> Column:
    return F.col("lat0") + F.degrees(F.col(place) / EQUATOR)


def within_reach(roads: DataFrame, places: DataFrame, seconds: DataFrame) -> DataFrame:
    """``session_id`` and ``roads``, the edges that the session can be near to.

    ``places`` (``session_id, lat, lon``) are where it begins and what fixes tell, ``seconds``
    (``session_id, seconds``) how long it moves: from the box of its places it gets no further
    than ``FASTEST`` for that time. Edges and sessions meet by band of latitude, then by
    longitude; what a session holds grows with its own box.
    """
    box = places.groupBy("session_id").agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"))
    reach = F.degrees((F.col("seconds") * FASTEST + 2 * RADIUS) / EQUATOR)
    box = box.join(seconds, "session_id").withColumn("_r", reach)
    wide = F.col("_r") / F.greatest(F.cos(F.radians(F.greatest(F.abs("s"), F.abs("n")) + F.col("_r"))), F.lit(0.01))
    box = box.select("session_id", (F.col("s") - F.col("_r")).alias("s"), (F.col("n") + F.col("_r")).alias("n"), (F.col("w") - wide).alias("w"), (F.col("e") + wide).alias("e"))
    bands = box.withColumn("band", F.explode(F.sequence(F.floor(F.col("s") / BAND), F.floor(F.col("n") / BAND))))
    lon = F.col("lon0") + F.degrees(F.col("ax") / (EQUATOR * F.cos(F.radians("lat0"))))
    placed = roads.select(F.struct(*FIELDS).alias("edge"), _lat("ay").alias("_lat"), lon.alias("_lon")).withColumn("band", F.floor(F.col("_lat") / BAND))
    met = bands.join(placed, "band").where("_lat between s and n and _lon between w and e")
    return met.groupBy("session_id").agg(F.collect_list("edge").cast(f"array<{EDGE}>").alias("roads"))
