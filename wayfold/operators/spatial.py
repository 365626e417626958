"""Spatial matching: points to polylines and to road edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.geo import EQUATOR, bearing_from_enu, to_enu
from wayfold.operators import folds

#: Segments of all routes that are broadcast at most; beyond it they are shuffled.
SEGMENTS = 200_000
#: Degrees of the cells by which graphs are looked up.
COVER = 0.02


def segments(points: DataFrame) -> DataFrame:
    """Segments of polylines (``route_id, seg_no, east, north``) with the arc length at
    their start, ``cum_s``."""
    w = Window.partitionBy("route_id").orderBy("seg_no")
    made = points.select("route_id", "seg_no", F.col("east").alias("ax"), F.col("north").alias("ay"), F.lead("east").over(w).alias("bx"), F.lead("north").over(w).alias("by")).where("bx is not null")
    made = made.withColumn("len", F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")))
    before = F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return made.withColumn("cum_s", F.coalesce(before, F.lit(0.0)))


def polyline_match(points: DataFrame, lines: DataFrame) -> DataFrame:
    """Each row of ``points`` (``route_id, east, north``) with the nearest point of its
    route: ``distance_m``, ``bearing`` of the segment, ``route_s``. A segment of no length
    is its start; of segments equally near (to a micrometre) the first counts. Partial minima are made before
    the shuffle; rows that repeat are matched once and returned each."""
    s = lines.withColumn("many", F.count("*").over(Window.partitionBy("route_id"))).select("route_id", *(F.col(c).alias("_" + c) for c in ("seg_no", "ax", "ay", "bx", "by", "len", "cum_s", "many")))
    s = F.broadcast(s) if lines.limit(SEGMENTS + 1).count() <= SEGMENTS else s
    dx, dy = F.col("_bx") - F.col("_ax"), F.col("_by") - F.col("_ay")
    along = F.try_divide((F.col("east") - F.col("_ax")) * dx + (F.col("north") - F.col("_ay")) * dy, dx * dx + dy * dy)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(along, F.lit(0.0))))
    made = points.join(s, "route_id").withColumn("_t", t)
    off = F.hypot(F.col("east") - F.col("_ax") - F.col("_t") * dx, F.col("north") - F.col("_ay") - F.col("_t") * dy)
    best = F.min(F.struct(F.round(off, 6).alias("distance_m"), F.col("_seg_no").alias("seg_no"), bearing_from_enu(dx, dy).alias("bearing"), (F.col("_cum_s") + F.col("_t") * F.col("_len")).alias("route_s")))
    found = made.groupBy(*points.columns).agg(best.alias("m"), (F.count("*") / F.max("_many")).cast("int").alias("_copies"))
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*points.columns, "m.*")


def covering(points: DataFrame, origins: DataFrame, nodes: DataFrame, within: float = 1000.0) -> DataFrame:
    """``points`` (``point_id, lat, lon`` and more) with every graph (``graph_id, lat0, lon0``)
    that may have a node within ``within`` metres, ``graph_id``, ``lat0``, ``lon0``.

    Each node claims the degree cells that its surroundings touch; a point looks up its own
    cell, so points never meet all graphs. Points with unknown places are left out."""
    lat = F.col("lat0") + F.degrees(F.col("north") / EQUATOR)
    lon = F.col("lon0") + F.degrees(F.col("east") / (EQUATOR * F.cos(F.radians("lat0"))))
    high = F.degrees(F.lit(within / EQUATOR))
    wide = high / F.greatest(F.cos(F.radians(F.abs("_lat") + high)), F.lit(0.01))
    placed = nodes.join(origins, "graph_id").select("graph_id", "lat0", "lon0", lat.alias("_lat"), lon.alias("_lon"))
    steps = lambda c, r: F.explode(F.sequence(F.floor((F.col(c) - r) / COVER), F.floor((F.col(c) + r) / COVER)))
    cells = placed.withColumn("_cy", steps("_lat", high)).withColumn("_cx", steps("_lon", wide)).select("graph_id", "lat0", "lon0", "_cx", "_cy").distinct()
    own = lambda c: F.floor(F.col(c) / COVER)
    known = points.where("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")
    return known.withColumns({"_cx": own("lon"), "_cy": own("lat")}).join(cells, ["_cx", "_cy"]).drop("_cx", "_cy")


def catalog_snap(points: DataFrame, origins: DataFrame, nodes: DataFrame, edges: DataFrame, radius: float = 150.0, weight: float = 150.0) -> DataFrame:
    """Points (``point_id, lat, lon, heading``) on the best directed edge of a whole catalog of
    graphs, each in its own local metres; see ``road_snap``. Of equal scores the first graph
    counts. Returns ``graph_id, score, a, b, off, align`` and the place ``lat``, ``lon`` on it;
    points that no graph covers are left out."""
    near = covering(points, origins, nodes, radius)
    enu = to_enu(F.col("lat"), F.col("lon"), F.col("lat0"), F.col("lon0"), EQUATOR)
    local = near.select("point_id", "graph_id", enu["east"].alias("east"), enu["north"].alias("north"), "heading")
    found = road_snap(local, nodes, edges, radius, each_graph=True, weight=weight).join(origins, "graph_id")
    lat = F.col("lat0") + F.degrees(F.col("py") / EQUATOR)
    lon = F.col("lon0") + F.degrees(F.col("px") / (EQUATOR * F.cos(F.radians("lat0"))))
    best = F.min(F.struct("score", "graph_id", "a", "b", "off", "align", lat.alias("lat"), lon.alias("lon")))
    return found.groupBy("point_id").agg(best.alias("s")).select("point_id", "s.*")


def road_snap(points: DataFrame, nodes: DataFrame, edges: DataFrame, radius: float = 150.0, each_graph: bool = False, weight: float = 150.0) -> DataFrame:
    """Points (``point_id, east, north, heading``) on the directed edge with the least
    score: distance less ``weight`` times how the edge's direction agrees with the heading.

    An edge counts if its start node and its nearest point are within the radius; start
    nodes are looked up by grid cell, so no pair beyond neighbouring cells is made. Equal
    scores go to the smaller (a, b). Points without an edge are left out. The best edge is
    that of all graphs, or with ``each_graph`` that of each; points with a ``graph_id`` look
    at that graph only.
    """
    ends = lambda s: nodes.select("graph_id", F.col("node_id").alias(s), F.col("east").alias(s + "x"), F.col("north").alias(s + "y"))
    roads = edges.join(ends("a"), ["graph_id", "a"]).join(ends("b"), ["graph_id", "b"])
    cell = lambda c: F.floor(F.col(c) / radius)
    roads = roads.withColumns({"cx": cell("ax"), "cy": cell("ay")})
    near = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    spread = points.withColumn("_n", near).withColumns({"cx": cell("east") + F.col("_n.i"), "cy": cell("north") + F.col("_n.j")}).drop("_n")
    keys = ["graph_id", "cx", "cy"] if "graph_id" in points.columns else ["cx", "cy"]
    made = spread.join(roads, keys).where(F.hypot(F.col("ax") - F.col("east"), F.col("ay") - F.col("north")) <= radius)
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    along = F.try_divide((F.col("east") - F.col("ax")) * dx + (F.col("north") - F.col("ay")) * dy, dx * dx + dy * dy)
    made = made.where(F.hypot(dx, dy) > 1e-6).withColumn("_t", F.greatest(F.lit(0.0), F.least(F.lit(1.0), along)))
    made = made.withColumns({"px": F.col("ax") + F.col("_t") * dx, "py": F.col("ay") + F.col("_t") * dy})
    off = F.hypot(F.col("east") - F.col("px"), F.col("north") - F.col("py"))
    align = (dx * F.sin(F.radians("heading")) + dy * F.cos(F.radians("heading"))) / F.hypot(dx, dy)
    made = made.withColumns({"off": off, "align": align}).where(F.col("off") <= radius)
    best = F.min(F.struct((F.col("off") - weight * F.col("align")).alias("score"), "a", "b", "px", "py", "off", "align"))
    keys = ["point_id", "graph_id"] if each_graph else ["point_id"]
    return made.groupBy(*keys).agg(best.alias("s")).select(*keys, "s.*")


def _along(edges: DataFrame, every: float) -> DataFrame:
    """``edges`` once for each place at most ``every`` metres apart along them (``_px``, ``_py``)."""
    many = F.greatest(F.lit(1), F.ceil(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) / every)).cast("int")
    made = edges.withColumn("_many", many).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_many"))))
    share = F.col("_k") / F.col("_many")
    return made.withColumns({"_px": F.col("ax") + share * (F.col("bx") - F.col("ax")), "_py": F.col("ay") + share * (F.col("by") - F.col("ay"))}).drop("_many", "_k")


def near_edges(points: DataFrame, edges: DataFrame, keys: list[str], within: float) -> DataFrame:
    """Pairs of ``points`` (``east``, ``north``) and ``edges`` (``ax, ay, bx, by``) of equal
    ``keys`` that may be ``within`` metres of each other, each once: both are looked up by cells
    that edges pass through. Columns of both must have different names, but for the keys."""
    cell = 1.5 * within
    own = lambda c: F.floor(F.col(c) / cell)
    laid = _along(edges, within).withColumns({"_cx": own("_px"), "_cy": own("_py")}).drop("_px", "_py").dropDuplicates([*keys, "_edge", "_cx", "_cy"])
    near = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    spread = points.withColumn("_n", near).withColumns({"_cx": own("east") + F.col("_n.i"), "_cy": own("north") + F.col("_n.j")}).drop("_n")
    return spread.join(laid, [*keys, "_cx", "_cy"]).drop("_cx", "_cy")


def _foot(made: DataFrame) -> DataFrame:
    """The unclamped share ``_raw`` of the foot along an edge, its distance ``_off`` and length."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    made = made.withColumn("_len", F.hypot(dx, dy)).where("_len >= 1e-6")
    made = made.withColumn("_raw", ((F.col("east") - F.col("ax")) * dx + (F.col("north") - F.col("ay")) * dy) / (F.col("_len") * F.col("_len")))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_raw")))
    return made.withColumn("_t", t).withColumn("_off", F.hypot(F.col("east") - F.col("ax") - F.col("_t") * dx, F.col("north") - F.col("ay") - F.col("_t") * dy))


def trail_match(track: DataFrame, keys: list[str], order: str, within: float = 20.0, align: float = 0.5, weight: float = 10.0, most: int = 2000) -> DataFrame:
    """Rows of a track on the earlier part of their own trail that best explains them.

    ``track`` has ``east``, ``north``, ``heading``, a unique ``order`` in each session, ``kept``
    (whether the row's place joined the trail after it was matched) and ``way_e``, ``way_n``
    (direction of the recent motion, null if it is too short). An edge joins neighbouring kept
    places; it counts for later rows if it is one of the last ``most`` places, within ``within``
    metres and along the heading and the recent motion (by the share ``align``, either way). The
    least distance less ``weight`` times that share wins, then the earlier edge. Returns keys,
    order, ``edge_no``, ``off``, ``reversed`` for rows with an edge.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    rows = track.withColumn("_kept", F.coalesce(F.sum(F.when(F.col("kept"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ends = rows.where("kept").select(*keys, (F.col("_kept") + 1).alias("_edge"), F.col("east").alias("bx"), F.col("north").alias("by"))
    own = Window.partitionBy(*keys).orderBy("_edge")
    edges = ends.withColumns({"ax": F.lag("bx").over(own), "ay": F.lag("by").over(own)}).where("ax is not null")  # number of its later place
    made = _foot(near_edges(rows.select(*keys, order, "east", "north", "heading", "way_e", "way_n", "_kept"), edges, keys, within))
    made = made.where(f"_edge <= _kept and _edge > _kept - {most} + 1 and _off <= {within}")
    ux, uy = (F.col("bx") - F.col("ax")) / F.col("_len"), (F.col("by") - F.col("ay")) / F.col("_len")
    made = made.withColumn("_align", ux * F.sin(F.radians("heading")) + uy * F.cos(F.radians("heading")))
    alike = F.coalesce(F.abs(ux * F.col("way_e") + uy * F.col("way_n")) >= align, F.lit(True))
    made = made.where((F.abs("_align") >= align) & alike)
    best = F.min(F.struct(F.round(F.col("_off") - weight * F.abs("_align"), 9).alias("score"), F.col("_edge").alias("edge_no"), F.col("_off").alias("off"), (F.col("_align") < 0).alias("reversed")))
    return made.groupBy(*keys, order).agg(best.alias("b")).select(*keys, order, "b.edge_no", "b.off", "b.reversed")


def route_windowed(points: DataFrame, lines: DataFrame, order: str, gate: float = 25.0, back: float = 5.0, ahead: float = 100.0, outside: float = 0.05) -> DataFrame:
    """``points`` (``route_id``, a unique ``order``, ``east``, ``north``) along their route, each from
    where the last one was matched: ``seg_no``, ``route_s``, ``off``, null where none is.

    A segment (see ``segments``) counts if the point lies beside it (a share ``outside`` beyond its
    ends is allowed) and the arc length there is from ``back`` metres behind the last match to
    ``ahead`` metres before it; the nearest one wins, within ``gate``. Segments are looked up by
    cell; what is folded in order is only each row's few segments.
    """
    edges = lines.select("route_id", F.col("seg_no").alias("_edge"), "ax", "ay", "bx", "by", "cum_s")
    made = _foot(near_edges(points.select("route_id", order, "east", "north"), edges, ["route_id"], gate))
    made = made.where(f"_raw >= -{outside} and _raw <= 1 + {outside} and _off <= {gate}")
    found = made.groupBy("route_id", order).agg(F.array_sort(F.collect_list(F.array(F.round("_off", 9), F.col("_edge").cast("double"), F.col("cum_s") + F.col("_t") * F.col("_len")))).alias("ways"))
    rows = points.select("route_id", order).join(found, ["route_id", order], "left")

    def step(s: dict, r: dict) -> tuple[dict, dict]:
        at = s["at"].copy()
        out = {n: np.full(len(at), np.nan) for n in ("seg_no", "route_s", "off")}
        for k, ways in enumerate(r["ways"]):
            for off, edge, length in ways if ways is not None else ():
                if length + back >= at[k] and length <= at[k] + ahead:
                    at[k], out["off"][k], out["seg_no"][k], out["route_s"][k] = length, off, edge, length
                    break
        return {"at": at}, {"route_id": r["route_id"], order: r[order], **out}

    start = lambda many: {"at": np.zeros(many)}
    kinds = dict(points.dtypes)
    schema = f"route_id {kinds['route_id']}, {order} {kinds[order]}, seg_no double, route_s double, off double"
    made = folds.scan(rows, ["route_id"], [order], schema, start, step)
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    return made.select("route_id", order, known("seg_no").cast("int").alias("seg_no"), known("route_s").alias("route_s"), known("off").alias("off"))
