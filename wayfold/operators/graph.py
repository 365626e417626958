"""Shortest paths over road graphs."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.operators.lineage import checkpoints
from wayfold.operators.spatial import covering, road_snap

#: A start edge that points further away from the heading than this is not taken.
LEAST_ALIGN = -0.3


def nearest_nodes(points: DataFrame, nodes: DataFrame, within: float = 1000.0) -> DataFrame:
    """``point_id`` with its nearest node of each graph, at most ``within`` away; nodes are
    looked up by grid cell. Points with a ``graph_id`` look at that graph only."""
    cell = lambda c: F.floor(F.col(c) / within)
    near = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    spread = points.withColumn("_n", near).select("point_id", *(["graph_id"] if "graph_id" in points.columns else []), F.col("east").alias("_e"), F.col("north").alias("_m"), (cell("east") + F.col("_n.i")).alias("cx"), (cell("north") + F.col("_n.j")).alias("cy"))
    own = ["graph_id"] if "graph_id" in points.columns else []
    made = spread.join(nodes.withColumns({"cx": cell("east"), "cy": cell("north")}), [*own, "cx", "cy"])
    made = made.withColumn("off", F.hypot(F.col("east") - F.col("_e"), F.col("north") - F.col("_m"))).where(F.col("off") <= within)
    return made.groupBy("point_id", "graph_id").agg(F.min(F.struct("off", "node_id")).alias("n")).select("point_id", "graph_id", "n.node_id", "n.off")


def distances(sources: DataFrame, edges: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Least cost from each source (``graph_id, source``) to every node it reaches (if
    ``max_hops`` is given, by so many edges), with the node before it: ``graph_id, source,
    node, dist, prev``.

    Each round relaxes the edges of nodes that improved in the last; the state is cut from
    its lineage by a reliable checkpoint. Ends early once nothing improves.
    """
    checkpoints(sources.sparkSession)
    state = sources.select("graph_id", "source", F.col("source").alias("node"), F.lit(0.0).alias("dist"), F.lit(None).cast(sources.schema["source"].dataType).alias("prev"), F.lit(0).alias("round"))
    for hop in count(1) if max_hops is None else range(1, max_hops + 1):
        front = state.where(F.col("round") == hop - 1).select("graph_id", "source", F.col("node").alias("a"), "dist")
        reached = front.join(edges, ["graph_id", "a"]).select("graph_id", "source", F.col("b").alias("node"), (F.col("dist") + F.col("cost")).alias("dist"), F.col("a").alias("prev"), F.lit(hop).alias("round"))
        # Of equal distances (to a nanometre) the earlier round stays, then the smaller node.
        best = F.min(F.struct(F.round("dist", 9).alias("near"), "round", "prev", "dist")).alias("s")
        state = state.union(reached).groupBy("graph_id", "source", "node").agg(best).select("graph_id", "source", "node", "s.dist", "s.prev", "s.round").checkpoint()
        if state.where(F.col("round") == hop).isEmpty():
            break
    return state.drop("round")


def aimed(requests: DataFrame, nodes: DataFrame, edges: DataFrame, max_hops: int | None = None, slack: float = 0.2) -> DataFrame:
    """Least costs from the source of each request (``graph_id, source, goal``) as far as its goal
    needs them: ``graph_id, source, goal, node, dist, prev``, with the goal's own row if it is
    reached, and else with all that is.

    A row waits until its cost and the straight line to the goal are within ``slack`` (a share
    of the whole straight line) of the least such sum, and is dropped as soon as that sum
    exceeds the best known cost of the goal; so what is settled grows with the area between
    both ends, not with the graph. No edge may cost less than its straight length. Costs, and
    of equal ones the way with fewer edges and smaller nodes, are those of ``distances``.
    """
    checkpoints(requests.sparkSession)
    keys = ["graph_id", "source", "goal"]
    place = lambda name, *as_: nodes.select("graph_id", F.col("node_id").alias(name), F.col("east").alias(as_[0]), F.col("north").alias(as_[1]))
    roads = edges.select("graph_id", "a", "b", "cost").join(place("b", "be", "bn"), ["graph_id", "b"])
    left = F.coalesce(F.hypot(F.col("be") - F.col("ge"), F.col("bn") - F.col("gn")), F.lit(0.0))
    state = requests.select(*keys).distinct().join(place("source", "be", "bn"), ["graph_id", "source"], "left").join(place("goal", "ge", "gn"), ["graph_id", "goal"], "left")
    state = state.select(*keys, "ge", "gn", F.col("source").alias("node"), F.lit(0.0).alias("dist"), F.lit(None).cast(requests.schema["source"].dataType).alias("prev"), F.lit(0).alias("hops"), left.alias("left"), F.lit(True).alias("open")).withColumn("whole", F.col("left")).checkpoint()
    total = F.col("dist") + F.col("left")
    while True:
        now = state.groupBy(*keys).agg(F.min(F.when(F.col("open"), total)).alias("least"), F.min(F.when(F.col("node") == F.col("goal"), F.col("dist"))).alias("bound"))
        bound = F.coalesce(F.col("bound") * (1 + 1e-12) + 1e-9, F.lit(float("inf")))
        told = state.join(now.where("least is not null"), keys, "left").where(~F.col("open") | (total <= bound))
        due = F.col("open") & (total <= F.col("least") + slack * F.col("whole") + 1e-9)
        due = due if max_hops is None else due & (F.col("hops") < max_hops)
        told = told.withColumn("due", due)
        step = told.where("due").select(*keys, "ge", "gn", "whole", F.col("node").alias("a"), "dist", "hops", bound.alias("bound")).join(roads, ["graph_id", "a"])
        step = step.withColumn("dist", F.col("dist") + F.col("cost")).withColumn("left", left).where(total <= F.col("bound"))
        rest = ["ge", "gn", "whole"]
        reached = step.select(*keys, *rest, F.col("b").alias("node"), "dist", F.col("a").alias("prev"), (F.col("hops") + 1).alias("hops"), "left", F.lit(True).alias("open"))
        waits = F.col("open") & ~F.col("due") & (F.lit(True) if max_hops is None else F.col("hops") < max_hops)
        stays = told.select(*keys, *rest, "node", "dist", "prev", "hops", "left", waits.alias("open"))
        best = F.min(F.struct(F.round("dist", 9).alias("near"), "hops", "prev", "dist", "open", "left", *rest)).alias("s")
        state = stays.unionByName(reached).groupBy(*keys, "node").agg(best).select(*keys, "node", *(f"s.{c}" for c in ("dist", "prev", "hops", "open", "left", *rest))).checkpoint()
        if state.where("open").isEmpty():
            return state.select(*keys, "node", "dist", "prev")


def paths(ends: DataFrame, tree: DataFrame) -> DataFrame:
    """Nodes from source to end of each request (``request_id, graph_id, source, goal, node``), as
    the array ``path``: the nodes before are looked up in ``tree``, one round for each edge of the
    longest path, for all requests at once."""
    checkpoints(ends.sparkSession)
    keys = ["graph_id", "source", "goal"]
    back = tree.select(*keys, F.col("node").alias("_at"), "prev")
    state = ends.select("request_id", *keys, F.col("node").alias("_at"), F.array("node").alias("path"))
    while True:
        state = state.join(back, [*keys, "_at"], "left")
        further = F.when(F.col("prev").isNotNull(), F.concat(F.array("prev"), "path")).otherwise(F.col("path"))
        state = state.select("request_id", *keys, F.col("prev").alias("_at"), further.alias("path")).checkpoint()
        if state.where("_at is not null").isEmpty():
            return state.select("request_id", "path")


def routes(requests: DataFrame, nodes: DataFrame, edges: DataFrame, max_hops: int | None = None, with_path: bool = False) -> DataFrame:
    """Cost of each request (``request_id, graph_id, source, goal``): to the goal, or, if
    it is not reached, to the reached node closest to it (``fallback``); and, if asked for,
    the nodes on the way. Requests with equal ends are searched once."""
    keys = ["graph_id", "source", "goal"]
    found = aimed(requests, nodes, edges, max_hops)
    place = nodes.select("graph_id", F.col("node_id").alias("node"), "east", "north")
    goal = nodes.select("graph_id", F.col("node_id").alias("goal"), F.col("east").alias("ge"), F.col("north").alias("gn"))
    made = found.join(place, ["graph_id", "node"]).join(goal, ["graph_id", "goal"])
    off = F.hypot(F.col("east") - F.col("ge"), F.col("north") - F.col("gn"))
    best = F.min(F.struct((F.col("node") != F.col("goal")).alias("fallback"), F.when(F.col("node") != F.col("goal"), off).otherwise(0.0).alias("left_m"), "node", "dist")).alias("r")
    made = requests.select("request_id", *keys).join(made.groupBy(*keys).agg(best).select(*keys, "r.node", "r.dist", "r.fallback"), keys)
    if not with_path:
        return made.select("request_id", "node", "dist", "fallback")
    return made.select("request_id", "node", "dist", "fallback").join(paths(made, found), "request_id")


def heading_routes(requests: DataFrame, nodes: DataFrame, edges: DataFrame, max_hops: int | None = None, radius: float = 150.0, within: float = 1000.0, with_path: bool = False) -> DataFrame:
    """Route of each request (``point_id, east, north, heading, goal_east, goal_north``) on
    each graph that has a node within ``within`` of both ends.

    It starts where the point meets the best directed edge (``px``, ``py``) and goes on from
    that edge's end, so it never begins by turning back. Without a heading or such an edge,
    or if the edge points against the heading, it starts at the nearest node. The goal is
    the node nearest to the destination; see ``routes`` for goals that are not reached.
    Requests with a ``graph_id`` look at that graph only.
    """
    own = ["graph_id"] if "graph_id" in requests.columns else []
    start = nearest_nodes(requests, nodes, within).select("point_id", "graph_id", F.col("node_id").alias("_start"))
    ends = requests.select("point_id", *own, F.col("goal_east").alias("east"), F.col("goal_north").alias("north"))
    goal = nearest_nodes(ends, nodes, within).select("point_id", "graph_id", F.col("node_id").alias("goal"))
    headed = requests.where("heading is not null and not isnan(heading)").select("point_id", *own, "east", "north", "heading")
    snapped = road_snap(headed, nodes, edges, radius, each_graph=True).where(F.col("align") >= LEAST_ALIGN).select("point_id", "graph_id", F.col("b").alias("_next"), "px", "py")
    asked = start.join(goal, ["point_id", "graph_id"]).join(snapped, ["point_id", "graph_id"], "left")
    asked = asked.withColumn("source", F.coalesce("_next", "_start")).withColumn("request_id", F.struct("point_id", "graph_id"))
    found = routes(asked.select("request_id", "graph_id", "source", "goal"), nodes, edges, max_hops, with_path)
    return asked.join(found, "request_id").select("point_id", "graph_id", "source", "px", "py", "node", "dist", "fallback", *(["path"] if with_path else []))


def route_points(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Points of routes with a ``path``, in order: ``point_id, i, east, north``. Where a route
    begins on an edge, that place is its first point."""
    first = F.when(F.col("px").isNotNull(), 1).otherwise(0)
    steps = found.select("point_id", "graph_id", first.alias("_lead"), F.posexplode("path").alias("_k", "node_id")).join(nodes, ["graph_id", "node_id"])
    steps = steps.select("point_id", (F.col("_k") + F.col("_lead")).cast("int").alias("i"), "east", "north")
    return steps.union(found.where("px is not null").select("point_id", F.lit(0).alias("i"), F.col("px").alias("east"), F.col("py").alias("north")))


def latlon_routes(requests: DataFrame, origins: DataFrame, nodes: DataFrame, edges: DataFrame, radius: float = 150.0) -> DataFrame:
    """Routes of ``point_id, lat, lon, heading, goal_lat, goal_lon`` as points ``i, lat, lon``, the
    asked place first, on the first graph (``graph_id, lat0, lon0``) that covers both ends."""
    from wayfold.functions.geo import EQUATOR, to_enu

    # Graphs that may cover both ends.
    ends = requests.select("point_id", F.col("goal_lat").alias("lat"), F.col("goal_lon").alias("lon"))
    every = covering(requests, origins, nodes).join(covering(ends, origins, nodes).select("point_id", "graph_id"), ["point_id", "graph_id"])
    own = to_enu(F.col("lat"), F.col("lon"), F.col("lat0"), F.col("lon0"), EQUATOR)
    goal = to_enu(F.col("goal_lat"), F.col("goal_lon"), F.col("lat0"), F.col("lon0"), EQUATOR)
    asked = every.select(F.struct("point_id", "graph_id").alias("point_id"), "graph_id", own["east"].alias("east"), own["north"].alias("north"), "heading", goal["east"].alias("goal_east"), goal["north"].alias("goal_north"))
    found = heading_routes(asked, nodes, edges, radius=radius, with_path=True).withColumn("point_id", F.col("point_id.point_id"))
    best = first_graph(found)
    points = route_points(best, nodes).join(best.select("point_id", "graph_id"), "point_id").join(origins, "graph_id")
    lat = F.degrees(F.col("north") / EQUATOR) + F.col("lat0")
    lon = F.degrees(F.col("east") / (EQUATOR * F.cos(F.radians("lat0")))) + F.col("lon0")
    points = points.select("point_id", (F.col("i") + 1).alias("i"), lat.alias("lat"), lon.alias("lon"))
    return points.union(requests.join(best.select("point_id"), "point_id", "left_semi").select("point_id", F.lit(0).alias("i"), "lat", "lon"))


def first_graph(found: DataFrame) -> DataFrame:
    """Of each point's routes the one on the first graph, in order of ``graph_id``."""
    rest = [c for c in found.columns if c != "point_id"]
    return found.groupBy("point_id").agg(F.min_by(F.struct(*rest), "graph_id").alias("r")).select("point_id", "r.*")


def straight_route(e0: Column, n0: Column, e1: Column, n1: Column, gap: float = 10.0, furthest: float = 1_000_000.0) -> Column:
    """Points about every ``gap`` metres of a straight line, 2 to 2000 steps; null beyond
    ``furthest``."""
    length = F.hypot(e1 - e0, n1 - n0)
    steps = F.greatest(F.lit(2), F.least(F.lit(2000), F.floor(length / gap).cast("int")))
    point = lambda i: F.struct((e0 + (e1 - e0) * i / steps).alias("east"), (n0 + (n1 - n0) * i / steps).alias("north"))
    return F.when(length <= furthest, F.transform(F.sequence(F.lit(0), steps), point))
