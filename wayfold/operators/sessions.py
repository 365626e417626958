"""What a session is doing at a time: recording, its engine, its destination and its route.

Commands and answers are few; samples are many. Each is settled on its own small table first,
and samples then look up the last state before them (``asof.latest_before``), by spans of
time, so no task holds a session's samples and nothing is paired with everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators import asof, spans


def _sofar(keys: list[str], order: list[str], upto: int = 0):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)


def recording_states(verbs: DataFrame, keys: list[str], time: str, order: str) -> DataFrame:
    """State after each time at which there are commands (column ``verb``): ``recording_no`` (0 while
    nothing is recorded), ``began`` and ``engine_on``.

    START begins a recording unless one is on; STOP and RESET end it, and a later START begins
    the next one. ENGINE_ON counts within a recording only; ENGINE_OFF, STOP and RESET turn the
    engine off. Other verbs and those without a time do nothing. Of one time all verbs are taken
    in ``order`` and the state after the last holds.
    """
    rows = verbs.where(F.col(time).isNotNull())
    place = [time, order]
    on = F.when(F.col("verb") == "START", 1).when(F.col("verb").isin("STOP", "RESET"), 0)
    rows = rows.withColumn("_on", F.coalesce(F.last(on, ignorenulls=True).over(_sofar(keys, place)), F.lit(0)))
    rows = rows.withColumn("_was", F.coalesce(F.lag("_on").over(Window.partitionBy(*keys).orderBy(*place)), F.lit(0)))
    begins = (F.col("_on") == 1) & (F.col("_was") == 0)
    rows = rows.withColumns({"_no": F.sum(F.when(begins, 1).otherwise(0)).over(_sofar(keys, place)), "_began": F.last(F.when(begins, F.col(time)), ignorenulls=True).over(_sofar(keys, place))})
    engine = F.when((F.col("verb") == "ENGINE_ON") & (F.col("_on") == 1), True).when(F.col("verb").isin("ENGINE_OFF", "STOP", "RESET"), False)
    rows = rows.withColumn("_engine", F.coalesce(F.last(engine, ignorenulls=True).over(_sofar(keys, place)), F.lit(False)))
    state = F.struct(F.when(F.col("_on") == 1, F.col("_no")).otherwise(0).cast("long").alias("recording_no"), F.col("_began").alias("began"), (F.col("_engine") & (F.col("_on") == 1)).alias("engine_on"))
    return rows.groupBy(*keys, time).agg(F.max_by(state, order).alias("s")).select(*keys, time, "s.*")


def recorded(samples: DataFrame, verbs: DataFrame, keys: list[str], time: str, order: str, span: int) -> DataFrame:
    """``samples`` that fall into a recording, with ``recording_no``, ``sample_no`` (1 for the first
    of the recording), ``since_ms`` and ``engine_on``. A command holds for samples of its own
    time. ``span`` is the time by which sessions are cut."""
    states = recording_states(verbs, keys, time, order)
    made = asof.latest_before(samples, states, keys, time, ["recording_no", "began", "engine_on"], span).where("m_recording_no > 0")
    made = made.withColumn("since_ms", F.col(time) - F.col("m_began")).drop(f"m_{time}", "m_began")
    made = made.withColumnsRenamed({"m_recording_no": "recording_no", "m_engine_on": "engine_on"})
    return spans.numbered(spans.cut(made, time, span), [*keys, "recording_no"], [time, order], "sample_no").drop("_span")


def chosen_answers(answers: DataFrame, keys: list[str], time: str) -> DataFrame:
    """One answer for each ``request_id``: the ``online`` one if there is one, else the other;
    it counts from its own ``time``."""
    rank = F.when(F.col("source") == "online", 0).otherwise(1)
    rest = [c for c in answers.columns if c not in [*keys, "request_id"]]
    return answers.groupBy(*keys, "request_id").agg(F.min_by(F.struct(*rest), F.struct(rank, time, "source")).alias("a")).select(*keys, "request_id", "a.*")


def route_timeline(destinations: DataFrame, answers: DataFrame, keys: list[str], time: str, span: int) -> DataFrame:
    """From when on a session follows which route: ``time``, ``source``, ``request_id``, ``dest``.

    A destination (``dest``) sets a straight preview; a null one clears the route. Of the answers
    (``request_id, dest, source, n_points``) to a request the online one counts. It replaces the
    route if it has two points or more and the destination is still the one that it was asked for;
    of one time destinations come first, and of several answers the largest request counts.
    """
    once = destinations.groupBy(*keys, time).agg(F.max_by(F.struct("dest"), "order").alias("d")).select(*keys, time, "d.dest")
    set_ = once.withColumns({"source": F.when(F.col("dest").isNotNull(), "preview"), "request_id": F.lit(None).cast("long")})
    usable = chosen_answers(answers, keys, time).where("n_points >= 2 and dest is not null")
    told = asof.latest_before(usable.select(*keys, time, "request_id", "source", "dest"), once.withColumnRenamed("dest", "now"), keys, time, ["now"], span)
    told = told.where("m_now = dest").select(*keys, time, "dest", "source", "request_id")
    both = set_.unionByName(told)
    last = F.max_by(F.struct("dest", "source", "request_id"), F.coalesce("request_id", F.lit(-(1 << 62))))
    return both.groupBy(*keys, time).agg(last.alias("r")).select(*keys, time, "r.*")


def followed(samples: DataFrame, timeline: DataFrame, keys: list[str], time: str, span: int) -> DataFrame:
    """``samples`` with the route that they follow: ``dest``, ``source``, ``request_id``, null
    without one."""
    made = asof.latest_before(samples, timeline, keys, time, ["dest", "source", "request_id"], span)
    return made.drop(f"m_{time}").withColumnsRenamed({f"m_{c}": c for c in ("dest", "source", "request_id")})
