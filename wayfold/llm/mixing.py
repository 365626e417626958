"""Mixing sources to target weights by entropy balancing.

Every document has two copy slots. Among all rates the mix takes those closest, in entropy,
to one copy of each document, subject to a token constraint for each source. Their form is
an exponential tilt by document size, ``rate = 2 / (1 + exp(-lambda * size))``, with one
multiplier a source: the maximiser of a convex dual, found by Newton iterations that are
Spark aggregations. Rates depend on source and size alone, so the iterations run over
counts of documents by source and size, and rounding works on the same counts.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.shared import keep, shared_folder

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
COPIES = 2
WORD = r"[^\x20\x09-\x0D]+"
#: Documents for each salt: no group of equal size and source stays in one task.
PER_SALT = 10_000
#: Expected copies are summed in whole units of one over this, in any order alike.
UNIT = 1_000_000


def running_total(table: DataFrame, order: list, value: str, total: str, folder: str, name: str) -> DataFrame:
    """``table`` with the sum of ``value`` over all rows before and including each row.

    The rows are range-partitioned once; only one number for each partition is gathered to
    offset the sums within partitions, so no task sees more than its own range.
    """
    table = keep(table.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), folder, name)
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = table.groupBy(part.alias("_part")).agg(F.sum(value).alias("_whole"))
    sums = sums.select("_part", F.coalesce(F.sum("_whole").over(before), F.lit(0)).alias("_earlier"))
    within = F.sum(value).over(Window.partitionBy("_part").orderBy("_at"))
    summed = table.withColumn("_part", part).withColumn("_within", within).join(F.broadcast(sums), "_part")
    return summed.withColumn(total, F.col("_within") + F.col("_earlier")).drop("_part", "_within", "_earlier", "_at", "_whole")


def targets(cells: DataFrame, weights: tuple, share: float, folder: str) -> DataFrame:
    """``key``, ``source_size``, ``docs`` and ``target`` of every source.

    Sources in code point order, null last, take the weights in turn. The level at which
    ``weight * level``, capped at ``COPIES`` times the source's size, fills the whole share
    is raised until no further source reaches its cap.
    """
    sizes = cells.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    sizes = running_total(sizes.withColumn("one", F.lit(1)), [F.col("key") == "", "key"], "one", "number", folder, "sources")
    turn = (F.col("number") - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int"))
    sizes = keep(sizes.select("key", "source_size", "docs", weight.alias("weight")), folder, "weights")
    cap = F.col("source_size") * float(COPIES)
    total, free = sizes.agg(F.sum("source_size"), F.sum("weight")).first()
    level, full = (share * total / free, -1) if total else (0.0, 0)
    while total:
        above = F.col("weight") * level >= cap
        count, capped, free = sizes.agg(F.count_if(above), F.sum(F.when(above, cap).otherwise(0.0)), F.sum(F.when(~above, F.col("weight")).otherwise(0.0))).first()
        if count == full or not free:
            break
        level, full = (share * total - capped) / free, count
    return sizes.select("key", "source_size", "docs", F.least(F.col("weight") * level, cap).alias("target"))


def multipliers(cells: DataFrame, wanted: DataFrame, folder: str, rounds: int = 60, within: float = 1e-7) -> DataFrame:
    """The dual's maximiser: ``key`` and ``tilt``, of sizes in units of the source's mean.

    Safeguarded Newton: a step that leaves the bracket of the root is replaced by its
    middle. A source at its cap takes every slot (infinite tilt).
    """
    mean = F.col("source_size") / F.col("docs")
    state = wanted.withColumn("mean", mean).withColumn("tilt", F.when(F.col("target") >= COPIES * F.col("source_size"), F.lit(math.inf)).otherwise(0.0))
    state = keep(state.withColumn("low", F.lit(-math.inf)).withColumn("high", F.lit(math.inf)), folder, "tilt-0")
    for step in range(1, rounds + 1):
        z = F.col("size") / F.col("mean")
        rate = 1 / (1 + F.exp(-F.col("tilt") * z))
        words = F.col("n") * F.col("size") * COPIES
        sums = cells.where("size > 0").join(state.where(~F.col("tilt").isin(math.inf)).select("key", "mean", "tilt"), "key")
        sums = sums.groupBy("key").agg(F.sum(words * rate).alias("got"), F.sum(words * rate * (1 - rate) * z).alias("slope"))
        over = F.col("got") - F.col("target")
        next_ = F.col("tilt") - F.greatest(F.lit(-4.0), F.least(F.lit(4.0), F.try_divide(over, F.col("slope"))))
        low = F.when(over < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(over >= 0, F.col("tilt")).otherwise(F.col("high"))
        state = state.join(sums, "key", "left").withColumn("low", low).withColumn("high", high).withColumn("next", next_)
        inside = (F.col("next") > F.col("low")) & (F.col("next") < F.col("high"))
        done = F.col("got").isNull() | (F.abs(over) <= within * F.col("target"))
        moved = F.when(done, F.col("tilt")).when(inside, F.col("next")).otherwise((F.col("low") + F.col("high")) / 2)
        state = state.select("key", "source_size", "docs", "target", "mean", moved.alias("tilt"), "low", "high", (~done).alias("open"))
        state = keep(state, folder, f"tilt-{step}")
        if not state.where("open").limit(1).count():
            break
        state = state.drop("open")
    # Sums of doubles differ in their last digits by the order of their rows; tilts do not.
    return state.select("key", "source_size", "target", "mean", F.round("tilt", 9).alias("tilt"))


def rounded(groups: DataFrame, tilts: DataFrame, folder: str) -> DataFrame:
    """Whole copies for every group of documents of equal source and size.

    Expected copies are summed in order of size and each group takes what the rounded sum
    gains, which leaves a source within about one document of its target. Then, twice, one
    document of the size nearest to what is missing is taken once more or once less.
    """
    rate = F.when(F.col("tilt") == math.inf, 1.0).otherwise(1 / (1 + F.exp(-F.col("tilt") * F.coalesce(F.try_divide("size", "mean"), F.lit(0.0)))))
    expected = groups.join(tilts, "key").withColumn("expected", F.round(COPIES * rate * F.col("n") * UNIT).cast("long"))
    summed = running_total(expected, ["key", "size", "salt"], "expected", "sum", folder, "expected")
    gained = F.expr(f"(`sum` + {UNIT // 2}) div {UNIT} - (`sum` - expected + {UNIT // 2}) div {UNIT}")
    table = summed.withColumn("copies", F.greatest(F.lit(0), F.least(gained, COPIES * F.col("n"))))
    table = keep(table.select("key", "size", "salt", "n", "source_size", "target", "copies"), folder, "copies-0")
    for step in (1, 2):
        short = table.groupBy("key").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("short"))
        near = F.abs(F.col("size") - F.abs("short"))
        room = F.when(F.col("short") > 0, F.col("copies") < COPIES * F.col("n")).otherwise(F.col("copies") > 0)
        fix = table.join(short, "key").where(room & (near < F.abs("short")))
        fix = fix.groupBy("key").agg(F.min(F.struct(near.alias("off"), "size", "salt", F.signum("short").cast("long").alias("more"))).alias("f"))
        fix = fix.select("key", "f.size", "f.salt", "f.more")
        table = table.join(fix, ["key", "size", "salt"], "left").withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0))).drop("more")
        table = keep(table, folder, f"copies-{step}")
    return table


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, carry: list | None = None) -> DataFrame:
    """Copies of every document such that sources come near their target words.

    Returns each row of ``docs`` (its columns ``carry``; all by default) as the struct
    ``doc``, so that no column name can clash, with
    ``size`` (words), ``source_size``, ``target`` (of its source), ``copies`` (0 to 2) and
    ``taken`` (copies times size). A null text has size 0; a null source is a source of its
    own; a source without words has target 0. Documents of equal source and size are
    ranked by doc_id (nulls first) for the copies of their group, so reruns agree; repeated
    rows are ranked each. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("s"), "source"))
    doc = F.struct(*carry) if carry else F.struct("*")
    sized = docs.select(doc.alias("doc"), size.alias("size"), key.alias("key"), F.xxhash64("doc_id").alias("hash"))
    # All counting reads a narrow table; ``docs`` itself is read once for it and once for the result.
    narrow = keep(sized.select("key", "size", "hash"), folder, "sized")
    salts = max(1, math.ceil(narrow.count() / PER_SALT))
    sized, narrow = (x.withColumn("salt", F.pmod("hash", F.lit(salts))) for x in (sized, narrow))
    groups = keep(narrow.groupBy("key", "size", "salt").agg(F.count("*").alias("n")), folder, "groups")
    cells = keep(groups.groupBy("key", "size").agg(F.sum("n").alias("n")), folder, "cells")
    wanted = targets(cells, weights, share, folder)
    copies = rounded(groups, multipliers(cells, wanted, folder), folder)
    place = F.row_number().over(Window.partitionBy("key", "size", "salt").orderBy("hash", "doc.doc_id"))
    placed = sized.join(copies, ["key", "size", "salt"]).withColumn("place", place)
    own = F.floor(F.col("place") * F.col("copies") / F.col("n")) - F.floor((F.col("place") - 1) * F.col("copies") / F.col("n"))
    placed = placed.withColumn("copies", own)
    return placed.select("doc", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document (weights 3, 1, 2; 150% of all words)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs, carry=["doc_id", "source"]).select("doc.doc_id", "size", "source_size", "target", "taken", "copies", F.col("doc.source"))
