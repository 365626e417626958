"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.shared import keep


def components(links: DataFrame, folder: str, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id for every id in ``links`` (``a``, ``b`` long).

    Each round replaces the links of a node by links to its smallest neighbour, first over
    its larger neighbours, then over its smaller ones. Minima are aggregated before the
    shuffle, so a node with very many links costs no more than its link rows. Every round
    is written to ``folder``. Null ids and self links are ignored; an empty table gives an
    empty result. Returns ``id``, ``component`` for ids that are not their own smallest.
    """
    edges = keep(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        folder, "links-0",
    )
    state = None
    if edges.isEmpty():
        return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    for step in range(1, max_rounds + 1):
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = keep(large.distinct(), folder, f"large-{step}")
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = keep(small.union(root).distinct(), folder, f"links-{step}")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        state = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
