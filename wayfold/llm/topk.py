"""Exact top-k search by inner product, pruned with multi-resolution segment statistics.

A vector is cut into segments; each is summarised by its mean and standard deviation. For
two vectors the squared distance within a segment of length L is at least L times the sum
of the squared differences of means and of deviations, so the statistics bound the
distance from below, and with both norms the inner product from above. Pairs are held
against a query's bound from few segments to many; only survivors are computed exactly.

Queries and candidates meet in blocks: every block of queries with every block of
candidates, once, in a task of its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.shared import keep, shared_folder

#: Segments of each resolution, coarse to fine.
LEVELS = (4, 16, 32)
#: Rows of a block of queries and of candidates; they bound a task's memory.
QUERIES, CANDIDATES = 4096, 4096
#: One in so many blocks of candidates gives the queries their limits first.
FIRST = 8


def statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations by segment, scaled so that the inner product of two rows is an
    upper bound of the inner product of the vectors (half of norms less distance bound)."""
    length = -(-vectors.shape[1] // segments)
    padded = np.zeros((len(vectors), segments * length))
    padded[:, : vectors.shape[1]] = vectors
    parts = padded.reshape(len(vectors), segments, length)
    return np.concatenate([parts.mean(axis=2), parts.std(axis=2)], axis=1) * np.sqrt(length)


def padded(rows: pd.Series, width: int) -> np.ndarray:
    return np.array([np.pad(np.asarray(v, dtype=np.float64), (0, width - len(v))) for v in rows]).reshape(len(rows), width)


def survivors(query: list[np.ndarray], candidates: list[np.ndarray], least: float) -> np.ndarray:
    """Places of the candidates whose bounds reach ``least`` at every resolution; each later
    one is computed for what the earlier left. Both come as their statistics by level."""
    left = np.arange(len(candidates[0]) if candidates else 0)
    for own, other in zip(query, candidates, strict=True):
        held = other if len(left) == len(other) else other[left]
        left = left[held @ own >= least - 1e-6 * (1 + abs(least))]
    return left


def best(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    """Of one block of each: every query's ``k`` highest candidates that reach its
    ``least`` (null: all), ties to the smaller ``vec_id``."""
    out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
    if len(queries) and len(candidates):
        width = max(max(map(len, queries["v"])), max(map(len, candidates["v"])))
        candidates = candidates.sort_values("vec_id")
        q, c, ids = padded(queries["v"], width), padded(candidates["v"], width), candidates["vec_id"].to_numpy()
        least = queries["least"].to_numpy(dtype=np.float64, na_value=-np.inf) if "least" in queries else np.full(len(q), -np.inf)
        levels = [(statistics(q, s), statistics(c, s)) for s in LEVELS if s <= width]
        for row, query_id in enumerate(queries["query_id"]):
            every = not levels or np.isneginf(least[row])
            left = np.arange(len(c)) if every else survivors([a[row] for a, _ in levels], [b for _, b in levels], least[row])
            scores = (c if every else c[left]) @ q[row]
            own = np.flatnonzero((scores >= least[row]) & (ids[left] != query_id))
            if len(own) > 4 * k:  # what may be among the k highest, ties included
                own = own[scores[own] >= -np.partition(-scores[own], k - 1)[k - 1]]
            own = own[np.argsort(-scores[own], kind="stable")[:k]]
            out["query_id"] += [query_id] * len(own)
            out["vec_id"] += ids[left][own].tolist()
            out["score"] += scores[own].astype(np.int64).tolist()
    return pd.DataFrame({name: np.array(values, dtype=np.int64) for name, values in out.items()})


def integers(vectors: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component, as double; null for a vector that is null or
    has a null or non-finite component."""
    doubles = F.transform(vectors, lambda x: x.cast("double"))
    sound = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(sound, F.transform(doubles, lambda x: F.floor(x * scale).cast("double")))


def _met(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """``best`` of every pair of blocks that share a ``pair``."""
    joined = queries.groupBy("pair").cogroup(candidates.groupBy("pair"))
    return joined.applyInPandas(lambda q, c: best(q, c, k), "query_id long, vec_id long, score long")


def top(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of every query's ``k`` best rows.

    ``vectors`` has ``vec_id`` and ``embedding``. Rows without an id or with a vector that
    is null or holds null or non-finite components take no part; of rows that repeat an id
    one counts (the smallest vector). A shorter vector counts as padded with zeros. Scores
    are exact while they stay below 2^53. Other columns are ignored; an empty table gives
    an empty result. A query's lower limit is its k-th best score in one in ``FIRST`` blocks,
    which a hash has filled; then all blocks give what reaches it, about ``FIRST`` times k
    rows a query.
    """
    folder = shared_folder(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding")).alias("v"), is_query.alias("asks"))
    rows = keep(rows.where("v is not null and vec_id is not null").groupBy("vec_id").agg(F.min("v").alias("v"), F.max("asks").alias("asks")), folder, "rows")
    sizes = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    many, asking = max(1, -(-sizes["n"] // CANDIDATES)), max(1, -(-sizes["q"] // QUERIES))
    block = lambda blocks: F.pmod(F.xxhash64("vec_id", F.lit(blocks)), F.lit(blocks))
    spread = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asked = rows.where("asks").select(F.col("vec_id").alias("query_id"), F.col("v").alias("v"), block(asking).alias("qb"))
    other = rows.select("vec_id", "v", block(many).alias("cb"))
    pair = F.col("qb") * many + F.col("cb")
    order = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
    some = -(-many // FIRST)
    first = _met(asked.withColumn("cb", spread(some)).withColumn("pair", pair), other.where(F.col("cb") < some).withColumn("qb", spread(asking)).withColumn("pair", pair), k)
    least = first.withColumn("rank", order("query_id")).where(F.col("rank") == k)
    asked = keep(asked.join(least.select("query_id", F.col("score").cast("double").alias("least")), "query_id", "left"), folder, "asked")
    found = _met(asked.withColumn("cb", spread(many)).withColumn("pair", pair), other.withColumn("qb", spread(asking)).withColumn("pair", pair), k)
    # Ranked within shares of the blocks, then in all.
    share = found.withColumn("share", F.pmod(F.xxhash64("vec_id"), F.lit(1 + many // 64)))
    share = share.withColumn("rank", order("query_id", "share")).where(F.col("rank") <= k)
    ranked = share.withColumn("rank", order("query_id")).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_topk(spark, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products of every vector whose id is divisible by 20."""
    return top(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, 20)


ORACLE_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS w
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
        list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 20 = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""
