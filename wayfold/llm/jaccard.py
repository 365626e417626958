"""Near duplicates by the exact likeness (Jaccard) of shingle sets.

Two sets of likeness t or more share one of their first ``n - ceil(t * n) + 1`` shingles in
any common order (prefix filter), so an equality join on those finds every pair; sizes and
positions sort out most others, and the whole sets of the rest are compared. The order puts
shingles that many documents have last. It decides how many candidates there are, never
which pairs are linked.

Sizes and positions as bounds: two sets of ``size`` n and m are alike if they share
``t / (1 + t) * (n + m)`` shingles or more, half of ``f(n) + f(m)`` with ``f(n) = 2 t / (1 + t) * n``.
From a shared shingle at ``pos`` on, the first one that they share, no more than ``size - pos``
can be shared. So each of two alike sets has an ``f`` within the other's ``slack``, which is
``2 (size - pos) - f``; what no other in a bucket meets leaves it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.graph import components
from wayfold.llm.shared import keep, shared_folder, short_batches, small, swept, tidied

SEED = 42
#: Buckets of more documents than this are thinned out by further centers before they are paired.
BUCKET = 32
#: Rounds of centers.
ROUNDS = 3
#: Most common shingles that the order knows (16 MB); the others stand in order of their hashes.
KNOWN = 1_000_000
#: Most distinct words whose hashes a task keeps.
CACHE = 50_000
#: Bits of a set's bitmap: the parities of how many of its shingles fall on each bit. Two sets
#: differ in at least as many shingles as their bitmaps in bits.
BITS = 1024
#: Rounding of ``similarity`` must not lose a pair at the bound.
EDGE = 1e-9


class Shingles:
    """The set of 64-bit hashes of a text's shingles of ``width`` words, sorted.

    Words are runs of other than ASCII white space, A-Z lower-cased. Fewer words than
    ``width`` are one shingle."""

    def __init__(self, width: int) -> None:
        self.width, self.known = width, {}

    def __call__(self, text: str | bytes | None) -> np.ndarray:
        words, known = (text or b"").lower().split(), self.known
        if len(known) > CACHE:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w, SEED)
        hashed = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(words))
        runs = np.zeros(len(words) - width + 1 if words else 0, np.uint64)
        for i in range(width):
            runs = (runs ^ hashed[i : i + len(runs)]) * np.uint64(0x9E3779B97F4A7C15)
            runs ^= runs >> np.uint64(29)
        runs *= np.uint64(0xBF58476D1CE4E5B9)
        return np.unique(runs ^ (runs >> np.uint64(32)))


def _node(own: np.ndarray) -> int:
    """Signed id of a set; equal sets are one node."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).astype(np.int64))


def _bitmap(own: np.ndarray) -> np.ndarray:
    odd = np.bincount((own & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def _prefix(own: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    known, many = common
    order = own
    if len(known) and len(own):
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        order = own[np.lexsort((own, np.where(known[at] == own, many[at], 0)))]
    return order[: len(own) - math.ceil(similarity * len(own) - EDGE) + 1] if len(own) else own


def prefixes(texts: DataFrame, width: int, similarity: float, common: tuple) -> DataFrame:
    """``doc_id``, ``node``, ``size`` of the set, its bitmap ``bits`` and its ``prefix``, of
    every row."""
    order = texts.sparkSession.sparkContext.broadcast(common)
    names = ["doc_id", "node", "size", "bits", "prefix"]

    def run(batches):
        shingles = Shingles(width)
        for batch in tidied(batches):
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                sets = [shingles(t) for t in part.column(1).cast(pa.binary()).to_pylist()]
                heads = [_prefix(s, order.value, similarity).view(np.int64) for s in sets]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, heads)]), pa.int32()), pa.array(np.concatenate(heads)))
                bits = np.stack([_bitmap(s) for s in sets])
                bits = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * bits.shape[1], pa.int32()), pa.array(bits.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(_node, sets), pa.int64()), pa.array(map(len, sets), pa.int32()), bits, lists], names)

    return texts.mapInArrow(run, "doc_id long, node long, size int, bits array<long>, prefix array<long>")


def _frequent(keys: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of the column ``key`` what occurs more than ``BUCKET`` times, sorted, and how often."""
    many = keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET)
    found = many.orderBy(F.desc("n"), "key").limit(KNOWN).toArrow()
    return _merged(found["key"].to_numpy().view(np.uint64), found["n"].to_numpy())


def _merged(keys: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the highest of their numbers; the ``KNOWN`` highest of all."""
    order = np.lexsort((-many, keys))
    keys, many = keys[order], many[order]
    first = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]
    keys, many = keys[first], many[first]
    if len(keys) > KNOWN:
        top = np.sort(np.argpartition(-many, KNOWN)[:KNOWN])
        keys, many = keys[top], many[top]
    return keys, many


NONE = (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _common(texts: DataFrame, width: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (sorted) that many documents have, and in how many, as the order needs them.

    First the prefixes in order of hashes are counted. Near copies of one text have one such
    order, so their prefixes show the same small part of what they share: of every document
    whose prefix is common for the most part, all shingles are counted too.
    """
    first = _frequent(prefixes(texts, width, similarity, NONE).select(F.explode("prefix").alias("key")))
    if not len(first[0]):
        return first
    known = texts.sparkSession.sparkContext.broadcast(first[0])

    def run(batches):
        shingles = Shingles(width)
        for batch in tidied(batches):
            for at in range(0, batch.num_rows, 64):
                whole = []
                for own in map(shingles, batch.column(1).slice(at, 64).cast(pa.binary()).to_pylist()):
                    head = _prefix(own, NONE, similarity)
                    found = known.value[np.minimum(np.searchsorted(known.value, head), len(known.value) - 1)] == head
                    if 2 * found.sum() >= len(head) > 0:
                        whole.append(own.view(np.int64))
                if whole:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(whole))], ["key"])

    more = _frequent(texts.mapInArrow(run, "key long"))
    return _merged(np.concatenate([first[0], more[0]]), np.concatenate([first[1], more[1]]))


def linked(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, width: int, similarity: float, folder: str) -> DataFrame:
    """Those of ``pairs`` (nodes ``a``, ``b``) whose sets have a likeness of at least
    ``similarity``, as ``a``, ``b`` of the smallest doc_id of either. Pairs whose bitmaps differ
    too much go first; only the texts of documents in other pairs are read into sets. The set of ``a``, which may be the center of many, joins last,
    so it is not copied to other tasks with each pair."""
    ends = lambda s: nodes.select(F.col("node").alias(s), F.col("size").alias(f"{s}_size"), F.col("bits").alias(f"{s}_bits"))
    apart = F.expr("aggregate(zip_with(a_bits, b_bits, (x, y) -> bit_count(x ^ y)), 0, (t, x) -> t + x)")
    most = (1 - similarity) / (1 + similarity) * (F.col("a_size") + F.col("b_size")) + EDGE * (F.col("a_size") + F.col("b_size") + 1)
    pairs = keep(pairs.distinct().join(ends("a"), "a").join(ends("b"), "b").where(apart <= most).select("a", "b"), folder, "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "rep"), "node").select(F.col("rep").alias("_rep")).distinct()
    wanted = keep(wanted, folder, "wanted")

    def run(batches):
        shingles = Shingles(width)
        for batch in tidied(batches):
            for at in range(0, batch.num_rows, 128):
                sets = [shingles(t) for t in batch.column(0).slice(at, 128).cast(pa.binary()).to_pylist()]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(map(_node, sets), pa.int64()), lists], ["node", "own"])

    read = texts.join(small(wanted), F.col("doc_id") == F.col("_rep"), "left_semi").select("text")
    sets = keep(read.mapInArrow(run, "node long, own array<long>"), folder, "sets").join(small(nodes.select("node", "rep").join(wanted, F.col("rep") == F.col("_rep"), "left_semi")), "node")
    side = lambda s: sets.select(F.col("node").alias(s), F.col("own").alias(f"{s}_own"), F.col("rep").alias(f"{s}_rep"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    both = both.select("a_rep", "b_rep", F.size(F.array_intersect("a_own", "b_own")).alias("same"), (F.size("a_own") + F.size("b_own")).alias("all"))
    return keep(both.where(f"same >= {similarity} * (all - same) - {EDGE}").select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b")).distinct(), folder, "linked")


def _possible(a: str, b: str) -> Column:
    """Whether two sets that share a shingle may be alike, by their bounds."""
    return (F.col(f"{a}f") <= F.col(f"{b}slack")) & (F.col(f"{b}f") <= F.col(f"{a}slack"))


def _mixed(index: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows of ``index`` that may have a partner in their bucket which is of another part,
    with the ``part`` of each and the size ``n`` of what is left of the bucket."""
    own = Window.partitionBy("key")
    rows = index.join(parts.select("node", "part"), "node")
    rows = rows.withColumns({"_f": F.min("f").over(own), "_slack": F.max("slack").over(own), "_lo": F.min("part").over(own), "_hi": F.max("part").over(own)})
    rows = rows.where("_lo <> _hi and slack >= _f and f <= _slack").drop("_f", "_slack", "_lo", "_hi")
    return rows.withColumn("n", F.count("*").over(own)).where("n > 1")


def alike(docs: DataFrame, width: int = 5, similarity: float = 0.8, candidates: Callable[[DataFrame, int, str], DataFrame] | None = None) -> DataFrame:
    """Documents to leave out so that one of each near-duplicate group stays: ``doc_id``
    of every document that is not the smallest of its group, and that ``component_id``.

    Two documents are linked if their sets of shingles of ``width`` words have a likeness of
    at least ``similarity``; groups are what links lead to. No pair is missed. The pairs of
    ``candidates`` (of one document a set, the width and a folder makes ``a``, ``b``) are compared
    first; what follows joins the groups that they leave. Members of a bucket are first held against one center, that with the most shingles which many share
    (of near copies the one nearest to their source), which joins large groups by few pairs;
    crowded buckets that are not of one group then get further centers; at last all pairs of
    different groups that share a bucket and may be alike are compared, whatever its size.
    Null ids take no part; texts without words are alike.
    """
    with short_batches(docs.sparkSession):
        return _alike(docs, width, similarity, candidates)


def _alike(docs: DataFrame, width: int, similarity: float, candidates: Callable | None) -> DataFrame:
    folder = shared_folder(docs.sparkSession)
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    marked = keep(prefixes(texts, width, similarity, _common(texts, width, similarity)), folder, "marked")
    reps = small(keep(marked.groupBy("node").agg(F.min("doc_id").alias("doc_id")), folder, "reps"))
    once = marked.join(reps, ["node", "doc_id"], "left_semi")
    nodes = keep(once.select("node", F.col("doc_id").alias("rep"), "size", "bits").dropDuplicates(["node"]), folder, "nodes")
    share = 2 * similarity / (1 + similarity)
    index = once.select("node", "size", F.posexplode("prefix").alias("pos", "key"))
    index = index.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1")
    index = index.withColumn("f", share * F.col("size")).withColumn("slack", 2 * (F.col("size") - F.col("pos")) - F.col("f") + 4 * EDGE * F.col("size"))
    index = keep(index.select("node", "key", "pos", "f", "slack", "n"), folder, "index")
    crowd = index.where(F.col("n") > BUCKET).groupBy("node").agg(F.count("*").alias("crowd"))
    index = keep(index.drop("n").join(small(crowd), "node", "left").withColumn("crowd", F.coalesce("crowd", F.lit(0))), folder, "shared")
    parts, links = nodes.select("node", "rep", F.col("rep").alias("part")), None
    if candidates is not None:
        links = _proven(candidates, texts, nodes, width, similarity, folder)
        parts = keep(_parts(nodes, links, f"{folder}/near-part"), folder, "near-parts")
        swept(docs.sparkSession)
    for turn in range(ROUNDS + 1):
        mixed = keep(_mixed(index, parts), folder, f"mixed-{turn}")
        if turn == ROUNDS or turn and mixed.where(F.col("n") > BUCKET).isEmpty():
            break
        # Others in each bucket and later round, from any group whatever its size.
        rank = [F.xxhash64("part", "key", F.lit(turn)), F.xxhash64("node", "key", F.lit(turn))] if turn else [-F.col("crowd"), F.col("pos"), F.xxhash64("node")]
        by = F.struct(*(c.alias(f"r{k}") for k, c in enumerate(rank)), "node", "part", "f", "slack")
        stars = mixed.where(F.col("n") > BUCKET) if turn else mixed
        stars = stars.withColumn("c", F.min(by).over(Window.partitionBy("key"))).select("*", *(F.col(f"c.{x}").alias(f"c_{x}") for x in ("node", "part", "f", "slack")))
        stars = stars.where(_possible("", "c_") & (F.col("part") != F.col("c_part"))).select(F.col("c_node").alias("a"), F.col("node").alias("b"))
        new = linked(stars, texts, nodes, width, similarity, f"{folder}/star-{turn}")
        links = new if links is None else links.union(new)
        parts = keep(_parts(nodes, links, f"{folder}/part-{turn}"), folder, f"parts-{turn}")
        if new.isEmpty() and turn:
            break
    left, right = (mixed.select("key", *(F.col(x).alias(s + x) for x in ("node", "part", "f", "slack"))) for s in ("a_", "b_"))
    pairs = left.join(right, "key").where((F.col("a_node") < F.col("b_node")) & (F.col("a_part") != F.col("b_part")) & _possible("a_", "b_"))
    last = linked(pairs.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")), texts, nodes, width, similarity, f"{folder}/last")
    whole = _parts(nodes, links.union(last), f"{folder}/whole").select("node", F.col("part").alias("component_id"))
    return keep(marked.select("doc_id", "node").join(whole, "node").where("doc_id <> component_id").select("doc_id", "component_id").distinct(), folder, "alike")


def _proven(candidates: Callable, texts: DataFrame, nodes: DataFrame, width: int, similarity: float, folder: str) -> DataFrame:
    """Links among the pairs of ``candidates``, which see one document of each set."""
    reps = small(nodes.select("node", F.col("rep").alias("doc_id")))
    found = candidates(texts.join(reps, "doc_id", "left_semi"), width, f"{folder}/near")
    side = lambda s: small(nodes.select(F.col("rep").alias(s), F.col("node").alias(f"{s}_node")))
    pairs = found.join(side("a"), "a").join(side("b"), "b").where("a_node <> b_node")
    pairs = pairs.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))
    return linked(pairs, texts, nodes, width, similarity, f"{folder}/proven")


def _parts(nodes: DataFrame, links: DataFrame, folder: str) -> DataFrame:
    """``nodes`` with the smallest doc_id, as ``part``, that ``links`` lead to."""
    found = components(links, folder).withColumnRenamed("id", "rep")
    return nodes.select("node", "rep").join(found, "rep", "left").select("node", "rep", F.coalesce("component", "rep").alias("part"))
