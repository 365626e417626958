"""SimHash near-duplicate search with deletion-variant signatures.

A 64-bit fingerprint is cut into two segments. Two fingerprints that differ in at most two
bits then have a segment in which they differ in at most one bit, so they share that
segment as it is or with the differing bit taken out. Those variants are the index; an
equality join on them finds every pair, and the join verifies the whole distance.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.graph import components
from wayfold.llm.jaccard import alike
from wayfold.llm.shared import keep, shared_folder, small, tidied

SEED = 42
HALF = 32
#: Buckets of more fingerprints than this are not paired; see ``crowded_links``.
BUCKET = 32
PIECES = 8


def simhash(data: bytes, width: int, seed: int = SEED) -> int:
    """Signed 64-bit SimHash of the word shingles of one UTF-8 text."""
    words = data.lower().split()  # bytes: A-Z only, and split at \x20 and \x09-\x0D
    if not words:
        return 0
    runs = zip(*(words[i:] for i in range(width)), strict=False) if len(words) >= width else [words]
    hashes = np.array([xxhash.xxh64_intdigest(b" ".join(run), seed) for run in runs], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = SEED) -> DataFrame:
    """``doc_id`` and ``fp`` (signed 64 bits) of every row's whole ``text``.

    Words are runs of other than ASCII white space, A-Z lower-cased; shingles of ``width``
    words are hashed by XXH64, repeats included. With fewer words the whole sequence is
    the one shingle; a null or blank text has fingerprint 0.
    """

    def run(batches):
        for batch in tidied(batches):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            fps = pa.array([simhash(t or b"", width, seed) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _variants(fp: Column) -> Column:
    """Index keys: tag * 2^32 + segment, either whole or with one bit taken out.

    Position in the array tells the variant: 33 a segment, the last of them whole."""
    keys = []
    for segment in (0, 1):
        value = F.shiftrightunsigned(fp, HALF * segment).bitwiseAND(F.lit(0xFFFFFFFF))
        for bit in range(HALF + 1):
            tag = F.lit((segment * (HALF + 1) + bit) << HALF)
            left = value if bit == HALF else value.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << bit)))
            keys.append(tag.bitwiseOR(left))
    return F.array(*keys)


def shared_keys(index: DataFrame) -> DataFrame:
    """Rows of ``index`` whose ``key`` others have too, with their number ``n`` and one
    ``center`` of them (the smallest by a hash). One shuffle by the key."""
    own = Window.partitionBy("key")
    center = F.min(F.struct(F.xxhash64("rep"), "rep")).over(own)["rep"]
    return index.withColumn("n", F.count("*").over(own)).withColumn("center", center).where("n > 1")


def bucket_links(shared: DataFrame) -> DataFrame:
    """Linked pairs (``a``, ``b``) within buckets of at most ``BUCKET`` fingerprints.

    A pair with an equal segment meets in all its variants and counts in the whole one; a
    pair that differs by one bit there counts in the variant without that bit.
    """
    small = shared.where(F.col("n") <= BUCKET).withColumn("pos", F.shiftright("key", HALF))
    left = small.select("key", "pos", F.col("fp").alias("fa"), F.col("rep").alias("a"))
    right = small.select("key", F.col("fp").alias("fb"), F.col("rep").alias("b"))
    return left.join(right, "key").where(
        f"""fa < fb and bit_count(fa ^ fb) <= 2 and
        (pos in ({HALF}, {2 * HALF + 1}) or (shiftrightunsigned(fa ^ fb, if(pos > {HALF}, pos - 1, pos)) & 1) = 1)"""
    ).select("a", "b")


def crowded_links(shared: DataFrame) -> DataFrame:
    """Links among fingerprints of the larger buckets, without pairing those buckets.

    A pair with a fingerprint that has no large bucket is found by ``bucket_links``. The
    others meet here by longer keys: of ``PIECES`` equal pieces of a fingerprint, two bits
    touch at most two, so a linked pair agrees in all but some two of them. A bucket then
    holds fingerprints that differ in 16 given bits only.
    """
    crowded = shared.where(F.col("n") > BUCKET).select("fp", "rep").distinct().repartition("fp")
    piece = (1 << (64 // PIECES)) - 1
    masks = [(piece << (64 // PIECES * i)) | (piece << (64 // PIECES * j)) for i, j in combinations(range(PIECES), 2)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    cut = crowded.select("rep", "fp", F.explode(F.lit(masks)).alias("mask")).withColumn("rest", F.expr("fp & ~mask"))
    left = cut.select("mask", "rest", F.col("fp").alias("fa"), F.col("rep").alias("a"))
    right = cut.select("mask", "rest", F.col("fp").alias("fb"), F.col("rep").alias("b"))
    return left.join(right, ["mask", "rest"]).where("fa < fb and bit_count(fa ^ fb) <= 2").select("a", "b")


def _marked(docs: DataFrame, width: int, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fingerprints of ``docs``, the smallest doc_id of each (``fp``, ``rep``), and the linked pairs
    of those (``a``, ``b``)."""
    marked = keep(fingerprints(docs, width), folder, "marked")
    nodes = keep(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), folder, "nodes")
    index = nodes.where("rep is not null").select("fp", "rep", F.explode(_variants(F.col("fp"))).alias("key"))
    shared = keep(shared_keys(index), folder, "shared")
    links = keep(bucket_links(shared).union(crowded_links(shared)), folder, "links")
    return marked, nodes, links


def candidates(docs: DataFrame, width: int, folder: str) -> DataFrame:
    """Pairs of doc_ids (``a``, ``b``) whose texts may be near copies: the smallest ids of
    fingerprints that differ in two bits or fewer, and each other id with the smallest of its own
    fingerprint."""
    marked, nodes, links = _marked(docs, width, folder)
    same = marked.join(small(nodes), "fp").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    return keep(links.union(same).distinct(), folder, "candidates")


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` of every row of ``docs``.

    Fingerprints that differ in two bits or fewer are linked; the component is the
    smallest doc_id that links lead to, itself included. Equal fingerprints are one node
    of the graph, so copies are never paired. A null doc_id counts as no id: such a row
    keeps its fingerprint and gets the smallest id of its group, or null. Repeated rows
    are each returned; other columns are ignored; an empty table gives an empty result.
    """
    folder = shared_folder(docs.sparkSession)
    marked, nodes, links = _marked(docs, width, folder)
    found = components(links, folder)
    whole = nodes.join(found.withColumnRenamed("id", "rep"), "rep", "left")
    whole = whole.select("fp", F.coalesce("component", "rep").alias("component_id"))
    return marked.join(whole, "fp", "left").select("doc_id", "fp", "component_id")


def distinct_documents(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """Rows of ``docs`` without near duplicates: of each group the smallest doc_id stays.

    Rows that repeat a doc_id are one document and one of them stays, that with the smallest
    hash of the whole row. A row without an id stays, once for each text. Texts without
    words are alike. All columns are kept.

    Pairs come from the deletion-variant index of this module first, are held to the exact
    likeness, and their groups are joined. At a likeness of 0.8 fingerprints miss most pairs (see
    the README), so :mod:`wayfold.llm.jaccard` then finds the links that are left between groups.
    """
    gone = alike(docs, width, similarity, candidates)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    row = docs.select(F.col("doc_id").cast("long").alias("_id"), F.struct(*columns).alias("_doc"), F.xxhash64(*columns).alias("_hash"))
    named = row.where("_id is not null").join(gone.select(F.col("doc_id").alias("_id")), "_id", "left_anti")
    again = small(named.groupBy("_id").agg(F.count("*").alias("_n"), F.min("_hash").alias("_least")).where(F.col("_n") > 1))
    kept = named.join(again, "_id", "left").where("_n is null or _hash = _least")
    once, repeated = kept.where("_n is null"), kept.where("_n is not null").dropDuplicates(["_id"])
    nameless = row.where("_id is null").withColumn("_text", F.xxhash64("_doc.text")).dropDuplicates(["_text"])
    return once.select("_doc.*").union(repeated.select("_doc.*")).union(nameless.select("_doc.*"))


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document (three-word shingles, two bits)."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
