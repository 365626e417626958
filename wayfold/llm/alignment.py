"""Alignment of two tokenizers by the bytes that their tokens own.

Each tokenizer cuts the same bytes. Repeating each token's index over its bytes gives an
array of owners a side: consecutive distinct pairs of owners are the overlaps, and where
both owners change at once lies a cut. Between cuts lie groups; within a group every token
of one side is linked to every one of the other. How many documents link a pair of ids is
counted over the corpus, and each document sums what its links have.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.shared import keep, shared_folder, short_batches

A_NAME, B_NAME = "byte_bpe_50k", "piece_bpe_32k"
#: A pair of ids in 31 bits: A has fewer than 2^16 ids, B fewer than 2^15.
B_BITS = 15
#: Longer runs without a break go to the library whose cost does not grow with the square.
LONG_RUN = 2000
#: Characters and texts that a task aligns at once; bounds its memory.
SLICE_CHARS, SLICE_TEXTS = 500_000, 256
#: Groups with more links than this are counted by distinct ids instead of link by link.
WIDE = 256
#: Most pairs whose counts every task holds (12 MB); the counts of the others are joined.
HEAD = 1_000_000


class Tokens:
    """The bytes of each id of a vocabulary, laid end to end."""

    def __init__(self, vocabulary: list[bytes]) -> None:
        self.size = np.array([len(x) for x in vocabulary], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(vocabulary), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ``ids`` in order."""
        return _gathered(self.bytes, self.start[ids], self.size[ids])


def _gathered(source: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return source[np.arange(total) + np.repeat(start - ends + size, size)]


@cache
def byte_level(name: str) -> tuple[object, Tokens]:
    """Encoder (text to ids, strings of special tokens are plain text) and token bytes of a
    byte-level BPE. ``<name>.tiktoken`` lists the vocabulary of ``<name>.json``; the library
    that reads it gives the same ids in a quarter of the time, but for very long runs."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    whole.encode_special_tokens = True
    space = re.compile(rf"\s{{{LONG_RUN}}}")

    def encode(text: str) -> np.ndarray:
        if len(text) > LONG_RUN and (max(map(len, text.split()), default=0) >= LONG_RUN or space.search(text)):
            return np.array(whole.encode(text, add_special_tokens=False).ids, np.int64)
        return fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype(np.int64)

    return encode, Tokens([token for token, _ in sorted(ranks.items(), key=lambda x: x[1])])


@cache
def pieces(name: str) -> tuple[object, Tokens]:
    """Encoder (texts to lists of ids) and token bytes of a model of pieces: U+2581 is a
    space, ``<0xHH>`` a byte."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(f"{name}.model"))
    own = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    told = [bytes([int(x[3:5], 16)]) if model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(own)]
    return (lambda texts: model.encode(texts, num_threads=1)), Tokens(told)


class Alignment(NamedTuple):
    """Of texts that stand end to end: the tokens of either side, the group of each, the
    overlaps (pairs of token indices) and the text of each group."""

    a: np.ndarray
    b: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    overlaps: tuple[np.ndarray, np.ndarray]
    group_text: np.ndarray


def align(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray, text_bytes: np.ndarray) -> Alignment:
    """Aligns ids ``a`` and ``b`` that cut the same bytes; ``text_bytes`` are the lengths of
    the texts, at whose ends both sides cut."""
    a_owner, b_owner = np.repeat(np.arange(len(a)), a_size), np.repeat(np.arange(len(b)), b_size)
    a_new, b_new = np.diff(a_owner, prepend=-1) != 0, np.diff(b_owner, prepend=-1) != 0
    first = np.flatnonzero(a_new | b_new)
    cuts = np.flatnonzero(a_new & b_new)
    group = lambda size: np.searchsorted(cuts, np.cumsum(size) - size, "right") - 1
    group_text = np.searchsorted(np.cumsum(text_bytes), cuts, "right")
    return Alignment(a, b, group(a_size), group(b_size), (a_owner[first], b_owner[first]), group_text)


@cache
def _digits() -> Tokens:
    return Tokens([b"%d," % i for i in range(1 << 16)])


def group_lines(found: Alignment, texts: int) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each text: the ids of its groups in order."""
    groups = len(found.group_text)
    in_a, in_b = (np.bincount(g, minlength=groups) for g in (found.a_group, found.b_group))
    upto_a, upto_b = np.cumsum(in_a), np.cumsum(in_b)
    at_a = np.arange(len(found.a)) + (upto_b - in_b)[found.a_group]
    at_b = np.arange(len(found.b)) + upto_a[found.b_group]
    ids = np.empty(len(at_a) + len(at_b), np.int64)
    ids[at_a], ids[at_b] = found.a, found.b
    written, ends = _digits().joined(ids), np.cumsum(_digits().size[ids])
    written[ends[upto_a + upto_b - in_b - 1] - 1] = ord("|")
    written[ends[upto_a + upto_b - 1] - 1] = ord(";")
    last = np.searchsorted(found.group_text, np.arange(texts), "right")
    stops = np.concatenate([[0], ends])[np.concatenate([[0], upto_a + upto_b])[last]]
    whole = written.tobytes()
    return [whole[start : max(start, stop - 1)] for start, stop in zip([0, *stops], stops, strict=False)]


def links(found: Alignment) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linked id pairs of each text (``text << 31 | a << 15 | b``, sorted, once each), how
    many links each stands for, and the links of each group."""
    groups = len(found.group_text)
    in_a, in_b = (np.bincount(g, minlength=groups) for g in (found.a_group, found.b_group))
    from_a, from_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    many = in_a * in_b
    narrow = np.flatnonzero(many <= WIDE)
    each = many[narrow]
    of = np.repeat(narrow, each)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
    a, b = found.a[from_a[of] + nth // in_b[of]], found.b[from_b[of] + nth % in_b[of]]
    keys, counts = [found.group_text[of] << 31 | a << B_BITS | b], [np.ones(len(of), np.int64)]
    for g in np.flatnonzero(many > WIDE):
        own_a, n_a = np.unique(found.a[from_a[g] : from_a[g] + in_a[g]], return_counts=True)
        own_b, n_b = np.unique(found.b[from_b[g] : from_b[g] + in_b[g]], return_counts=True)
        keys.append((found.group_text[g] << 31 | own_a[:, None] << B_BITS | own_b).ravel())
        counts.append((n_a[:, None] * n_b).ravel())
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts, many


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<long>"
SCORED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, best long, total long, pairs array<int>, times array<long>"


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of few texts and characters."""
    start, chars = 0, 0
    for i, text in enumerate(texts):
        if i > start and (i - start >= SLICE_TEXTS or chars + len(text or "") > SLICE_CHARS):
            yield start, i
            start, chars = i, 0
        chars += len(text or "")
    if start < len(texts):
        yield start, len(texts)


def _aligned(texts: list[str | None], a_name: str, b_name: str) -> list[pa.Array]:
    """The columns of ``ALIGNED`` but the first, of some texts."""
    (encode_a, tokens_a), (encode_b, tokens_b) = byte_level(a_name), pieces(b_name)
    at = [i for i, text in enumerate(texts) if text]
    ids_a, ids_b = [encode_a(f" {texts[i]}") for i in at], [np.array(x, np.int64) for x in encode_b([texts[i] for i in at])]
    # Only texts that both sides give back byte by byte have tokens.
    raw = [f" {texts[i]}".encode() for i in at]
    good = [k for k, own in enumerate(raw) if all(len(ids[k]) and tokens.size[ids[k]].min() > 0 and tokens.joined(ids[k]).tobytes() == own for ids, tokens in ((ids_a, tokens_a), (ids_b, tokens_b)))]
    none = np.zeros(0, np.int64)
    a, b = (np.concatenate([none, *(ids[k] for k in good)]) for ids in (ids_a, ids_b))
    found = align(a, tokens_a.size[a], b, tokens_b.size[b], np.array([len(raw[k]) for k in good], np.int64))
    keys, times, many = links(found)
    lines = group_lines(found, len(good))
    row = np.array([at[k] for k in good], np.int64)

    def column(values, kind=pa.int64()):
        whole = np.zeros(len(texts), np.int64)
        whole[row] = values
        return whole if kind is None else pa.array(whole, kind)

    sha = [""] * len(texts)
    for i, line in zip(row, lines, strict=True):
        sha[i] = hashlib.sha256(line).hexdigest()
    sums = lambda weights=None: np.bincount(found.group_text, weights, minlength=len(good)) if len(good) else none
    held = column(np.bincount(keys >> 31, minlength=len(good)) if len(good) else none, None)
    n_links = np.add.reduceat(many, np.searchsorted(found.group_text, np.arange(len(good)))) if len(good) else none
    return [
        column([len(ids_a[k]) for k in good]), column([len(ids_b[k]) for k in good]), column(sums()), column(n_links),
        pa.array(sha, pa.string()), _lists((keys & 0x7FFFFFFF).astype(np.int32), held, pa.int32()), _lists(times, held, pa.int64()),
    ]


def alignments(docs: DataFrame, a_name: str = A_NAME, b_name: str = B_NAME) -> DataFrame:
    """Every row's alignment: numbers of tokens, groups and links, the SHA-256 of its groups
    (``a1,a2|b1;a3|b2,b3``) and its distinct linked pairs of ids (``a << 15 | b``, sorted)
    with how many links each stands for.

    A encodes a space and the text, B the text (it adds the space); the strings of special
    tokens are plain text. Null and empty texts, and texts whose tokens don't join to the
    same bytes on both sides, have no tokens: zeros, empty lists and an empty string.
    Memory grows with the longest text, and with the distinct ids on both sides of one
    group. Other columns are ignored.
    """
    names = [x.split()[0] for x in ALIGNED.split(", ")]

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, stop in _slices(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), *_aligned(texts[start:stop], a_name, b_name)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ALIGNED)


def _head(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most counted pairs, at most ``most``, sorted, and their counts. Which count
    they start from is told by how many pairs lie in each of a few hundred ranges."""
    step = F.floor(8 * F.log2("n"))
    ranges, rows, least = counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect(), 0, None
    for r in ranges:
        rows += r["count"]
        if rows > most:
            break
        least = r["step"]
    found = (counts.where(F.lit(False)) if least is None else counts.where(step >= least)).select("pair", "n").toArrow()
    pair, n = found["pair"].to_numpy().astype(np.int32), found["n"].to_numpy().astype(np.int64)
    order = np.argsort(pair)
    return pair[order], n[order]


def cross_tokenizer(docs: DataFrame, a_name: str = A_NAME, b_name: str = B_NAME, head: int = HEAD) -> DataFrame:
    """:func:`alignments` of every row with ``n_best`` and ``count_sum``.

    A pair's count is the number of rows that link it. ``n_best`` are the links whose count
    is the highest of their A id (ties too), ``count_sum`` adds the counts of all links.
    Counts of the ``head`` most frequent pairs go to every task, those of other pairs are
    joined, where no pair is frequent; the highest count of each A id is bounded by the
    vocabulary. Rows that repeat a doc_id count as rows of their own and are each returned.
    An empty table gives an empty result.
    """
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    with short_batches(spark, 512):
        made = keep(alignments(docs, a_name, b_name).withColumn("row", F.monotonically_increasing_id()), folder, "aligned")
    counts = keep(made.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), folder, "counts")
    owner = F.shiftright("pair", B_BITS)
    highest = keep(counts.groupBy(owner.alias("a")).agg(F.max("n").alias("highest")), folder, "highest")
    by_a = {r["a"]: r["highest"] for r in highest.collect()}  # as many as A has ids at most
    table = np.zeros(1 << 16, np.int64)
    table[list(by_a)] = list(by_a.values())
    known = spark.sparkContext.broadcast((*_head(counts, head), table))
    names = [x.split()[0] for x in SCORED.split(", ")]

    def run(batches):
        pair, n, top = known.value
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                lists, times = part["pairs"], part["times"].flatten().to_numpy()
                own, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
                of = np.repeat(np.arange(len(sizes)), sizes)
                at = np.minimum(np.searchsorted(pair, own), max(0, len(pair) - 1))
                there = pair[at] == own if len(pair) else np.zeros(len(own), bool)
                count = np.where(there, n[at], 0) if len(pair) else np.zeros(len(own), np.int64)
                best, total = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
                np.add.at(best, of, np.where(there & (count == top[own >> B_BITS]), times, 0))
                np.add.at(total, of, count * times)
                left = np.bincount(of[~there], minlength=len(sizes))
                rest = [_lists(own[~there], left, pa.int32()), _lists(times[~there], left, pa.int64())]
                yield pa.RecordBatch.from_arrays([*(part[c] for c in names[:7]), pa.array(best), pa.array(total), *rest], names)

    with short_batches(spark, 512):
        scored = keep(made.mapInArrow(run, SCORED), folder, "scored")
    rest = scored.where("size(pairs) > 0").select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    rest = rest.join(counts, "pair").join(F.broadcast(highest), owner == F.col("a"))
    rest = rest.groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("highest"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_total"))
    whole = scored.drop("pairs", "times").join(rest, "row", "left")
    plus = lambda x, y: F.col(x) + F.coalesce(y, F.lit(0))
    return whole.select(*names[1:7], plus("best", "more_best").alias("n_best"), plus("total", "more_total").alias("count_sum"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of every document between the byte-level BPE and the model of pieces."""
    return cross_tokenizer(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
