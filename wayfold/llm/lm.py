"""Language-model scoring by cross-entropy difference.

Two bigram models with one vocabulary, the words of all documents, count words and pairs:
the background model every document, the target model those that the labels call good. Both
interpolate pairs, words and a uniform share with the same weights. A document's score is
the mean over its tokens of target loss less background loss; the lower, the more it is
like the target. A document is left out of the counts it is scored with.

N-grams are told apart by 64-bit hashes and counted in a table that grows with the input.
Documents stand in chunks; a chunk sends its distinct n-grams to ranges of the hash, and each
range sends the sums back in the order in which they were asked for. A frequent n-gram is
one entry of each chunk. Keys go as differences in sorted order, numbers by planes of bytes,
both compressed. Messages number chunks times ranges, so ``CHUNK`` has to grow with very
large inputs, and with it the memory of a task, about 30 bytes for each character.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.shared import keep, shared_folder, small

WORD = re.compile(r"\w+|[^\w\s]")
#: Shares of the pair and of the word; the rest is uniform.
PAIR, SINGLE = 0.6, 0.3
#: Characters in a chunk, about; least number of chunks and of ranges.
CHUNK, LEAST = 6_000_000, 24
START, HEAD = np.uint64(0x5354415254), np.uint64(0x48454144)
CODEC = "zstd"


class Numbers(dict):
    """A number for each new word."""

    def __missing__(self, word: str) -> int:
        self[word] = found = len(self)
        return found


class Grams:
    """The n-grams of some texts: for each token the number of its word, of its head (the word
    before it, 0 at the start) and of the pair of both; the text it belongs to; and keys and
    sorted order of all distinct words, pairs and heads, in this order."""

    def __init__(self, texts) -> None:
        number, parts, sizes = Numbers(), [], []
        for text in texts:
            words = WORD.findall((text.as_py() or "").lower())
            parts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
            sizes.append(len(words))
        self.word, self.sizes = np.concatenate([np.zeros(0, np.int32), *parts]), np.array(sizes, np.int64)
        self.owner = np.repeat(np.arange(len(sizes), dtype=np.int32), self.sizes)
        self.head = np.concatenate([np.zeros(1, np.int32), self.word + 1])[: len(self.word)]
        self.head[(np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]] = 0
        hashed = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in number), np.uint64, len(number))
        heads = np.concatenate([[START], hashed])
        pairs, self.pair = np.unique(self.head.astype(np.int64) * max(1, len(hashed)) + self.word, return_inverse=True)
        self.pair = self.pair.astype(np.int32)
        first, second = np.divmod(pairs, max(1, len(hashed)))
        # The last bit tells words, of which the vocabulary is made, from the rest.
        self.keys = np.concatenate([hashed | np.uint64(1), _mixed(heads[first], hashed[second]), _mixed(heads, HEAD)])
        self.ends = np.cumsum([len(hashed), len(pairs), len(heads)])
        self.order = np.argsort(self.keys, kind="stable")

    def kinds(self):
        """Numbers and how many different ones there are, of words, pairs and heads."""
        return zip((self.word, self.pair, self.head), np.diff(self.ends, prepend=0).tolist(), strict=True)

    def sums(self, good: np.ndarray) -> np.ndarray:
        """How often each n-gram of ``keys`` occurs in the texts that are ``good``."""
        chosen = good[self.owner]
        return np.concatenate([np.bincount(x[chosen], minlength=many) for x, many in self.kinds()])

    def own(self) -> list[np.ndarray]:
        """How often each token's word, pair and head occur in its own text."""
        found = []
        for x, many in self.kinds():
            _, place, times = np.unique(self.owner.astype(np.int64) * many + x, return_inverse=True, return_counts=True)
            found.append(times[place])
        return found


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x7F4A7C15))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) & ~np.uint64(1)


def _packed(values: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers, by planes of bytes."""
    return pa.compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), codec=CODEC, asbytes=True) if len(values) else b""


def _unpacked(data: bytes, many: int) -> np.ndarray:
    if not many:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(pa.decompress(data, decompressed_size=8 * many, codec=CODEC), np.uint8).reshape(8, many)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _asked(table: pa.Table, ranges: int) -> pa.Table:
    """The distinct n-grams of a chunk, by range, with their counts in both models."""
    grams = Grams(table["text"])
    good = np.array(table["good"].to_pylist(), bool)
    keys, every, ours = grams.keys[grams.order], grams.sums(np.ones(len(good), bool))[grams.order], grams.sums(good)[grams.order]
    bounds = np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)
    at = np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])
    cut = lambda x: pa.array([_packed(x[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
    steps = pa.array([_packed(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
    chunk = pa.array([table["chunk"][0].as_py()] * ranges, pa.int32())
    return pa.table({"chunk": chunk, "range": pa.array(range(ranges), pa.int32()), "many": pa.array(np.diff(at).astype(np.int32)), "keys": steps, "every": cut(every), "good": cut(ours)})


def _answered(table: pa.Table) -> pa.Table:
    """The sums over all chunks of one range, for each chunk in the order it asked."""
    many = table["many"].to_pylist()
    read = lambda name: [_unpacked(x.as_py(), n) for x, n in zip(table[name], many, strict=True)]
    known, place = np.unique(np.concatenate([np.cumsum(k) for k in read("keys")]), return_inverse=True)
    place, words, total = place.astype(np.int32), (known & np.uint64(1)).astype(bool), []
    for name in ("every", "good"):  # doubles hold sums up to 2^53
        total.append(np.bincount(place, np.concatenate(read(name)).astype(np.float64), len(known)).astype(np.int64))
    facts = [int(words.sum()), int(total[0][words].sum()), int(total[1][words].sum())]
    back = lambda sums: pa.array([_packed(sums[p]) for p in np.split(place, np.cumsum(many)[:-1])], pa.binary())
    first = lambda x: pa.array([x, *[0] * (len(many) - 1)], pa.int64())
    return pa.table({"chunk": table["chunk"], "range": table["range"], "many": table["many"], "every": back(total[0]), "good": back(total[1]), "words": first(facts[0]), "n_every": first(facts[1]), "n_good": first(facts[2])})


def _scored(table: pa.Table, sums: pa.Table, words: int, n_every: int, n_good: int) -> pa.Table:
    """Losses of the texts of a chunk, each without its own counts."""
    grams, good = Grams(table["text"]), np.array(table["good"].to_pylist(), bool)
    losses = np.zeros((2, len(good)))
    if len(grams.word):
        sums, own = sums.sort_by("range"), grams.own()
        many = sums["many"].to_pylist()
        for k, (name, n) in enumerate((("every", n_every), ("good", n_good))):
            mine = np.ones(len(good), np.int64) if k == 0 else good.astype(np.int64)
            total = np.empty(len(grams.keys), np.int64)
            total[grams.order] = np.concatenate([_unpacked(x.as_py(), m) for x, m in zip(sums[name], many, strict=True)])
            left = [t[x] - o * mine[grams.owner] for (x, _), t, o in zip(grams.kinds(), np.split(total, grams.ends[:-1]), own, strict=True)]
            rest = (n - grams.sizes * mine)[grams.owner]
            p = PAIR * left[1] / np.maximum(left[2], 1) + SINGLE * left[0] / np.maximum(rest, 1) + (1 - PAIR - SINGLE) / max(1, words)
            losses[k] = np.bincount(grams.owner, -np.log(p), len(good)) / np.maximum(grams.sizes, 1)
    background, target = losses
    return pa.table({"doc_id": table["doc_id"], "n_tokens": pa.array(grams.sizes), "loss_target": target, "loss_background": background, "score": target - background})


def score(docs: DataFrame, target: Column) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``loss_target``, ``loss_background`` and ``score`` (their
    difference, the mean over tokens) of every row's whole ``text``.

    ``target`` says which rows the target model counts (null: not). A text without tokens
    has losses and score 0. Repeated rows are counted and returned each; an empty table
    gives an empty result.
    """
    folder = shared_folder(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(target, F.lit(False)).alias("good"))
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    chunks = max(LEAST, math.ceil(size / CHUNK)) if size > 1_000_000 else 2
    ranges = min(chunks, max(LEAST, chunks // 2))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))
    asked = rows.groupBy("chunk").applyInArrow(lambda t: _asked(t, ranges), "chunk int, range int, many int, keys binary, every binary, good binary")
    answered = asked.groupBy("range").applyInArrow(_answered, "chunk int, range int, many int, every binary, good binary, words long, n_every long, n_good long")
    answered = keep(answered, folder, "sums")
    words, n_every, n_good = (x or 0 for x in answered.agg(F.sum("words"), F.sum("n_every"), F.sum("n_good")).first())
    sums = answered.select("chunk", "range", "many", "every", "good")
    made = rows.groupBy("chunk").cogroup(sums.groupBy("chunk"))
    return made.applyInArrow(lambda t, s: _scored(t, s, words, n_every, n_good), "doc_id long, n_tokens long, loss_target double, loss_background double, score double")


def op8_lm(spark, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every document; target: documents of quality 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    good = labels.select(F.col("doc_id").alias("_good")).distinct()
    return score(docs.join(small(good), F.col("doc_id") == F.col("_good"), "left"), F.col("_good").isNotNull())
