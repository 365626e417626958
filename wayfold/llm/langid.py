"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts come from a bounded, documented sample of the labelled rows and are summed by Spark;
the log-probability matrix (buckets by languages) is broadcast, and batches of whole texts
are scored in numpy as sparse rows of n-grams times that matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.shared import keep, shared_folder, small

BUCKETS = 1 << 15
SIZES = (1, 2, 3)
#: Texts of each language that the model is fitted on at most.
SAMPLE = 1500
#: Languages that a model may have; bounds the broadcast (128 MB at the most).
LANGUAGES = 1024
#: Leading bits of a text's hash by which the texts of a language are counted, step by step.
LEAD = (10, 20)
SMOOTH = 0.5
UNKNOWN = "und"
#: Code points of a block, and log-probabilities that a block may gather at once.
_CHUNK, _GATHERED = 1 << 18, 1 << 23


def hashed(codes: np.ndarray, size: int) -> np.ndarray:
    """Bucket of the n-gram of ``size`` code points that begins at each place."""
    many = len(codes) - size + 1
    found = np.full(max(many, 0), size * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
    for k in range(size if many > 0 else 0):
        found = (found ^ codes[k : k + many]) * np.uint32(0x85EBCA6B)
        found ^= found >> np.uint32(15)
    return found & np.uint32(BUCKETS - 1)


def blocks(texts: list[str], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Code points of texts in blocks of about ``most``, with the number of the text that each
    belongs to and how many of them are new: a text longer than a block goes on in the next
    one, which repeats what the n-grams at the border need."""
    lap, codes, owner, new = max(SIZES) - 1, [], [], []
    held = 0
    for k, text in enumerate(texts):
        own = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        for at in range(0, len(own), most):
            part = own[at : at + most + lap]
            codes.append(part)
            owner.append(k)
            new.append(min(most, len(own) - at))
            held += len(part)
            if held >= most:
                yield np.concatenate(codes), np.array(owner), np.stack([np.array([len(c) for c in codes]), np.array(new)])
                codes, owner, new, held = [], [], [], 0
    if codes:
        yield np.concatenate(codes), np.array(owner), np.stack([np.array([len(c) for c in codes]), np.array(new)])


def grams(texts: list[str], most: int = _CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all n-grams of ``texts`` and the text of each, block by block, in order of
    the texts within a block and size."""
    for codes, owner, (held, new) in blocks(texts, most):
        ends = np.cumsum(held)
        text, place = np.repeat(owner, held), np.arange(len(codes)) - np.repeat(ends - held, held)
        limit, fresh = np.repeat(held, held), np.repeat(new, held)
        for size in SIZES:
            found = hashed(codes, size)
            inside = (place[: len(found)] + size <= limit[: len(found)]) & (place[: len(found)] < fresh[: len(found)])
            yield found[inside], text[: len(found)][inside]


def _near(hashes: DataFrame, bits: int) -> DataFrame:
    """Of ``lang``, ``h`` those whose leading ``bits`` bits are among the least with which a
    language has ``SAMPLE`` hashes. Only counts are ordered, one for each value of those bits."""
    lead = F.shiftright("h", 64 - bits)
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("lead"))
    ranges = hashes.groupBy("lang", lead.alias("lead")).agg(F.count("*").alias("n")).withColumn("before", upto - F.col("n"))
    last = ranges.where(F.col("before") < SAMPLE).groupBy("lang").agg(F.max("lead").alias("last"))
    return hashes.join(F.broadcast(last), "lang").where(lead <= F.col("last")).drop("last")


def sampled(rows: DataFrame) -> DataFrame:
    """Of ``lang``, ``text`` at most ``SAMPLE`` different texts of each language, in order of
    their hash: copies count once.

    Only hashes are ranked, and no task ranks a language: counts by leading bits of the hash,
    few at first and then more among those that are left, tell up to which the sample reaches.
    """
    rows, folder = rows.withColumn("h", F.xxhash64("text")), shared_folder(rows.sparkSession)
    near = keep(rows.select("lang", "h").distinct(), folder, "hashes")
    for bits in LEAD:
        near = keep(_near(near, bits), folder, f"near-{bits}")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = near.withColumn("place", place).where(F.col("place") <= SAMPLE).select("lang", "h")
    return rows.join(small(chosen, SAMPLE * LANGUAGES), ["lang", "h"]).dropDuplicates(["lang", "h"]).select("lang", "text")


def fit(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities (buckets by languages) from ``lang``, ``text``.

    The texts of ``sampled`` are counted, whole; the others add to nothing. More languages
    than ``LANGUAGES`` raise an error.
    """
    langs = sorted(row["lang"] for row in rows.select("lang").distinct().limit(LANGUAGES + 1).collect())
    if len(langs) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not langs:
        return [], np.zeros((BUCKETS, 0), dtype=np.float32)
    number = F.create_map(*[x for k, lang in enumerate(langs) for x in (F.lit(lang), F.lit(k))])

    def count(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = sums.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                for part, _ in grams([text.as_py()]):
                    own += np.bincount(part, minlength=BUCKETS)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), lang, dtype=np.int32)), pa.array(at.astype(np.int32)), pa.array(own[at])], ["lang", "bucket", "n"])

    counted = sampled(rows).select(number[F.col("lang")].alias("lang"), "text").mapInArrow(count, "lang int, bucket int, n long")
    summed = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((BUCKETS, len(langs)), SMOOTH)
    table[summed["bucket"].to_numpy(dtype=np.int64), summed["lang"].to_numpy(dtype=np.int64)] += summed["n"].to_numpy(dtype=np.float64)
    return langs, np.log(table / table.sum(axis=0)).astype(np.float32)


def totals(texts: list[str], table: np.ndarray) -> np.ndarray:
    """Log-likelihood of each text under each language: the sparse matrix of the n-grams of a
    block, one row a text, times ``table``. A block gathers ``_GATHERED`` numbers at most."""
    out = np.zeros((len(texts), table.shape[1]))
    for found, text in grams(texts, max(1024, min(_CHUNK, _GATHERED // table.shape[1]))):
        if len(found):
            starts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            out[text[starts]] += np.add.reduceat(table[found], starts, axis=0, dtype=np.float64)
    return out


def score(docs: DataFrame, langs: list[str], logs: np.ndarray) -> DataFrame:
    """``docs`` (``doc_id``, ``held_out``, ``text``) with ``lang_pred`` and ``score``.

    The score is the posterior of the predicted language under equal priors.
    """
    model = docs.sparkSession.sparkContext.broadcast((langs, logs))

    def run(batches):
        names, table = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(2).to_pylist()
                known = [k for k, t in enumerate(texts) if t and names and any(map(str.isalpha, t))]
                found, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if known:
                    total = totals([texts[k] for k in known], table)
                    best = total.argmax(axis=1)
                    scores[known] = 1.0 / np.exp(np.maximum(total - total.max(axis=1, keepdims=True), -700.0)).sum(axis=1)
                    for k, b in zip(known, best.tolist(), strict=True):
                        found[k] = names[b]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def fold(key: str, of: int) -> Column:
    """crc32 of an id as text, modulo ``of``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(of))


def identify(docs: DataFrame, learn: Column) -> DataFrame:
    """Language of every row's whole ``text``, learned from the rows where ``learn`` holds.

    A null text, or one without a letter, is ``und`` with score 0, and so is every row if
    nothing can be learned. Only ``text`` reaches a prediction. Repeated rows are returned
    each, other columns are ignored, an empty table gives an empty result.
    """
    usable = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    langs, logs = fit(usable.select("lang", "text"))
    return score(docs.select(F.col("doc_id").cast("long"), (~learn).alias("held_out"), "text"), langs, logs)


def op10_langid(spark, sf_dir: str) -> DataFrame:
    """Language of every document; those of remainder 1 modulo 3 are held out."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"), fold("doc_id", 3) != 1)
