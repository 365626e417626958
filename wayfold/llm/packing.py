"""Hierarchical packing of tokenised documents into sequences of several context sizes.

Whole windows of the longest context are cut off first. What is left of each document goes
to the tier of the shortest context that holds it. Tiers are packed from the longest down:
the longest piece opens a window, and shorter tiers fill its gap, best fit first; the last
gap of a window is closed by cutting one shorter piece. So every window is full, of length
2048, 1024, 512 or 256; what a partition has left at its end becomes windows of smaller
powers of two. Windows are dealt to step groups of equal token counts by their cost.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.shared import keep, shared_folder, short_batches, tidied

TIERS = (2048, 1024, 512, 256)
END = 1
#: Tokens packed together; bounds a task's memory.
BUFFER = 4_000_000
#: Tokens of a step group.
STEP = 64 * TIERS[0]
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, context int, step_id long"
#: Longer runs without a break go to the library whose cost does not grow with the square.
LONG_RUN = 2000


@cache
def encoder(name: str):
    """Function from a text to its ids in tokenizers (``add_special_tokens=False``), for a
    byte-level BPE by its file's name.

    ``<name>.tiktoken`` lists the vocabulary of ``<name>.json`` as ranks, and the library
    that reads it gives the same ids of ordinary text in a quarter of the time. Texts with
    the string of a special token, which tokenizers gives that token's id, and with very
    long runs go to tokenizers itself.
    """
    import public_tokenizers
    import regex
    import tiktoken
    from tokenizers import Tokenizer

    lines = open(public_tokenizers.path(f"{name}.tiktoken"), "rb")
    with lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = cache(lambda: Tokenizer.from_file(public_tokenizers.path(f"{name}.json")))  # few tasks need it
    special = [token.content for token in Tokenizer.from_file(public_tokenizers.path(f"{name}.json")).get_added_tokens_decoder().values()]
    half, run = (regex.compile(rf"\p{{L}}{{{n}}}|\p{{N}}{{{n}}}|[^\s\p{{L}}\p{{N}}]{{{n}}}|\s{{{n}}}") for n in (LONG_RUN // 2, LONG_RUN))

    def long_run(text: str) -> bool:
        # A long run fills the half of one that begins at some multiple of that length; few texts have such a half.
        return any(half.match(text, at) for at in range(0, len(text) - LONG_RUN // 2 + 1, LONG_RUN // 2)) and bool(run.search(text))

    def encode(text: str) -> np.ndarray:
        if any(token in text for token in special) or (len(text) >= LONG_RUN and long_run(text)):
            return np.array(whole().encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype(np.uint32, copy=False)

    return encode


class Windows:
    """Packs pieces (length, document, start) into full windows."""

    def __init__(self) -> None:
        self.pool: list[tuple[int, int, int]] = []

    def add(self, document: int, tokens: int) -> list[tuple[int, list]]:
        """Whole windows of the longest context; the rest waits in the pool."""
        full, rest = divmod(tokens, TIERS[0])
        if rest:
            bisect.insort(self.pool, (rest, document, full * TIERS[0]))
        return [(TIERS[0], [(TIERS[0], document, k * TIERS[0])]) for k in range(full)]

    def take(self, most: int) -> tuple[int, int, int]:
        """The longest waiting piece of at most ``most`` tokens, or a cut of the shortest."""
        at = bisect.bisect_right(self.pool, (most, 1 << 62, 0))
        if at:
            return self.pool.pop(at - 1)
        length, document, start = self.pool.pop(0)
        bisect.insort(self.pool, (length - most, document, start + most))
        return most, document, start

    def pack(self) -> list[tuple[int, list]]:
        """All full windows of the pool, from the longest tier down."""
        made = []
        for tier in TIERS:
            while self.pool and (self.pool[-1][0] > tier // 2 or tier == TIERS[-1]):
                window, gap = [], tier
                while gap and self.pool:
                    window.append(self.take(gap))
                    gap -= window[-1][0]
                if gap:  # nothing is left to fill it: the pieces wait
                    for piece in window:
                        bisect.insort(self.pool, piece)
                    break
                made.append((tier, window))
        return made

    def rest(self) -> list[tuple[int, list]]:
        """The remaining pieces in windows of powers of two."""
        made, left = [], sum(piece[0] for piece in self.pool)
        while left:
            tier = 1 << (left.bit_length() - 1)
            window, gap = [], tier
            while gap:
                window.append(self.take(gap))
                gap -= window[-1][0]
            made.append((tier, window))
            left -= tier
        return made


def step_groups(windows: list[tuple[int, list]]) -> list[int]:
    """Group of each window: of one context, equal token counts, and near equal cost, which
    is the sum of squared piece lengths (attention stays within a piece)."""
    groups, first = [0] * len(windows), 0
    for tier in sorted({w[0] for w in windows}, reverse=True):
        own = [k for k, w in enumerate(windows) if w[0] == tier]
        own.sort(key=lambda k: -sum(p[0] ** 2 for p in windows[k][1]))
        count = -(-len(own) * tier // STEP)
        for place, k in enumerate(own):
            lap, at = divmod(place, count)
            groups[k] = first + (at if lap % 2 == 0 else count - 1 - at)
        first += count
    return groups


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """One row per piece of every document, with the place it has in its sequence.

    Each row of ``docs`` (``doc_id``, ``text``; a null or empty text has the end token
    only) is tokenised whole, given the end token, and cut into pieces; repeated rows are
    packed each. Every partition is packed on its own in buffers of ``BUFFER`` tokens, so
    memory is bounded but for the longest text, and a lost task packs its partition again.
    Sequences have 2048, 1024, 512 or 256 tokens and no padding; the last few of a
    partition have smaller powers of two. Numbers of sequences and steps hold the
    partition. Other columns are ignored; an empty table gives an empty result.
    """

    def run(batches):
        encode, windows, base = encoder(vocabulary), Windows(), TaskContext.get().partitionId() << 33
        names = [field.split()[0] for field in SCHEMA.split(", ")]
        ids: dict[int, tuple] = {}
        number = {"sequence": 0, "step": 0, "document": 0}
        ready: list[tuple[int, list]] = []

        def rows(last: bool):
            made = ready + windows.pack() + (windows.rest() if last else [])
            ready.clear()
            steps = step_groups(made)
            columns = [[] for _ in names]
            for (context, pieces), step in zip(made, steps, strict=True):
                offset = 0
                for length, document, start in pieces:
                    doc_id, tokens = ids[document]
                    crc = zlib.crc32(tokens[start : start + length].tobytes())
                    values = (doc_id, start, length, crc, len(tokens), base + number["sequence"], offset, context, base + number["step"] + step)
                    for column, value in zip(columns, values, strict=True):
                        column.append(value)
                    offset += length
                number["sequence"] += 1
            number["step"] += max(steps, default=-1) + 1
            waiting = {piece[1] for piece in windows.pool}
            for document in [d for d in ids if d not in waiting]:
                del ids[document]
            kinds = [pa.int32() if name == "context" else pa.int64() for name in names]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        held = 0
        for batch in tidied(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = np.append(encode(text.as_py() or ""), np.uint32(END)).astype("<u4", copy=False)
                ids[number["document"]] = (doc_id, tokens)
                ready.extend(windows.add(number["document"], len(tokens)))
                number["document"] += 1
                held += len(tokens)
                if held >= BUFFER:
                    yield rows(False)
                    held = 0
        yield rows(True)

    made = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
    with short_batches(docs.sparkSession):
        return keep(made, shared_folder(docs.sparkSession), "packed")


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """Pieces of all documents in packed sequences."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
