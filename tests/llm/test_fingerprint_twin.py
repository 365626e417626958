"""Fingerprints against a plain twin: one document after the other, one bin after the other."""

import hashlib
import random
import re
import struct

import pytest
import xxhash

from wayfold.llm import fingerprint

BINS = 128


def chained(*values, seed=42):
    """Signed XXH64 of texts and numbers (``(format, number)``), each seeded by the one before."""
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack(*v)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def twin_bins(text):
    words = [("<q", chained(w)) for w in re.findall(r"[^\x20\x09-\x0D]+", text.lower())]
    if not words:
        return None
    hashes = [chained(*words[i : i + 5]) for i in range(max(1, len(words) - 4))]
    least = [None] * BINS
    for h in hashes:
        b = (h >> 57) + BINS // 2
        least[b] = h if least[b] is None else min(least[b], h)
    own = [None if h is None else h & 255 for h in least]
    filled = []
    for i, x in enumerate(own):
        tries = [own[chained(("<i", i), ("<i", k)) % BINS] for k in range(24)] + own[i:] + own
        filled.append(x if x is not None else next(t for t in tries if t is not None))
    return filled


def twin_likeness(a, b):
    if a is None or b is None:
        return float(a is None and b is None)
    equal = sum(x == y for x, y in zip(a, b, strict=True)) / BINS
    return max(0.0, (equal - 1 / 256) / (1 - 1 / 256))


def twin_hex(bins):
    return "".join(f"{x:02x}" for x in bins or [])


def test_fingerprints_are_those_of_the_twin(spark):
    draw = random.Random(5)
    known = ["Wort", "été", "naïve", "𝔘nicode", "x", "a-b", "ЖУК"] + [f"w{k}" for k in range(300)]
    text = lambda n: "".join(draw.choice(known) + draw.choice([" ", "\n", " \t", " "]) for _ in range(n))
    long = text(900)
    texts = [None, "", " \n", "one", "three small words", "a b c d e", "A B C D E F", text(40), long, long + " more", text(2500), "", long]
    ids = draw.sample(range(-50, 1000), len(texts))
    rows = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    made = {r["doc_id"]: r.asDict() for r in fingerprint.fingerprints(rows).collect()}
    order = sorted(((i, t or "") for i, t in zip(ids, texts, strict=True)), reverse=True)
    assert len(made) == len(order)
    for (doc_id, own), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        cut = len(own) // 3
        edited = own[: len(own) - cut] + after[:cut]
        bins, other, following = map(twin_bins, (own, edited, after))
        assert made[doc_id] == {
            "doc_id": doc_id, "n_chars": len(own), "edited_sha256": hashlib.sha256(edited.encode()).hexdigest(),
            "fingerprint": twin_hex(bins), "edited_fingerprint": twin_hex(other),
            "near_edited": pytest.approx(twin_likeness(bins, other)), "near_next": pytest.approx(twin_likeness(bins, following)),
        }
