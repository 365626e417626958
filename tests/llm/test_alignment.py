"""Alignment of tokenizers, against a plain version that walks over byte offsets."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from wayfold.llm import alignment

SCHEMA = "doc_id long, text string, row string, pair int, n long, times string"


def twin(rows):
    """The result of ``cross_tokenizer`` by sets of end offsets, text by text."""
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed values: bytes that stand for themselves
    others = [b for b in range(256) if b not in letters]
    byte = {chr(b): b for b in letters} | {chr(256 + i): b for i, b in enumerate(others)}
    of_a = lambda i: bytes(byte[c] for c in whole.id_to_token(i))
    of_b = lambda i: bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
    made, holders = [], Counter()
    for doc, text in rows:
        a = whole.encode(" " + text, add_special_tokens=False).ids if text else []
        b = model.encode(text) if text else []
        if b"".join(map(of_a, a)) != b"".join(map(of_b, b)) or b"".join(map(of_a, a)) != (" " + (text or "")).encode():
            a, b = [], []
        groups, i, j = [], 0, 0
        while i < len(a):
            own_a, own_b, end_a, end_b = [a[i]], [b[j]], len(of_a(a[i])), len(of_b(b[j]))
            i, j = i + 1, j + 1
            while end_a != end_b:
                if end_a < end_b:
                    own_a.append(a[i])
                    end_a, i = end_a + len(of_a(a[i])), i + 1
                else:
                    own_b.append(b[j])
                    end_b, j = end_b + len(of_b(b[j])), j + 1
            groups.append((own_a, own_b))
        links = [(x, y) for own_a, own_b in groups for x in own_a for y in own_b]
        holders.update(set(links))
        made.append((doc, a, b, groups, links))
    best = Counter()
    for (x, _), n in holders.items():
        best[x] = max(best[x], n)
    told = []
    for doc, a, b, groups, links in made:
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        told.append((doc, len(a), len(b), len(groups), len(links), sum(holders[x] == best[x[0]] for x in links), sum(holders[x] for x in links), hashlib.sha256(line.encode()).hexdigest() if a else ""))
    return sorted(told, key=repr)


def rows():
    r = random.Random(11)
    words = ["alpha", "Beta,", "naïve", "日本語", "😀", "\n", "<s>", "<|endoftext|>", "1234567", "  ", "\t", "étrange", "ﬁ", " ", "x" * 40, "'s", "tion"]
    made = [(i, r.choice(["", " "]).join(r.choice(words) for _ in range(r.randrange(1, 40)))) for i in range(120)]
    made += [(200, None), (201, ""), (202, " "), (203, "▁"), (204, "\x00a"), (205, "a" * 7000), (206, " " * 5000 + "b"), (207, "word " * 4000), (208, "\U0001f9d1‍\U0001f680" * 60), (None, "alpha"), (3, "alpha")]
    return made + [made[5]] * 3


@pytest.mark.parametrize("head", [0, 40, alignment.HEAD])
def test_whole_result_is_the_twins(spark, head, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE_CHARS", 900)
    monkeypatch.setattr(alignment, "WIDE", 6)
    made = rows()
    docs = spark.createDataFrame([(*x, "e", 1, 2, "e") for x in made], SCHEMA).repartition(3)
    got = alignment.cross_tokenizer(docs, head=head).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    told = sorted(map(tuple, got.collect()), key=repr)
    assert told == twin(made)
    assert sum(x[1] > 0 for x in told) > 100


def test_owners_give_overlaps_and_cuts():
    # Bytes: A cuts them 2 | 1 | 3 and B 1 | 2 | 3, so they share the cut after three.
    found = alignment.align(np.array([7, 8, 9]), np.array([2, 1, 3]), np.array([4, 5, 6]), np.array([1, 2, 3]), np.array([6]))
    assert list(zip(*found.overlaps, strict=True)) == [(0, 0), (0, 1), (1, 1), (2, 2)]
    assert found.a_group.tolist() == found.b_group.tolist()[:0] + [0, 0, 1] and found.group_text.tolist() == [0, 0]
    assert alignment.group_lines(found, 1) == [b"7,8|4,5;9|6"]
    keys, times, many = alignment.links(found)
    assert many.tolist() == [4, 1] and times.sum() == 5 and keys.tolist() == [a << 15 | b for a, b in ((7, 4), (7, 5), (8, 4), (8, 5), (9, 6))]


def test_no_documents(spark):
    assert alignment.cross_tokenizer(spark.createDataFrame([], SCHEMA)).collect() == []
    only = alignment.cross_tokenizer(spark.createDataFrame([(1, None, "", 1, 1, "")], SCHEMA)).collect()
    assert [tuple(r) for r in only] == [(1, 0, 0, 0, 0, "", 0, 0)]
