"""Repeated rows, null ids, clashing columns and whole tables."""

import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from wayfold.llm import fingerprint, html, lm, mixing, topk


def test_topk_takes_the_smallest_vector_of_a_repeated_id(spark):
    rows = [(20, [0.5, 0.0]), (20, [0.25, 1.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [0.5, 2.0])]
    df = spark.createDataFrame([(*x, 0, "r") for x in rows], "vec_id long, embedding array<float>, score long, rank string")
    got = sorted(map(tuple, topk.top(df, df["vec_id"] % 20 == 0, 5).collect()))
    one = np.array([16, 64])
    assert got == [(20, 1, 2, int(one @ [32, 128])), (20, 2, 1, int(one @ [64, 64]))]


def test_mixing_of_an_empty_table_and_of_repeated_rows(spark):
    schema = "doc_id long, text string, source string, size string, key string, hash string, n string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    rows = [(k % 7, "one two three" * (k % 3), f"s{k % 2}", "z", "k", "h", "n") for k in range(60)]
    made = mixing.mix(spark.createDataFrame(rows, schema)).collect()
    assert len(made) == 60 and {r["doc"]["size"] for r in made} == {"z"} and all(0 <= r["copies"] <= 2 for r in made)


def test_lm_scores_repeated_rows_alike(spark):
    rows = [(1, "alpha beta gamma"), (1, "alpha beta gamma"), (2, "alpha beta"), (3, "delta"), (None, "delta"), (4, None)]
    df = spark.createDataFrame([(*x, "g", "c", "w") for x in rows], "doc_id long, text string, good string, chunk string, words string")
    made = sorted(map(tuple, lm.score(df, df["doc_id"] == 1).collect()), key=repr)
    assert len(made) == 6 and len({m for m in made if m[0] == 1}) == 1


def test_fingerprints_of_repeated_and_null_ids(spark):
    rows = [(5, "a b c d e f g"), (5, "a b c d e f g"), (None, "x y"), (None, None), (9, "a b c d e f h")]
    df = spark.createDataFrame([(*x, "f", "n") for x in rows], "doc_id long, text string, fingerprint string, n_chars string")
    made = fingerprint.fingerprints(df).collect()
    assert len(made) == 5 and len({r["fingerprint"] for r in made if r["doc_id"] == 5}) == 1
    assert sorted(r["n_chars"] for r in made) == [0, 3, 13, 13, 13]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_main_texts_of_whole_pages_hold_no_markup(sf):
    # What is kept stands in the page, in its order, without tags, scripts and entities.
    for page in pq.read_table(f"/root/testdata/{sf}/pages.parquet", columns=["html"])["html"].to_pylist():
        text = html.main_text(page)
        plain = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ", page or "")
        plain = " ".join(html.html.unescape(re.sub(r"<[^>]*>", " ", plain)).split())
        at = 0
        for line in text.split("\n") if text else []:
            words = line.split()
            assert not re.search(r"</?[a-z]+[ >]", line)
            found = re.compile(r"\s*".join(map(re.escape, "".join(words))) if len(words) < 3 else r"\s*".join(map(re.escape, words))).search(plain, at)
            assert found, line[:80]
            at = found.end()


def test_long_runs_are_looked_for_at_few_places():
    """The search for very long runs costs little beside the tokenising of ordinary text, and finds
    a run wherever it begins."""
    import time

    from wayfold.llm import packing

    encode = packing.encoder("byte_bpe_50k")
    inside = dict(zip(encode.__code__.co_freevars, (c.cell_contents for c in encode.__closure__), strict=True))
    found, n = inside["long_run"], packing.LONG_RUN
    for before in (0, 1, n // 2 - 1, n // 2, n // 2 + 1, n - 1):
        for run in ("a", "7", "-", " "):
            assert found("b. " * (before // 3) + "b1"[: before % 3] + "," * (run != "-") + run * n + ("x" if run != "a" else "."))
            assert not found(("1b" if run == "7" else "b1") * (before // 2) + run * (n - 1) + ("1" if run != "7" else "x") * (n - 1))
    text = "It was said, in 1999, that words are short. " * 20_000
    start = time.process_time()
    inside["fast"].encode_to_numpy(text)
    whole, start = time.process_time() - start, time.process_time()
    assert not found(text)
    assert time.process_time() - start < whole / 10
