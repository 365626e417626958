"""Near duplicates of the pipeline come through the index of SimHash fingerprints."""

import itertools
import random

from wayfold.llm import jaccard, simhash


def texts():
    r = random.Random(3)
    base = [" ".join(f"w{r.randrange(5000)}" for _ in range(400)) for _ in range(8)]
    near = [t.replace(t.split()[200], "changed", 1) for t in base]
    loose = [" ".join("new" if i % 40 == 20 else w for i, w in enumerate(t.split())) for t in base[:2]]
    line = " ".join(f"c{i}" for i in range(10))
    lines = [" ".join([*(f"{k}y{i}" for i in range(20)), *[line] * 60]) for k in "pq"]  # alike by fingerprint, not by sets
    return [*base, *near, *loose, *lines]


def test_candidates_are_all_pairs_of_near_fingerprints(spark, tmp_path):
    made = texts()
    fps = [simhash.simhash(t.encode(), 5) for t in made]
    want = {(a, b) for a, b in itertools.combinations(range(len(made)), 2) if (fps[a] ^ fps[b]).bit_count() <= 2}
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    got = simhash.candidates(docs, 5, f"file://{tmp_path}").collect()
    assert want and {tuple(sorted((x.a, x.b))) for x in got} == want


def test_stage_links_what_fingerprints_find(spark, monkeypatch):
    made = texts()
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    whole = {r.doc_id for r in simhash.distinct_documents(docs).collect()}
    assert whole == {*range(8), 16, 17, 18, 19}  # 0.776 and less are not alike
    mixed = jaccard._mixed
    monkeypatch.setattr(jaccard, "_mixed", lambda *a: mixed(*a).where("false"))  # nothing but fingerprints
    fps = [simhash.simhash(t.encode(), 5) for t in made]
    close = {8 + k for k in range(8) if (fps[k] ^ fps[8 + k]).bit_count() <= 2}
    alone = {r.doc_id for r in simhash.distinct_documents(docs).collect()}
    assert close and alone & (close | {18, 19}) == {18, 19}
