"""Operators against plain twins, hostile inputs and empty tables."""

import random
import time
import zlib

import numpy as np
import pytest

from wayfold.llm import fingerprint, html, langid, lm, mixing, packing, pii, simhash, topk, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _good string, score string, `a.b` string"
PARAGRAPH = "<p>Sentence one, with words, and commas, that goes on for some time to count here.</p>"


def docs(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, "en", (sources or ["s"] * len(texts))[i], len(t or ""), "g", "s", "c") for i, t in enumerate(texts)], SCHEMA)


# 1


@pytest.mark.parametrize("page, lines", [
    ("<p>" + "<span>" * 2000 + "deep" + "</span>" * 2000 + PARAGRAPH * 3, 4),
    (f'<div class="layout has-sidebar"><div>{PARAGRAPH * 5}</div><div class="sidebar"><p>Side</p></div></div>', 5),
    (f'<div class="site no-sidebar">{PARAGRAPH * 4}</div>', 4),
    (f'<div class="right-sidebar"><div>{PARAGRAPH * 4}</div><div class="ad-box">x</div></div>', 4),
    (f'<div class="content with-comments">{PARAGRAPH * 4}<div id="comments">{PARAGRAPH * 9}</div></div>', 4),
    (f'<article>{PARAGRAPH}<section class="related-work"><h2>Related work</h2>{PARAGRAPH}</section><div class="related-posts"><a href=1>one</a></div></article>', 3),
    (f'<article><p class="ad">Buy<p>Kept<ul><li class="share">s<li>this item</ul>{PARAGRAPH}</article>', 3),
    (f'<main><article>{PARAGRAPH * 2}</article><section class="comments"><article class="comment">{PARAGRAPH}</article></section></main>', 2),
    (f'<form id="all"><div>{PARAGRAPH * 4}</div><input></form>', 4),
    ('<div class="ad">An advert that is longer than the article.</div><article><p>Short.</p></article>', 1),
])
def test_html_keeps_what_is_the_article(page, lines):
    text = html.main_text(page)
    assert text.count("\n") + 1 == lines and not any(x in text for x in ("Side", "Buy", "advert", "one\n"))


@pytest.mark.parametrize("page", ["<a href='x " * 20_000, "<a " * 20_000, "<div>" * 20_000 + PARAGRAPH, "<div>" + "<span>" * 20_000 + "<center>" * 20_000 + "</b>" * 20_000, "<p>x</b>" * 20_000, "<!--" * 20_000])
def test_html_takes_time_by_length(page):
    began = time.process_time()
    html.main_text(page)
    assert time.process_time() - began < 5


# 2


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in capped else weight[s] * level for s in order}
        capped |= over


def test_mixing_targets_ties_and_reruns(spark):
    r = random.Random(4)
    texts = ["word " * r.choice([0, 1, 7, 7, 7, 40]) for _ in range(300)] + [None]
    sources = [r.choice(["a", "b", None, "é", "z"]) if i % 3 else "a" for i in range(301)]
    one, two = (sorted((x["doc"]["doc_id"], x["taken"], x["target"]) for x in mixing.mix(docs(spark, texts, sources), carry=["doc_id", "source"]).collect()) for _ in range(2))
    assert one == two
    sizes: dict = {}
    for t, s in zip(texts, sources, strict=True):
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = plain_targets(sizes)
    assert all(abs(target - want[sources[i]]) < 1e-6 * max(1, want[sources[i]]) for i, _, target in one)
    for s, target in want.items():
        assert abs(sum(t for i, t, _ in one if sources[i] == s) - target) <= 40


# 4


def test_packing_is_tokenizers_own(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["<|endoftext|> hello", "plain words, 12 of them\n\n  and   space", "naïve 😀 ändern", "x" * 5000, None, "", "word " * 3000, "a b"]
    ids = [np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for x in texts]
    seen = {i: 0 for i in range(len(texts))}
    for p in sorted(packing.pack(docs(spark, texts)).collect(), key=lambda p: (p["doc_id"], p["start"])):
        own = ids[p["doc_id"]]
        assert p["start"] == seen[p["doc_id"]] and p["doc_tokens"] == len(own)
        assert p["ids_crc32"] == zlib.crc32(own[p["start"] : p["start"] + p["length"]].tobytes())
        seen[p["doc_id"]] += p["length"]
    assert all(seen[i] == len(ids[i]) for i in seen)


# 6


def test_dense_personal_data(spark):
    text = " ".join(f"user{i}@host.example.org" for i in range(20_000))
    found = pii.personal_data(docs(spark, [text, "ünï a@b.co x"])).orderBy("doc_id").collect()
    assert found[0]["n_email"] == 20_000 and found[1]["spans"] == "email:4:10"
    last = found[0]["spans"].rsplit(",", 1)[1]
    assert last == f"email:{len(text) - len('user19999@host.example.org')}:{len(text)}"
    clean = pii.redacted(docs(spark, [text + " end", "ünï a@b.co x"])).orderBy("doc_id").collect()
    assert clean[0]["text"] == "[EMAIL] " * 20_000 + "end" and clean[1]["text"] == "ünï [EMAIL] x"


# 10


def test_language_totals_are_the_sum_over_ngrams():
    r = np.random.default_rng(0)
    texts = ["hello wörld " * 90, "a", "xyz" * 700, "é"]
    table = r.standard_normal((langid.BUCKETS, 3)).astype(np.float32)
    for _, text in enumerate(texts):
        codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
        want = sum(table[langid.hashed(codes, s)].sum(axis=0, dtype=np.float64) for s in langid.SIZES)
        assert np.allclose(langid.totals([text], table)[0], want, atol=1e-3)
    parts = list(langid.grams(texts, 64))
    assert sum(len(f) for f, _ in parts) == sum(max(0, len(t) - s + 1) for t in texts for s in langid.SIZES)


# 9


def test_scoring_is_the_training_network():
    net, r = toxicity.Network(3), np.random.default_rng(0)
    projected = net.project(r.standard_normal((50, toxicity.WIDTH)).astype(np.float32))
    ids = r.integers(0, 50, (20, toxicity.WINDOW))
    for k in range(20):
        ids[k, 1 + 2 * k :] = -1
    assert np.allclose(net.forward(projected, ids), net.logits(projected, ids), atol=1e-5)
    scorer = toxicity.Scorer(net)
    words = [[f"w{i % 900}" for i in range(n)] for n in (0, 5, 40_000, 70)]
    whole = scorer.logits(words)
    assert [len(x) for x in whole] == [toxicity.window_count(len(w)) for w in words]
    assert np.allclose(whole[3], toxicity.Scorer(net).logits([words[3]])[0], atol=1e-5)


def test_copies_of_one_text_count_once_in_the_sample(spark):
    rows = [(i, "same text", int(i == 7)) for i in range(400)] + [(1000 + i, f"text {i}", i % 2) for i in range(20)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    found = toxicity.sampled(table, toxicity.shared_folder(spark)).collect()
    assert len(found) == 21 and [x["toxic"] for x in found if x["text"] == "same text"] == [1]


# 3


def test_survivors_hold_all_that_reach_the_limit():
    r = np.random.default_rng(5)
    q, c = r.normal(size=(8, 64)), r.normal(size=(500, 64))
    for row in range(8):
        scores = c @ q[row]
        least = np.sort(scores)[-20]
        left = topk.survivors([topk.statistics(q, s)[row] for s in topk.LEVELS], [topk.statistics(c, s) for s in topk.LEVELS], least)
        assert set(np.flatnonzero(scores >= least)) <= set(left.tolist()) and len(left) < 500


def test_empty_tables(spark):
    none = docs(spark, [])
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    made = [html.extract(pages), topk.top(vectors, vectors["vec_id"] % 20 == 0), packing.pack(none), simhash.near_duplicates(none), simhash.distinct_documents(none), pii.personal_data(none), fingerprint.fingerprints(none), lm.score(none.select("doc_id", "text"), none["doc_id"] > 0), toxicity.toxicity(none, labels), langid.identify(none, langid.fold("doc_id", 3) != 1)]
    assert [m.count() for m in made] == [0] * len(made)


@pytest.mark.parametrize("page, kept, gone", [
    ("<body><article><p>Hi.</p></article><div><p>" + "A longer paragraph, with words, beside it. " * 9 + "</p></div></body>", "Hi.", "beside"),
    (f'<main>{PARAGRAPH * 4}<div class="responses"><div class="r"><span class="author">Jo</span><p>' + "I like it, really. " * 40 + "</p></div></div></main>", "Sentence", "like"),
    (f"<article>{PARAGRAPH * 9}<ol>" + "".join(f'<li><b class="user">{n}</b><time>1</time><p>I like it, really.</p></li>' for n in "abc") + "</ol></article>", "Sentence", "like"),
    (f'<article>{PARAGRAPH * 9}<section class="discussion"><h2>Discussion</h2><p>What we like, in short.</p></section></article>', "like", "nothing"),
    (f'<aside><article>{PARAGRAPH}</article></aside><main><p>The text, that counts.</p></main>', "counts", "Sentence"),
    (f"<main><h1>T</h1><ul>" + "".join(f"<li><time>{n}</time><p>Event {n}, with words, in order.</p></li>" for n in range(9)) + "</ul></main>", "Event 8", "nothing"),
])
def test_marked_articles_win_and_discussions_go(page, kept, gone):
    text = html.main_text(page)
    assert kept in text and gone not in text


# 6


def test_filters_on_spans_and_redacted_texts_plan_fast(spark):
    rows = docs(spark, ["mail a@b.com now", "call (212) 555-0199 x", "nothing"] * 3)
    began = time.time()
    assert pii.with_spans(rows).where("size(spans) > 0 and size(base) < 2").count() == 6
    assert pii.redacted(rows).where("length(text) > 3 and text like '%EMAIL%'").count() == 3
    assert time.time() - began < 60


# 9


def test_scores_are_the_networks_window_by_window():
    # Word by word in plain Python: inputs, both recurrent passes, attention, the highest window.
    net = toxicity.Network(3)
    net.calibration = (1.3, -0.2)
    p, n = {k: v.astype(float) for k, v in net.p.items()}, toxicity.STATE
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def state(inputs, side):
        h, out = np.zeros(n), []
        for x in inputs:
            g, hu = x @ p["w" + side] + p["c" + side], h @ p["u" + side]
            z, r = sigmoid(g[:n] + hu[:n]), sigmoid(g[n : 2 * n] + hu[n : 2 * n])
            h = h + z * (np.tanh(g[2 * n :] + r * hu[2 * n :]) - h)
            out.append(h)
        return out

    def whole(text):
        words, tops = toxicity.WORD.findall((text or "").lower()), []
        for start in range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE):
            rows = [toxicity.features(w) for w in words[start : start + toxicity.WINDOW]]
            inputs = [p["table"][r[0]] + p["table"][r[1:]].mean(axis=0) for r in rows]
            pooled = np.zeros(2 * n)
            if inputs:
                h = np.array([np.concatenate(x) for x in zip(state(inputs, "f"), state(inputs[::-1], "b")[::-1], strict=True)])
                weight = np.exp(h @ p["a"])
                pooled = weight @ h / weight.sum()
            tops.append(pooled @ p["v"] + p["b"][0])
        return sigmoid(1.3 * max(tops) - 0.2)

    r = random.Random(4)
    texts = [" ".join(r.choice(["alpha", "same", "same", "x", "naïve", "y" * 60]) for _ in range(k)) for k in (1, 12, 13, 47, 48, 49, 84, 85, 400)] + [None, "", "same " * 200, "..."]
    assert np.allclose(toxicity.Scorer(net).scores(texts), [whole(t) for t in texts], atol=1e-5)


def test_rows_of_words_are_their_checksums():
    words = ["a", "naïve", "日本", "x" * 24, "ab"]
    grams = lambda m: [8192 + zlib.crc32(m[i : i + n]) % 8192 for n in (3, 4) for i in range(len(m) - n + 1)]
    assert [toxicity.features(w) for w in words] == [[zlib.crc32(f"^{w}$".encode()) % 8192, *grams(f"^{w}$".encode())] for w in words]
    own, rows, many = toxicity.table_rows(words)
    assert rows.tolist() == [r for w in words for r in toxicity.features(w)[1:]] and many.tolist() == [len(toxicity.features(w)) - 1 for w in words]
    assert [len(x) for x in toxicity.table_rows([])] == [0, 0, 0]


def test_toxicity_without_labels_and_with_clashing_columns(spark):
    d = docs(spark, ["one two", "three", None]).withColumnRenamed("n_chars", "doc").withColumnRenamed("_good", "predicted")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["predicted"] for r in toxicity.toxicity(d, none).collect()] == [0, 0, 0]
    assert toxicity.without_toxic(d, none).columns == d.columns


# 10


def test_sample_is_the_least_hashes(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 7)
    rows = spark.createDataFrame([(lang, f"{lang} {k % 40}") for lang in ("a", "b", "c") for k in range(90 if lang != "c" else 3)], "lang string, text string")
    from pyspark.sql import functions as F

    every = rows.withColumn("h", F.xxhash64("text")).distinct().collect()
    want = {(lang, r["text"]) for lang in "abc" for r in sorted((x for x in every if x["lang"] == lang), key=lambda x: x["h"])[:7]}
    for lead in ((), (1,), (4, 16), (10, 20, 40)):
        monkeypatch.setattr(langid, "LEAD", lead)
        got = [tuple(x) for x in langid.sampled(rows).collect()]
        assert len(got) == len(want) and set(got) == want
