"""The training-data operators on small tables, against plain Python."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from wayfold.llm import fingerprint, html, langid, lm, mixing, packing, pii, simhash, topk, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, key string, row string"


def docs(spark, texts, **more):
    rows = [(i, t, more.get("lang", ["en"] * len(texts))[i], f"s{i % 3}" if i % 4 else None, len(t or ""), "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "Omega", "idiot", "ändern", "naïve", "42"]
    made = [" ".join(r.choice(words) for _ in range(r.randrange(1, 60))) for _ in range(40)]
    made += [made[3], made[3], made[5] + " tail", None, "", "   ", "word " * 5000, "x" * 9000]
    return made


# 1


def test_html_keeps_the_article_only():
    page = (
        '<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use</div>'
        '<article><h1>Head &amp; line</h1><p><b>One,  two\n three.<br><p>Next&nbsp;one</p><div class="ad">Buy</div><aside>Side</aside></article><section id="comments"><p>Nice post, really, I like it</p></section><footer>&copy; x</footer>'
    )
    assert html.main_text(page) == "Head & line\nOne, two three.\nNext one"


def test_html_without_article_scores_containers():
    body = "".join(f"<p>Sentence {i}, with words, and commas, that goes on for some time to count.</p>" for i in range(6))
    page = f'<body><div class="menu"><a href=1>a</a></div><div id="x"><div class="c">{body}</div></div><div><a href="/a">link one</a> <a href="/b">link two</a></div><form><p>Sign up</p></form></body>'
    assert html.main_text(page).count("\n") == 5 and "link" not in html.main_text(page)


@pytest.mark.parametrize("page", [None, "", "<", "<p", "text only", "</div></p>", "<p>a<p>b", "<script>x", "<!-- x", "<div" * 50])
def test_html_never_fails(page):
    assert isinstance(html.main_text(page), str)


def test_html_nulls_and_repeats(spark):
    pages = spark.createDataFrame([(1, None, None, "e"), (2, "u", "<p>hi", "e"), (2, "u", "<p>hi", "e")], "page_id long, url string, html string, text string")
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in html.extract(pages).collect()) == [(1, "", 0), (2, "hi", 2), (2, "hi", 2)]


# 2


def test_mixing_meets_its_targets(spark, texts):
    d = docs(spark, texts * 6)
    out = mixing.mix(d, carry=["doc_id", "source"]).collect()
    assert len(out) == 6 * len(texts)
    by = {}
    for r in out:
        assert 0 <= r["copies"] <= 2 and r["taken"] == r["copies"] * r["size"]
        by.setdefault(r["doc"]["source"], []).append(r)
    assert abs(sum(v[0]["target"] for v in by.values()) - min(1.5 * sum(r["size"] for r in out), sum(2 * v[0]["source_size"] for v in by.values()))) < 1
    for rows in by.values():
        biggest = max(r["size"] for r in rows)
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= biggest


def test_mixing_of_nothing(spark):
    assert mixing.mix(docs(spark, [])).count() == 0


# 3


def test_topk_is_brute_force(spark):
    r = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in r.normal(size=16)]) for i in range(150)] + [(200 + i, [0.5] * 16) for i in range(30)]
    vectors += [(300, None), (301, [None] * 16), (302, [float("nan")] * 16), (None, [0.0] * 16)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = sorted(tuple(x) for x in topk.top(df, df["vec_id"] % 20 == 0, 20).collect())
    ok = [(i, np.floor(64 * np.array(v))) for i, v in vectors if i is not None and i < 300]
    want = []
    for q, v in ok:
        if q % 20 == 0:
            rank = sorted((-int(v @ w), i) for i, w in ok if i != q)[:20]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(rank)]
    assert got == sorted(want)


def test_segment_statistics_bound_products():
    r = np.random.default_rng(1)
    a, b = r.normal(size=(40, 24)), r.normal(size=(50, 24))
    for s in topk.LEVELS:
        assert (topk.statistics(a, s) @ topk.statistics(b, s).T >= a @ b.T - 1e-9).all()


# 4


def test_packing_round_trip(spark, texts):
    out = packing.pack(docs(spark, texts)).collect()
    encode = packing.encoder("byte_bpe_50k")
    pieces, windows = {}, {}
    for r in out:
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert r["length"] > 0
    for i, t in enumerate(texts):
        own, at = sorted(pieces[i]), 0
        for start, length in own:
            assert start == at
            at += length
        assert at == len(encode(t or "")) + 1
    for own in windows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0


# 5


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    runs = [words[i : i + 3] for i in range(len(words) - 2)] if len(words) >= 3 else [words]
    hashes = [xxhash.xxh64_intdigest(" ".join(run).encode(), 42) for run in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    root = {i: i for i in fps}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(fps, 2):
        if (fps[a] ^ fps[b]).bit_count() <= 2 and top(a) != top(b):
            root[max(top(a), top(b))] = min(top(a), top(b))
    return {i: top(i) for i in fps}


def test_simhash_is_brute_force(spark, texts):
    out = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    fps = {i: plain_simhash(t) for i, t in enumerate(texts)}
    assert {i: v[0] for i, v in out.items()} == fps
    assert {i: v[1] for i, v in out.items()} == plain_components(fps)


def test_crowded_buckets_lose_no_link(spark):
    r = random.Random(8)
    base = r.getrandbits(64)
    fps = sorted({base ^ sum(1 << b for b in r.sample(range(40), r.randrange(4))) for _ in range(250)})
    rows = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)]
    nodes = spark.createDataFrame(rows, "fp long, rep long")
    shared = simhash.shared_keys(nodes.selectExpr("fp", "rep").select("fp", "rep", simhash.F.explode(simhash._variants(simhash.F.col("fp"))).alias("key"))).cache()
    links = simhash.bucket_links(shared).union(simhash.crowded_links(shared)).distinct().collect()
    got = {tuple(sorted((x["a"], x["b"]))) for x in links}
    assert got == {(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 2}


def test_one_of_each_group_stays(spark):
    r = random.Random(4)
    base = [" ".join(f"w{r.randrange(5000)}" for _ in range(300)) for _ in range(12)]
    near = [t.replace(t.split()[150], "changed", 1) for t in base[:6]]
    left = simhash.distinct_documents(docs(spark, [*base, *base[:3], *near, None, ""]))
    assert sorted(x["doc_id"] for x in left.collect()) == [*range(12), 21]
    assert left.columns == docs(spark, []).columns


def plain_groups(texts, bound=0.8):
    """Smallest member of the group of each text, by all pairs of shingle sets."""
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(range(len(texts)), 2):
        if 5 * len(sets[a] & sets[b]) >= 5 * bound * len(sets[a] | sets[b]) - 1e-6 and top(a) != top(b):
            root[max(top(a), top(b))] = min(top(a), top(b))
    return [top(i) for i in range(len(texts))]


def test_near_duplicates_are_brute_force_at_the_bound(spark):
    r = random.Random(9)
    line = " ".join(f"c{i}" for i in range(10))
    made = []
    for k in range(40):  # likeness from 0.7 to 0.9, each pair by itself
        words = [f"a{k}x{i}" for i in range(200)]
        other = words.copy()
        for i in r.sample(range(0, 200, 6), 3 + k % 6):
            other[i] = "new"
        made += [" ".join(words), " ".join(other)]
    own = lambda k: [f"{k}y{i}" for i in range(500)]
    made += [" ".join([*own("p"), *[line] * 40]), " ".join([*own("q"), *[line] * 40]), "one two", "One  two", "", None]
    want = plain_groups(made)
    assert 10 < sum(i != g for i, g in enumerate(want)) < 40
    left = simhash.distinct_documents(docs(spark, made)).collect()
    assert sorted(x["doc_id"] for x in left) == sorted(i for i, g in enumerate(want) if i == g)


def test_crowded_buckets_are_settled_whole(spark):
    r = random.Random(12)
    made = []
    for k, (many, changes) in enumerate([(60, (3, 7)), (50, (4, 6))]):  # loose groups: most members are unlike
        base = [f"g{k}x{i}" for i in range(300)]
        for m in range(many):
            words = base.copy()
            for i in r.sample(range(300), r.randrange(*changes)):
                words[i] = f"n{k}m{m}"
            made.append(" ".join(words))
    want = plain_groups(made)
    left = simhash.distinct_documents(docs(spark, made)).collect()
    assert 2 < sum(i == g for i, g in enumerate(want)) < len(made)
    assert sorted(x["doc_id"] for x in left) == [i for i, g in enumerate(want) if i == g]


# 6


def plain_spans(t):
    def luhn(d):
        return sum(int(c) if k % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for k, c in enumerate(reversed(d))) % 10 == 0

    found = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()  # noqa: B023
            if good:
                found.append(f"{kind}:{m.start()}:{m.end()}")
    return found


def test_base_spans_are_the_rules(spark):
    t = ["a@b.c_d@e.f x.y+z@host-1.example.org é@x.y", "1.2.3.4.5.6.7.8 999.1.1.1 0001.02.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (017) 555-7713 +12 +49.30.1234567890123456", None, "", "1 " * 4000, "a@" * 300 + "b.c" + ".d" * 5000, "ü😀 q@w.de"]
    for r in pii.personal_data(docs(spark, t)).collect():
        want = plain_spans(t[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), r["doc_id"]
        assert set(want) <= set(r["spans"].split(",")) | {""}


def test_trees_find_hidden_data_and_leave_numbers(spark):
    t = ["please mail jo.do [at] example [dot] com today", "call phone (555) 123-4567 now", "the date 2021-05-06 and isbn 978-3-1615-1484-0", "seen at 12:30:45 on page 12345678"]
    out = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs(spark, t)).collect()}
    assert out[0].startswith("email:") and "phone:" in out[1] and out[2] == "" and out[3] == ""


def test_redaction(spark):
    out = {r["doc_id"]: r for r in pii.redacted(docs(spark, ["write a@b.co, ring +1 (017) 555-7713.", "plain", None])).collect()}
    assert out[0]["text"] == "write [EMAIL], ring [PHONE]." and out[0]["n_chars"] == 28 and out[1]["text"] == "plain" and out[2]["text"] is None


# 7


def test_fingerprints_tell_likeness(spark, texts):
    out = {r["doc_id"]: r for r in fingerprint.fingerprints(docs(spark, texts)).collect()}
    assert len(out) == len(texts) and out[40]["fingerprint"] == out[3]["fingerprint"]
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[(i - 1) % len(texts)] or ""
        cut = len(t) // 3
        assert out[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest()
        assert 0 <= out[i]["near_edited"] <= 1 and out[i]["n_chars"] == len(t)


# 8


def test_language_model_prefers_its_target(spark):
    r = random.Random(1)
    rows = [" ".join(r.choice(["good", "clear", "prose"] if i % 2 else ["spam", "click", "here"]) for _ in range(40)) for i in range(60)] + [None, ""]
    d = docs(spark, rows)
    out = {x["doc_id"]: x for x in lm.score(d, d["doc_id"] % 2 == 1).collect()}
    assert max(out[i]["score"] for i in range(1, 60, 2)) < min(out[i]["score"] for i in range(0, 60, 2))
    assert out[60]["score"] == 0 and out[60]["n_tokens"] == 0


def test_lm_counts_every_pair_by_itself(spark, texts):
    r = random.Random(6)
    made = [*texts, *(" ".join(f"v{r.randrange(60_000)}" for _ in range(3000)) for _ in range(60))]
    words = [re.findall(r"\w+|[^\w\s]", (t or "").lower()) for t in made]
    pairs = [list(zip(["<s>", *w], w, strict=False)) for w in words]
    assert len({p for own in pairs for p in own}) > 1 << 17
    out = {x["doc_id"]: x for x in lm.score(docs(spark, made), simhash.F.col("doc_id") % 2 == 1).collect()}
    many = len({w for own in words for w in own})
    count = lambda lists: Counter(itertools.chain.from_iterable(lists))
    for name, rows in (("loss_background", range(len(made))), ("loss_target", range(1, len(made), 2))):
        single, both, heads = count(words[i] for i in rows), count(pairs[i] for i in rows), count([a for a, _ in pairs[i]] for i in rows)
        for i, own in enumerate(words):
            if not own:
                assert out[i][name] == 0
                continue
            inside = i in rows
            s, b, h = Counter(own), Counter(pairs[i]), Counter(a for a, _ in pairs[i])
            left = lambda t, o, k: t[k] - o[k] * inside  # noqa: B023, E731
            n = sum(single.values()) - len(own) * inside
            p = [0.6 * left(both, b, q) / max(1, left(heads, h, q[0])) + 0.3 * left(single, s, q[1]) / max(1, n) + 0.1 / many for q in pairs[i]]
            assert out[i]["n_tokens"] == len(own) and abs(out[i][name] + np.mean(np.log(p))) < 1e-6, (i, name)


# 9


def test_network_learns_and_scores_every_window(spark):
    r = random.Random(2)
    clean = lambda n: " ".join(r.choice("the of and to in it is was for with".split()) for _ in range(n))
    rows = [clean(r.randrange(5, 120)) + (" moron " if i % 3 == 0 else " ") + clean(30) for i in range(240)] + [None, "", clean(3000) + " moron " + clean(10)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    out = {x["doc_id"]: x for x in toxicity.toxicity(docs(spark, rows), labels).collect()}
    right = [out[i]["predicted"] == int(i % 3 == 0) for i in range(240) if out[i]["held_out"]]
    assert np.mean(right) > 0.9 and out[242]["predicted"] == 1 and 0 <= out[240]["score"] <= 1


# 10


def test_languages(spark):
    r = random.Random(3)
    words = {"en": "the and of with", "de": "der und von mit", "fr": "le et de avec"}
    langs = [("en", "de", "fr")[i % 3] for i in range(120)] + ["en", None, None]
    rows = [" ".join(r.choice(words[lang].split()) for _ in range(30)) for lang in langs[:120]] + [None, "123 !", ""]
    d = docs(spark, rows, lang=langs)
    out = {x["doc_id"]: x for x in langid.identify(d, langid.fold("doc_id", 3) != 1).collect()}
    assert all(out[i]["lang_pred"] == langs[i] for i in range(120)) and {out[i]["lang_pred"] for i in (120, 121, 122)} == {"und"}


def test_stages_keep_the_columns(spark, texts, tmp_path):
    import corpus_pipeline

    clean = [None if t is None else t.replace("idiot", "beta") for t in texts]
    d = docs(spark, clean + [f"shut up you idiot, {t}" for t in texts[:30]])
    spark.createDataFrame([(i, int(i >= len(clean))) for i in range(len(clean) + 30) if i % 9], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns == docs(spark, []).columns, name
    assert corpus_pipeline.STAGES[4][1](spark, d, str(tmp_path)).count() > 0
