"""Personal data: base patterns, and candidates that boosted trees accept.

Base spans follow fixed rules and always stay. Besides them, high-recall generators propose
overlapping spans (obfuscated addresses, phone numbers without a plus, cards with other
separators, long-form network addresses). Gradient-boosted trees score each by features of
its format and context, and the calibrated score is held against a threshold for its kind.
All of it is DataFrame functions and SQL; only the trees are fitted on the driver, from a
fixed number of generated examples whose features the same SQL computes.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.boosting import Boosted

KINDS = ("email", "ip", "card", "phone")
# The rules' patterns; possessive where no shorter match can be right, so that time stays
# linear in the text. A match of the first begins where a run begins or the last one ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT = r"(?:\x20?\[at\]\x20?|\x20?\(at\)\x20?|\x20@\x20|\x20at\x20(?=[A-Za-z0-9-]{1,63}\x20dot\x20))"
_DOT = r"(?:\.|\x20?\[dot\]\x20?|\x20?\(dot\)\x20?|\x20dot\x20)"
PROPOSED = {
    "email": rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+{_AT}[A-Za-z0-9-]{{1,63}}+(?:{_DOT}[A-Za-z0-9-]{{1,63}}+){{1,6}}+",
    "ip": r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}+(?:::?[0-9A-Fa-f]{1,4}+){2,7}+(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9](?:[\x20._/-]?[0-9]){12,18}+(?![0-9])",
    "phone": r"(?<![0-9A-Za-z.+])\(?[0-9][\x20()./0-9-]{5,20}[0-9](?![0-9A-Za-z])",
}
CONTEXT = 24
PRECISION = 0.97
#: Generated examples; every second of them calibrates.
EXAMPLES = 2400
_SPAN = "struct<m:string,start:int,stop:int,before:string,after:string>"
#: Elements that running totals are first summed by.
PART = 64
#: Code points of the pieces that a text is cut into before spans are taken out of it.
PIECE = 1024
#: Words near a kind, in lower case.
_HINT = {
    "email": r"mail|contact|write|reach|kontakt|courriel|correo",
    "ip": r"\\bip\\b|ipv6|host|server|addr|node|client",
    "card": r"card|visa|credit|debit|karte|carte|tarjeta|payment",
    "phone": r"phone|tel|call|fax|mobil|ring|dial|anruf|numéro|llam|\\bsms\\b",
}


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _parts(values: str, value: str, merge: str) -> str:
    """SQL for the total of each ``PART`` elements ``y`` of an array: ``value`` of each, merged
    (``t`` with ``y``) from 0 on. A fold that collects copies all it has at each step, so
    running totals are made of numbers only: those of parts, of the parts before, and within
    one part."""
    return f"transform(sequence(0, cast((size({values}) - 1) div {PART} AS int)), b -> aggregate(slice({values}, b * {PART} + 1, {PART}), 0, (t, y) -> {merge.format(value)}))"


def _tops(parts: str, merge: str) -> str:
    return f"transform({parts}, (x, b) -> aggregate(slice({parts}, 1, b), 0, (t, y) -> {merge.format('y')}))"


def _before(values: str, tops: str, value: str, merge: str) -> str:
    """SQL for the total of all elements before the one at ``i``."""
    return f"aggregate(slice({values}, i - i % {PART} + 1, i % {PART}), get({tops}, cast(i div {PART} AS int)), (t, y) -> {merge.format(value)})"


SUM, MOST = "t + {0}", "greatest(t, {0})"


def _with_spans(df: DataFrame, patterns: dict[str, str], names: dict[str, str]) -> DataFrame:
    """Matches of each pattern with their places and context: the text is what stands between
    matches and the matches in turn, so starts are running sums of lengths.

    Each step names all columns it uses in its condition too: a column named once would be
    computed where it is used, for each element of the other array."""
    filled = lambda n, sql, *used: F.expr(f"CASE WHEN size(m_{n}) > 0{''.join(f' AND {x}_{n} IS NOT NULL' for x in used)} THEN {sql} END")
    made = df.withColumns({f"m_{n}": F.expr(f"regexp_extract_all(text, {_quoted(patterns[k])}, 0)") for k, n in names.items()})
    made = made.withColumns({f"g_{n}": filled(n, f"split(text, {_quoted(patterns[k])}, -1)") for k, n in names.items()})
    made = made.withColumns({f"l_{n}": filled(n, f"transform(m_{n}, (m, i) -> length(m) + length(get(g_{n}, i)))", "g") for n in names.values()})
    made = made.withColumns({f"s_{n}": filled(n, _parts(f"l_{n}", "y", SUM), "l") for n in names.values()})
    made = made.withColumns({f"t_{n}": filled(n, _tops(f"s_{n}", SUM), "s") for n in names.values()})
    starts = {n: filled(n, f"transform(m_{n}, (m, i) -> {_before(f'l_{n}', f't_{n}', 'y', SUM)} + length(get(g_{n}, i)))", "g", "l", "t") for n in names.values()}
    made = made.withColumns({f"o_{n}": c for n, c in starts.items()})
    item = lambda n: f"named_struct('m', m, 'start', get(o_{n}, i), 'stop', get(o_{n}, i) + length(m), 'before', right(get(g_{n}, i), {CONTEXT}), 'after', left(get(g_{n}, i + 1), {CONTEXT}))"
    made = made.withColumns({n: F.expr(f"CASE WHEN size(m_{n}) > 0 THEN transform(m_{n}, (m, i) -> {item(n)}) ELSE cast(array() AS array<{_SPAN}>) END") for n in names.values()})
    return made.drop(*(f"{x}_{n}" for x in "mglsto" for n in names.values()))


_PLACE = "struct<kind:int,start:int,stop:int>"


def _free(df: DataFrame, taken: str, more: str) -> DataFrame:
    """``df`` with only those spans of ``more`` that overlap none of ``taken``. In order of the
    places where taken spans start and the others stop, such a span begins where no taken
    one before it goes on: a running maximum of their stops."""
    filled = lambda sql: F.expr(f"CASE WHEN size({more}) > 0 AND size({taken}) > 0 THEN {sql} END")
    events = f"""array_sort(concat(
        transform({more}, c -> named_struct('at', c.stop, 'reach', 0, 'kind', c.kind, 'start', c.start, 'stop', c.stop)),
        transform({taken}, c -> named_struct('at', c.start, 'reach', c.stop, 'kind', c.kind, 'start', c.start, 'stop', c.stop))))"""
    made = df.withColumn("_e", filled(events)).withColumn("_s", filled(_parts("_e", "y.reach", MOST))).withColumn("_t", filled(_tops("_s", MOST)))
    free = f"filter(_e, (c, i) -> c.reach = 0 AND {_before('_e', '_t', 'y.reach', MOST)} <= c.start)"
    kept = f"CASE WHEN _e IS NULL OR _t IS NULL THEN {more} ELSE transform({free}, c -> named_struct('kind', c.kind, 'start', c.start, 'stop', c.stop)) END"
    return made.withColumn(more, F.expr(kept)).drop("_e", "_s", "_t")


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _luhn(d: str) -> str:
    """From the right, every second digit is doubled and loses 9 above 9."""
    value = f"cast(substr({d}, j, 1) AS int)"
    doubled = f"CASE WHEN (length({d}) - j) % 2 = 0 THEN {value} WHEN {value} > 4 THEN 2 * {value} - 9 ELSE 2 * {value} END"
    return f"(aggregate(sequence(1, length({d})), 0, (t, j) -> t + ({doubled})) % 10 = 0)"


def _valid(kind: str, m: str) -> str:
    """Whether a match of a base pattern is personal data of its kind."""
    bare = "trim(LEADING '0' FROM o)"
    return {
        "email": "true",
        "ip": f"forall(split({m}, '[.]'), o -> length({bare}) < 4 AND coalesce(try_cast(concat('0', left({bare}, 4)) AS int), 999) <= 255)",
        "card": f"(CASE WHEN length({_digits(m)}) BETWEEN 13 AND 19 THEN {_luhn(_digits(m))} ELSE false END)",
        "phone": f"(length({_digits(m)}) BETWEEN 9 AND 15)",
    }[kind]


def _possible(kind: str, m: str) -> str:
    """What a proposed span needs whatever the trees say: no phone number has over 15 digits."""
    return f"(length({_digits(m)}) BETWEEN 7 AND 15)" if kind == "phone" else "true"


def _flag(condition: str) -> str:
    return f"(CASE WHEN {condition} THEN 1D ELSE 0D END)"


def _features(kind: str) -> dict[str, str]:
    """SQL of a candidate ``c``'s features: its format, then its context."""
    digits, near = _digits("c.m"), "lower(concat(c.before, ' ', c.after))"
    runs = "regexp_extract_all(c.m, '[0-9]+', 0)"
    others = " OR ".join(f"regexp_like({near}, '{hint}')" for k, hint in _HINT.items() if k != kind)
    return {
        "kind": f"{KINDS.index(kind)}D",
        "length": "cast(length(c.m) AS double)",
        "digits": f"cast(length({digits}) AS double)",
        "letters": "cast(length(regexp_replace(c.m, '[^A-Za-z]', '')) AS double)",
        "marks": "cast(length(regexp_replace(c.m, '[A-Za-z0-9 ]', '')) AS double)",
        "spaces": "cast(length(regexp_replace(c.m, '[^ ]', '')) AS double)",
        "groups": f"cast(size({runs}) AS double)",
        "longest": f"cast(coalesce(array_max(transform({runs}, r -> length(r))), 0) AS double)",
        "last": f"cast(coalesce(length(try_element_at({runs}, -1)), 0) AS double)",
        "luhn": _flag(f"length({digits}) BETWEEN 13 AND 19 AND {_luhn(digits)}"),
        "hidden": _flag("regexp_like(c.m, '(?i)[(\\\\[](at|dot)[)\\\\]]| dot ')"),
        "domain": _flag("regexp_like(c.m, '(?i)(com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$')"),
        "hint": _flag(f"regexp_like({near}, '{_HINT[kind]}')"),
        "other": _flag(others),
        "code": _flag(f"regexp_like({near}, 'isbn|issn|order|invoice|serial|version|id[:= ]|no[.] ?$|page|date|time|since|from|ratio|total|mac')"),
        "year": _flag("regexp_like(c.m, '^(19|20)[0-9][0-9][ ./-]') OR regexp_like(c.m, '[ ./-](19|20)[0-9][0-9]$')"),
        "paired": _flag("regexp_like(c.m, '^[(][0-9]{2,5}[)]')"),
        "hexes": "cast(length(regexp_replace(c.m, '[^:]', '')) AS double)",
    }


FEATURES = list(_features("email"))


def _candidates(texts: DataFrame, patterns: dict[str, str], prefix: str, guard: bool) -> DataFrame:
    """``texts`` with an array of matches of each kind in ``<prefix>_<kind>``. Each step
    is a projection of its own, so no pattern runs twice over a text."""
    names = {k: f"{prefix}_{k}" for k in patterns}
    made = _with_spans(texts, patterns, names)
    rule = _valid if guard else _possible
    return made.withColumns({n: F.expr(f"filter({n}, c -> {rule(k, 'c.m')})") for k, n in names.items() if rule(k, "c.m") != "true"})


def _accepted(kind: str, column: str, limit: float) -> Column:
    """Places of the candidates of a kind that reach its threshold. The features come first,
    as an array; the trees, in the columns ``_tree_...``, walk over it."""
    rated = f"transform({column}, c -> struct(c.start AS start, c.stop AS stop, array({', '.join(_features(kind).values())}) AS x))"
    place = f"named_struct('kind', {KINDS.index(kind)}, 'start', c.start, 'stop', c.stop)"
    return F.expr(f"CASE WHEN size({column}) > 0 THEN transform(filter({rated}, c -> {Boosted.walk('c.x', '_tree')} >= {limit!r}D), c -> {place}) ELSE cast(array() AS array<{_PLACE}>) END")


def _example(r: random.Random) -> tuple[int, str]:
    """A generated line and whether what it holds is personal data."""
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice(["th", "er", "an", "le", "ou", "ein", "ch", "os", "ue", "ta"]) for _ in range(r.randint(1, 4)))
    name, host, top = f"{word()}{r.choice(['.', '_', ''])}{word()}{r.choice(['', number(2)])}", word() + word(), r.choice(["com", "org", "net", "de", "fr", "es", "io"])

    def card(valid: bool) -> str:
        d = number(r.choice([15, 16, 16, 16]) - 1)
        check = next(x for x in "0123456789" if sum((int(c) if k % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4)) for k, c in enumerate(reversed(d + x))) % 10 == 0)
        d += check if valid else str((int(check) + r.randint(1, 9)) % 10)
        sep = r.choice([".", "/", "_", "."])
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    at, dot = r.choice([("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", " (dot) "), (" at ", " dot "), (" [at] ", "."), ("(at)", ".")])
    phone = r.choice([f"({number(3)}) {number(3)}-{number(4)}", f"({number(3)}){number(3)}-{number(4)}", f"{number(3)}-{number(3)}-{number(4)}", f"{number(3)}.{number(3)}.{number(4)}", f"0{number(2)} {number(3)} {number(4)}", f"0{number(3)}/{number(7)}", f"0{number(1)} {number(2)} {number(2)} {number(2)} {number(2)}"])
    six = ":".join(f"{r.randrange(65536):x}" for _ in range(8)) if r.random() < 0.6 else f"{r.randrange(4096, 65536):x}:{r.randrange(65536):x}::{r.randrange(65536):x}:{r.randrange(65536):x}"
    good = [
        (r.choice(["mail", "contact", "write to", word()]), f"{name}{at}{host}{dot}{top}"),
        (r.choice(["phone", "tel.", "call me", "fax", "mobile"]), phone),
        (r.choice(["host", "server", "ip", word()]), six),
        (r.choice(["card", "visa", "credit card", word()]), card(True)),
    ]
    year, month, day = r.randint(1900, 2035), r.randint(1, 12), r.randint(1, 28)
    bad = [
        (word(), f"{word()} at {word()} dot {word()}"),
        (word(), f"{word()} @ {word()}.{word()}"),
        (r.choice(["date", "since", word()]), r.choice([f"{year}-{month:02}-{day:02}", f"{day:02}.{month:02}.{year}", f"{day:02}/{month:02}/{year}", f"{year} - {year + 7}"])),
        (r.choice(["isbn", "order", "id:", "serial", "no."]), r.choice([f"978-{number(1)}-{number(4)}-{number(4)}-{number(1)}", number(10), f"{number(3)}-{number(3)}-{number(4)}", f"{number(4)}-{number(6)}"])),
        (word(), r.choice([number(8), number(12), number(r.randint(9, 20)), number(r.randint(13, 19)), f"{number(4)} {number(4)}", f"{number(2)} {number(3)} {number(3)}", f"{number(5)}.{number(5)}", f"{number(3)}-{number(5)}", f"{number(7)}"])),
        (r.choice(["time", "at", word()]), f"{r.randint(0, 23):02}:{r.randint(0, 59):02}:{r.randint(0, 59):02}"),
        (r.choice(["mac", "ratio", word()]), r.choice([":".join(f"{r.randrange(256):02x}" for _ in range(6)), f"{r.randint(1, 20)}:{r.randint(1, 20)}:{r.randint(1, 20)}"])),
        (word(), card(False)),
    ]
    label = int(r.random() < 0.5)
    lead, text = r.choice(good if label else bad)
    before, after = " ".join(word() for _ in range(r.randint(0, 3))), " ".join(word() for _ in range(r.randint(0, 3)))
    return label, f"{before} {lead}{r.choice([' ', ': '])}{text} {after}".strip()


_FITTED: dict[int, tuple[Boosted, dict[str, float]]] = {}


def fit(spark: SparkSession, seed: int = 11) -> tuple[Boosted, dict[str, float]]:
    """The trees and each kind's threshold: the lowest score above which ``PRECISION`` of
    the calibration examples are personal data, and one half at least. Fitted once."""
    if seed not in _FITTED:
        _FITTED[seed] = _fit(spark, seed)
    return _FITTED[seed]


def examples(spark: SparkSession, seed: int, many: int = EXAMPLES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and labels of the candidates in generated lines, and the number of the line."""
    r = random.Random(seed)
    lines = "\n".join(f"{label}\t{text}" for label, text in (_example(r) for _ in range(many)))
    rows = spark.range(1).select(F.posexplode(F.split(F.lit(lines), "\n")).alias("at", "line"))
    rows = rows.select("at", F.substring("line", 1, 1).cast("int").alias("label"), F.expr("substr(line, 3)").alias("text"))
    made = _candidates(rows, PROPOSED, "p", guard=False)
    parts = [F.expr(f"transform(p_{k}, c -> array({', '.join(_features(k).values())}))") for k in KINDS]
    found = made.select("at", "label", F.explode(F.concat(*parts)).alias("x")).collect()  # as many as examples give
    found.sort(key=lambda row: (row["at"], row["x"]))
    return np.array([row["x"] for row in found]), np.array([float(row["label"]) for row in found]), np.array([row["at"] for row in found])


def _fit(spark: SparkSession, seed: int) -> tuple[Boosted, dict[str, float]]:
    x, y, at = examples(spark, seed)
    model = Boosted().fit(x[at % 2 == 0], y[at % 2 == 0]).calibrate(x[at % 2 == 1], y[at % 2 == 1])
    limits, p = {}, model.probability(x)
    for k, kind in enumerate(KINDS):
        own = (x[:, 0] == k) & (at % 2 == 1)
        order = np.argsort(-p[own], kind="stable")
        right = np.cumsum(y[own][order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(right >= PRECISION)
        limits[kind] = max(0.5, float(p[own][order][good[-1]])) if len(good) else 1.01
    return model, limits


def _fenced(c: Column) -> Column:
    """``c``, such that a filter on it stays above its projection: moved below, it would repeat
    the whole expression, and that for each column that the expression names."""
    return F.when(F.monotonically_increasing_id() >= 0, c)


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` as the struct ``doc`` with ``base`` and ``spans``, arrays of kind (number
    in ``KINDS``), start and stop (code points, stop exclusive) of its whole text, in that
    order. ``spans`` holds the base spans, and accepted candidates that overlap neither
    them nor one of an earlier kind. A null text is empty and has no spans; repeated rows
    are returned each."""
    model, limits = fit(docs.sparkSession)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    made = _candidates(_candidates(rows, BASE, "b", guard=True), PROPOSED, "p", guard=False)
    place = lambda k, c: f"named_struct('kind', {k}, 'start', {c}.start, 'stop', {c}.stop)"
    base = "concat(" + ", ".join(f"transform(b_{kind}, c -> {place(k, 'c')})" for k, kind in enumerate(KINDS)) + ")"
    made = made.withColumns(model.columns("_tree") | {"base": F.expr(base), "taken": F.expr(base)})
    made = made.withColumns({f"p_{kind}": _accepted(kind, f"p_{kind}", limits[kind]) for kind in KINDS})
    for kind in KINDS:
        made = _free(made, "taken", f"p_{kind}").withColumn("taken", F.expr(f"concat(taken, p_{kind})"))
    return made.select("doc", "text", _fenced(F.col("base")).alias("base"), _fenced(F.array_sort("taken")).alias("spans"))


def _joined(spans: str) -> Column:
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, c -> concat(get({kinds}, c.kind), ':', c.start, ':', c.stop)), ',')")


def _pieces(text: str) -> str:
    """SQL for a text in pieces of ``PIECE`` code points: first in large ones, as finding a
    place in a text takes its length."""
    large = 64 * PIECE
    cut = lambda t, many: f"transform(sequence(0, cast(greatest(length({t}) - 1, 0) div {many} AS int)), i{many} -> substr({t}, i{many} * {many} + 1, {many}))"
    return f"flatten(transform({cut(text, large)}, t -> {cut('t', PIECE)}))"


def _cut(start: str, stop: str) -> str:
    """SQL for the code points from ``start`` to before ``stop`` out of the column ``pieces``."""
    of = lambda place: f"cast({place} div {PIECE} AS int)"
    return f"""CASE WHEN {start} >= {stop} THEN '' WHEN {of(start)} = {of(stop)} THEN substr(get(pieces, {of(start)}), {start} % {PIECE} + 1, {stop} - {start})
        ELSE concat(substr(get(pieces, {of(start)}), {start} % {PIECE} + 1), array_join(slice(pieces, {of(start)} + 2, {of(stop)} - {of(start)} - 1), ''), coalesce(left(get(pieces, {of(stop)}), {stop} % {PIECE}), '')) END"""


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of personal data in ``text`` replaced by its kind in
    brackets; spans that overlap become one, named after the first. ``n_chars`` follows
    the text where there is such a column; other columns stay as they are; a null text
    stays null."""
    names = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    filled = lambda sql: F.expr(f"CASE WHEN size(spans) > 0 THEN {sql} END")
    made = with_spans(docs).withColumn("spans", F.expr("array_sort(transform(spans, c -> named_struct('start', c.start, 'back', -c.stop, 'kind', c.kind)))"))
    made = made.withColumn("pieces", filled(_pieces("text"))).withColumn("_s", filled(_parts("spans", "-y.back", MOST))).withColumn("_t", filled(_tops("_s", MOST)))
    made = made.withColumn("_ends", F.expr(f"CASE WHEN _t IS NOT NULL THEN transform(spans, (c, i) -> {_before('spans', '_t', '-y.back', MOST)}) END"))
    # Each span from the furthest end before it: no name within another.
    parts = f"transform(spans, (c, i) -> CASE WHEN c.start < get(_ends, i) THEN '' ELSE concat({_cut('get(_ends, i)', 'c.start')}, get({names}, c.kind)) END)"
    made = made.withColumn("_last", filled("greatest(element_at(_ends, -1), -element_at(spans, -1).back)"))
    joined = f"CASE WHEN size(spans) = 0 THEN text ELSE concat(array_join({parts}, ''), {_cut('_last', 'length(text)')}) END"
    made = made.withColumn("clean", F.expr(f"CASE WHEN doc.text IS NOT NULL THEN {joined} END"))
    made = made.select("doc", _fenced(F.col("clean")).alias("clean"))
    changed = {"text": F.col("clean"), "n_chars": F.coalesce(F.length("clean").cast("long"), F.col("doc.n_chars") if "n_chars" in docs.columns else F.lit(0))}
    return made.select(*(changed[c].alias(c) if c in changed else F.col(f"doc.`{c}`") for c in docs.columns))


def personal_data(docs: DataFrame) -> DataFrame:
    """Spans of every row's whole text as digests; see ``with_spans``. Other columns are
    ignored, and an empty table gives an empty result."""
    made = with_spans(docs.select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(base, c -> c.kind = {k})) AS long) AS n_{kind}") for k, kind in enumerate(KINDS)]
    return made.select(F.col("doc.doc_id").cast("long").alias("doc_id"), *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def op6_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts, base digest and all spans."""
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
