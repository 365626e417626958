"""Repair of conversations, against a plain version that works from the last row back."""

import hashlib
import random
import re
import zlib
from functools import cache

import duckdb
import pyarrow as pa
import pytest

from wayfold.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, kind string, h string, audit string"
SPACE = " \t\n\v\f\r"


def least(rows):
    """Least (cost, audit) of rows (initial, fault), from the last row back: the audits of
    what follows are compared whole, letter by letter from the front."""
    follows = {"": "us", "s": "u", "u": "a", "a": "u"}

    @cache
    def best(i, state, inserted=0):
        ways = []
        if i == len(rows):
            if state in ("", "a"):
                ways.append((0, ""))
        else:
            initial, fault = rows[i]
            cost, audit = best(i + 1, state)
            ways.append((3 + cost, "D" + audit))
            for wanted in follows[state] if fault not in ("blank", "duplicate") else "":
                worse = fault == "truncated"
                cost, audit = best(i + 1, wanted)
                if initial == wanted:
                    ways.append((worse + cost, "K" + audit))
                elif wanted != "s":
                    ways.append((2 + worse + cost, "R" + audit))
        if inserted < 3:
            for wanted in follows[state].replace("s", ""):
                cost, audit = best(i, wanted, inserted + 1)
                ways.append((2 + cost, "I" + audit))
        return min(ways, default=(1 << 30, ""))

    return best(0, "")


def twin(table):
    convs = {}
    for conv, turn, role, text in table:
        own = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    told = []
    for conv, rows in convs.items():
        key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{'-' if conv is None else conv}:{len(r[1])}:{r[1]}:{r[2]}".encode()).hexdigest())  # noqa: B023,E731
        rows.sort(key=key)
        seen, faults = set(), []
        for _, role, text in rows:
            solid = text.strip(SPACE)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in rows if t is not None}
        cost, audit = least(tuple((r[1][:1], f) for r, f in zip(rows, faults, strict=True)))
        lines, last, i = [], "", 0
        for letter in audit:
            role, text = ("user" if last != "u" else "assistant"), ""
            if letter != "I":
                role, text = rows[i][1] if letter == "K" else role, rows[i][2]
                i += 1
            if letter != "D":
                lines.append(f"{role}:{text}")
                last = role[0]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
        told.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(told, key=repr)


def table():
    r = random.Random(2)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "u"]
    texts = ["Hi.", "Well", "what?\n", "", " \t", None, "no. end", "fine!", "x."]
    made = [(c, t + (t > 5) * c % 3, r.choice(roles), r.choice(texts) if r.random() < 0.4 else f"{r.random()}{r.choice(['.', '', '! '])}") for c in range(250) for t in range(r.randrange(1, 12))]
    made += [(c, r.choice([None, 0, 1, 2, 2]), r.choice(roles[:4]), r.choice(texts)) for c in (300, 301, 302, None) for _ in range(9)]
    made += [(400, t, ["user", "assistant", "system"][r.randrange(7) % 3], f"{t}.") for t in range(300)] + [(401, 3, "user", "Same.")] * 40 + [(402, t, "user", "Again.") for t in range(60)]
    return made + [(500 + i, 0, "user", "Hi.") for i in range(60)] + [(c, 0, "system", "S.") for c in range(250)]


@pytest.mark.parametrize("piece", [4, conversations.PIECE])
def test_repairs_are_the_twins(spark, monkeypatch, piece):
    monkeypatch.setattr(conversations, "PIECE", piece)
    made = table()
    rows = spark.createDataFrame([(*x, "e", "e", "e") for x in made], SCHEMA).repartition(3)
    got = conversations.repaired(rows).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    told = sorted(map(tuple, got.collect()), key=repr)
    want = twin(made)
    assert len(told) == len(want) and [x for x in zip(told, want, strict=True) if x[0] != x[1]] == []


def test_charts_are_least_from_the_back():
    r = random.Random(8)
    faults = ["", "truncated", "duplicate"]
    for n in [*range(7)] * 150:
        rows = tuple((r.choice("suaas?"), r.choice(faults[: 2 + (r.random() < 0.5)])) for _ in range(n))
        classes = bytes(3 * min("sua?".index(i), 3) + ["", "truncated", "duplicate"].index(f) for i, f in rows)
        assert conversations.completed(conversations.parsed(classes)) == least(rows), rows
        cut = r.randrange(n + 1)
        whole = conversations.chained(conversations.parsed(classes[:cut]), {e: conversations.parsed(classes[cut:], e) for e in conversations.SCANNED})
        assert conversations.completed(whole) == least(rows)


def test_sql_is_the_twin():
    rows, db = table(), duckdb.connect()
    columns = {n: pa.array([r[i] for r in rows], pa.int64() if i < 2 else pa.string()) for i, n in enumerate(("conv_id", "turn", "role", "text"))}
    db.register("conversations", pa.table(columns))
    assert sorted(db.execute(conversations.ORACLE_SQL).fetchall(), key=repr) == twin(rows)


def test_charts_take_linear_time():
    r = random.Random(1)
    cost, audit = conversations.completed(conversations.parsed(bytes(r.randrange(12) for _ in range(300_000))))
    assert cost > 0 and len(audit) >= 300_000
    assert conversations.advanced.cache_info().currsize < 5000


def test_no_conversations(spark):
    assert conversations.repaired(spark.createDataFrame([], SCHEMA)).collect() == []
