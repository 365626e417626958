"""Repair of conversations by error-correcting Earley parsing.

A conversation is a string of roles. A grammar says which strings are sound, and error
productions let the parser keep a row (its role is the wanted one), rerole it, delete it or
insert one, each at a cost. Chart items retain the least (cost, audit), where the audit
spells the edits; the completed chart yields the repair.

Every rule of the grammar has its nonterminal in front, so all items start at the beginning
of the conversation, and a chart set is the items that were just scanned. What follows a
set depends only on its items, the differences of their costs and the order of their
audits, and on the class of the next row; there are few of these, so each is worked out
once. A chart then takes constant time and a reference a row, whatever its length.

Rows are sorted by conversation and turn over all tasks, so one long conversation is
parsed in several pieces: a piece that may start within a conversation is parsed from each
item that may stand there, and pieces are chained afterwards.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import cache
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.shared import keep, shared_folder, short_batches

#: Roles by their initials: ``(s?(ua)+)?``. A symbol that is no key is a terminal.
GRAMMAR = {"Goal": [[], ["Turns"]], "Turns": [["Open", "a"]], "Open": [["Head", "u"], ["Turns", "u"]], "Head": [[], ["s"]]}
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
RULES = [(left, tuple(right)) for left, rights in GRAMMAR.items() for right in rights]
#: An item that costs more than another by this is on no cheapest way: two insertions and the
#: deletion of a leading row let the other take its place.
SLACK = 2 * INSERT + DELETE
#: The item of a chart in which nothing stands yet.
START = -1
#: Items that a scan leaves: rules with the dot behind a terminal.
SCANNED = (START, *(r for r, (_, right) in enumerate(RULES) if right and right[-1] not in GRAMMAR))
#: Classes of a row: place of its initial in ``sua`` (3: none of them), times 3, plus 0 for
#: a sound one, 1 for a truncated one, 2 for one that has to go.
INITIALS = "sua"
#: Rows of a piece at most; bounds the audits that a task hands on.
PIECE = 16_384


class Reached(NamedTuple):
    """Least way to an item: its cost, the rank of the audit it goes on from, the letters
    since, and the item it goes on from."""

    cost: int
    rank: int
    letters: str
    source: int


#: A chart set: item, cost above the least, rank of its audit among those of the set.
ChartSet = tuple[tuple[int, int, int], ...]


def closed(start: ChartSet) -> dict[tuple[int, int], Reached]:
    """All items (rule, dot) that follow from a set without reading a row: predicted ones,
    completed ones and insertions, each with its least (cost, audit)."""
    found: dict[tuple[int, int], Reached] = {}
    heap: list[tuple[Reached, tuple[int, int]]] = []

    def add(way: Reached, rule: int, dot: int) -> None:
        heapq.heappush(heap, (way, (rule, dot)))

    for item, cost, rank in start:
        way = Reached(cost, rank, "", item)
        if item == START:  # predicted: what stands at the beginning and needs no nonterminal before it
            for r, (_, right) in enumerate(RULES):
                if not right or right[0] not in GRAMMAR:
                    add(way, r, 0)
        else:
            add(way, item, len(RULES[item][1]))
    while heap:
        way, (r, dot) = heapq.heappop(heap)
        if (r, dot) in found:
            continue
        found[r, dot] = way
        left, right = RULES[r]
        if dot == len(right):
            for other, (_, wants) in enumerate(RULES):
                if wants and wants[0] == left:
                    add(way, other, 1)
        elif right[dot] in ROLES:
            add(way._replace(cost=way.cost + INSERT, letters=way.letters + "I"), r, dot + 1)
    return found


@cache
def advanced(start: ChartSet, row: int) -> tuple[ChartSet, int, dict[int, tuple[int, str]]]:
    """The set after a row of class ``row``, by how much the least cost grew, and for each
    item of it the item before and the letters between."""
    initial, fault = INITIALS[row // 3 : row // 3 + 1], row % 3
    reached: dict[int, Reached] = {}

    def offer(item: int, way: Reached, cost: int, letter: str) -> None:
        way = way._replace(cost=way.cost + cost, letters=way.letters + letter)
        if item not in reached or way < reached[item]:
            reached[item] = way

    for (r, dot), way in closed(start).items():
        right = RULES[r][1]
        if dot == len(right) and r in SCANNED:
            offer(r, way, DELETE, "D")
        if fault < 2 and dot < len(right) and right[dot] not in GRAMMAR:
            worse = TRUNCATED * (fault == 1)
            if right[dot] == initial:
                offer(r, way, KEEP + worse, "K")
            elif right[dot] in ROLES:
                offer(r, way, REROLE + worse, "R")
    for item, cost, rank in start:
        if item == START:
            offer(START, Reached(cost, rank, "", START), DELETE, "D")
    least = min(way.cost for way in reached.values())
    reached = {item: way for item, way in reached.items() if way.cost - least <= SLACK}
    ranks = {audit: k for k, audit in enumerate(sorted({(w.rank, w.letters) for w in reached.values()}))}
    after = tuple((item, w.cost - least, ranks[w.rank, w.letters]) for item, w in sorted(reached.items()))
    return after, least, {item: (w.source, w.letters) for item, w in reached.items()}


def parsed(rows: bytes, entry: int = START) -> dict[int, tuple[int, str]]:
    """Least (cost, audit) of every item after rows of the given classes, from one item on."""
    now: ChartSet = ((entry, 0, 0),)
    total, back = 0, []
    for row in rows:
        now, more, ways = advanced(now, row)
        total += more
        back.append(ways)
    told = {}
    for item, cost, _ in now:
        at, letters = item, []
        for ways in reversed(back):
            at, own = ways[at]
            letters.append(own)
        told[item] = (total + cost, "".join(reversed(letters)))
    return told


def chained(before: dict[int, tuple[int, str]], piece: dict[int, dict[int, tuple[int, str]]]) -> dict[int, tuple[int, str]]:
    """Ways to items, and the ways on from each of them, in one."""
    told: dict[int, tuple[int, str]] = {}
    for item, (cost, audit) in before.items():
        for end, (more, rest) in piece[item].items():
            told[end] = min(told.get(end, (1 << 62, "")), (cost + more, audit + rest))
    return told


def completed(ways: dict[int, tuple[int, str]]) -> tuple[int, str]:
    """Least (cost, audit) of a chart whose goal is complete."""
    told = []
    for item, (cost, audit) in ways.items():
        for (r, dot), way in closed(((item, 0, 0),)).items():
            if RULES[r][0] == "Goal" and dot == len(RULES[r][1]):
                told.append((cost + way.cost, audit + way.letters))
    return min(told)


class Repaired:
    """Repaired lines by an audit, row by row; holds no more than the line at hand."""

    def __init__(self, audit: str) -> None:
        self.letters, self.last = iter(audit), ""

    def _role(self, kept: str | None = None) -> str:
        self.last = kept[0] if kept else "a" if self.last == "u" else "u"
        return kept or ROLES[self.last]

    def lines(self, role: str | None, text: str | None) -> Iterator[str]:
        """Insertions before a row and what becomes of it; a null role: the rest."""
        for letter in self.letters:
            if letter == "I":
                yield f"{self._role()}:"
                continue
            if letter == "K":
                yield f"{self._role(role)}:{text}"
            elif letter == "R":
                yield f"{self._role()}:{text}"
            return


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` after damage by the CRC-32 of
    ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 takes ``.!?`` out of
    it, 3 repeats the row, 4 sets its role to user. A null role or text counts as one
    space, and so does a null id or turn in the string."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), one("role").alias("role"), one("text").alias("text"))
    kind = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    rows = rows.withColumn("_kind", kind).where("_kind <> 0")
    rows = rows.withColumn("text", F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("_again", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_kind", "_again")


ORDER = ["conv_id", "turn", "role", "h"]
PIECES = "conv_id long, named boolean, part int, piece int, first string, last string, low long, high long, turns long, low_turn long, blank long, duplicate long, truncated long, illegal long, ways string"
AUDITS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
REPAIRS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, KINDS[k]) for n, k in (x.split() for x in ddl.split(", "))])


def _rows(batches) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns), strict=True)


def _batches(rows: Iterator[tuple], ddl: str, most: int) -> Iterator[pa.RecordBatch]:
    schema, held = _schema(ddl), []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in held], schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in held], schema)


def _digest() -> Column:
    role_length = F.length("role").cast("string")
    return F.md5(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), role_length, "role", "text"))


def marked(rows: DataFrame, folder: str) -> DataFrame:
    """Rows after damage without their texts, equal rows once with their number: ``conv_id``,
    ``turn``, ``role``, digest ``h`` of conversation, role and text, ``copies``, and whether
    they are ``blank``, ``cut`` (truncated) or have the role and text of an ``earlier`` turn."""
    solid = r"[^\x20\x09-\x0D]"
    blank = ~F.col("text").rlike(solid)
    cut = ~F.col("text").rlike(rf"[.!?][\x20\x09-\x0D]*\z")
    counted = rows.select("conv_id", "turn", "role", _digest().alias("h"), blank.alias("blank"), cut.alias("cut"))
    counted = keep(counted.groupBy(*ORDER, "blank", "cut").agg(F.count("*").alias("copies")), folder, "counted")
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = keep(counted.groupBy("h").agg(F.min(order).alias("first")), folder, "first")
    return counted.join(first, "h").select(*ORDER, "blank", "cut", "copies", (order > F.col("first")).alias("earlier"))


def _piece(rows: list[tuple], entries: tuple[int, ...]) -> tuple:
    """Counts and ways of a run of rows of one conversation."""
    classes, blanks, repeats, cuts, illegal, last, turns = bytearray(), 0, 0, 0, 0, None, []
    for _, turn, role, _, blank, cut, copies, earlier in rows:
        own = 3 * (INITIALS.index(role[0]) if role and role[0] in INITIALS else 3)
        gone = blank or earlier
        blanks += copies * blank
        repeats += 0 if blank else copies - (not earlier)
        cuts += not gone and cut
        classes += bytes([own + 2 if gone else own + bool(cut)]) + bytes([own + 2]) * (copies - 1)
        initial = role[:1]
        illegal += (last is not None and last + initial not in ("su", "ua", "au")) + (copies - 1) * (initial + initial not in ("su", "ua", "au"))
        last = initial
        if turn is not None and (not turns or turns[-1] != turn):
            turns.append(turn)
    ways = {entry: parsed(bytes(classes), entry) for entry in entries}
    told = ";".join(f"{a},{b},{cost},{audit}" for a, ends in ways.items() for b, (cost, audit) in ends.items())
    return rows[0][2][:1], last, min(turns, default=None), max(turns, default=None), len(turns), turns[0] if turns else None, blanks, repeats, cuts, illegal, told


def pieces(rows: DataFrame) -> DataFrame:
    """Sorted runs of :func:`marked` rows: their counts, and the least ways through them. A
    run at the start of a task, or after another piece of its conversation, is parsed from
    every item, the others from the beginning."""
    from pyspark import TaskContext

    def run(batches):
        def made():
            part, nth = TaskContext.get().partitionId(), 0
            for conv, own in groupby(_rows(batches), key=lambda x: x[0]):
                held, entries, size = [], SCANNED if nth == 0 else (START,), 0
                for row in own:
                    copies = row[6]
                    while size + copies > PIECE:  # many copies of one row are cut too
                        if take := PIECE - size:
                            held.append((*row[:6], take, row[7]))
                            copies -= take
                            row = (*row[:6], copies, True)
                        yield (conv, conv is not None, part, nth, *_piece(held, entries))
                        held, entries, size, nth = [], SCANNED, 0, nth + 1
                    held.append(row)
                    size += copies
                if held:
                    yield (conv, conv is not None, part, nth, *_piece(held, entries))
                    nth += 1

        return _batches(made(), PIECES, 32)

    columns = [*ORDER, "blank", "cut", "copies", "earlier"]
    return rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).select(*columns).mapInArrow(run, PIECES)


def audits(made: DataFrame) -> DataFrame:
    """One row a conversation: its counts, and the least cost with its audit, from its pieces
    in order. What is held of a conversation is one way an item."""

    def run(batches):
        def told():
            for _, own in groupby(_rows(batches), key=lambda x: (x[0], x[1])):
                ways, last, low, high, turns, sums = {START: (0, "")}, None, None, None, 0, [0] * 4
                for conv, _, _, _, first, end, lo, hi, n, first_turn, *counts, text in own:
                    piece: dict[int, dict[int, tuple[int, str]]] = {}
                    for a, b, cost, audit in (x.split(",") for x in text.split(";")):
                        piece.setdefault(int(a), {})[int(b)] = (int(cost), audit)
                    ways = chained(ways, piece)
                    sums = [x + y for x, y in zip(sums, counts, strict=True)]
                    sums[3] += last is not None and last + first not in ("su", "ua", "au")
                    last = end
                    if n:
                        turns += n - (high is not None and high == first_turn)
                        low, high = lo if low is None else low, hi
                cost, audit = completed(ways)
                yield (conv, 0 if low is None else high - low + 1 - turns, *sums, cost, audit)

        return _batches(told(), AUDITS, 32)

    order = ["conv_id", "named", "part", "piece"]
    return made.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, AUDITS)


def repaired(conversations: DataFrame) -> DataFrame:
    """Faults, least edits and the repaired text of every ``conv_id`` of ``conversations``
    (``conv_id``, ``turn``, ``role``, ``text``) after :func:`damaged`.

    Rows stand by turn, nulls first; rows of one turn by role and text digest, so equal ones
    are adjacent. The first fault of a row counts: blank, duplicate (role and text were
    there before), truncated. Edits keep a row (0), rerole it (2) or delete it (3, required
    if it is blank or a duplicate) or insert one without text (2); a truncated row that
    stays adds 1. The audit spells the cheapest edits (K, R, D, I), the ASCII-least of those;
    the repaired text is hashed line by line (``role:text``). ``gaps`` are turns that lack
    between the first and the last. A null conv_id is a conversation like any other; one
    without rows has zeros, an empty audit and the hash of nothing. Only the hash takes a
    whole conversation one row after the other, as SHA-256 does; it streams.
    """
    folder = shared_folder(conversations.sparkSession)
    rows = damaged(conversations)
    with short_batches(conversations.sparkSession, 64):
        made = keep(pieces(keep(marked(rows, folder), folder, "marked")), folder, "pieces")
        found = keep(audits(made), folder, "audits")
    names = [x.split()[0] for x in AUDITS.split(", ")]
    nothing = [F.lit(None).cast("string").alias(x) for x in ("role", "h", "text")]
    ids = conversations.select(F.col("conv_id").cast("long")).distinct()
    blank = [F.lit(0).cast("long").alias(x) for x in names[1:7]]
    # A conversation's id comes first, then its audit, then its rows in order.
    every = ids.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), *nothing, *blank, F.lit("").alias("audit"))
    told = found.select("conv_id", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("turn"), *nothing, *names[1:])
    texts = rows.select("conv_id", F.lit(2).alias("kind"), "turn", "role", _digest().alias("h"), "text", *blank, F.lit("").alias("audit"))

    def run(batches):
        def hashed():
            for conv, own in groupby(_rows(batches), key=lambda x: x[0]):
                told, repair, sha, between = (0,) * 6 + ("",), Repaired(""), hashlib.sha256(), b""
                for _, kind, role, text, *rest in own:
                    if kind == 1:
                        told, repair = tuple(rest), Repaired(rest[-1])
                    elif kind == 2:
                        for line in repair.lines(role, text):
                            sha.update(between + line.encode())
                            between = b"\n"
                for line in repair.lines(None, None):
                    sha.update(between + line.encode())
                    between = b"\n"
                yield (conv, *told, sha.hexdigest())

        return _batches(hashed(), REPAIRS, 256)

    order = ["conv_id", "kind", "turn", "role", "h"]
    whole = every.union(told).union(texts).repartition("conv_id").sortWithinPartitions(*order)
    with short_batches(conversations.sparkSession, 1024):
        return keep(whole.select("conv_id", "kind", "role", "text", *names[1:]).mapInArrow(run, REPAIRS), folder, "repaired")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and least repair of every conversation, after damage."""
    return repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def _oracle() -> str:
    """The same in SQL: CRC-32 by its table, then the least (cost, audit) of each of four states (``e``
    nothing yet, ``s``, ``u``, ``a`` the last initial) row by row."""
    way = lambda state, cost, letters: f"{{'c': w.{state}.c + {cost}, 'a': w.{state}.a || '{letters}'}}"
    never = "{'c': 1000000000, 'a': ''}"

    def read(role: str, before: list[str], state: str, lead: str, paid: int) -> list[str]:
        """Ways that take the row as ``role``: it is kept or reroled."""
        keeps = [f"CASE WHEN x.fault < 2 AND x.initial = '{role}' THEN {way(p, f'{paid} + x.fault', lead + 'K')} ELSE {never} END" for p in before]
        turns = [f"CASE WHEN x.fault < 2 AND x.initial <> '{role}' THEN {way(p, f'{paid + REROLE} + x.fault', lead + 'R')} ELSE {never} END" for p in before]
        return [*keeps, *(turns if role in ROLES else [])]

    after = {
        "e": [],
        "s": read("s", ["e"], "s", "", 0),
        "u": read("u", ["e", "s", "a"], "u", "", 0) + read("u", ["u"], "u", "I", INSERT),
        "a": read("a", ["u"], "a", "", 0) + read("a", ["e", "s", "a"], "a", "I", INSERT),
    }
    steps = ", ".join(f"list_min([{', '.join([way(s, DELETE, 'D'), *ways])}]) AS {s}" for s, ways in after.items())
    space = r"\x20\x09-\x0D"
    return f"""
WITH RECURSIVE tab AS (SELECT list(list_reduce([i] || range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
told AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
crc AS (SELECT *, xor(list_reduce([4294967295] || list_transform(string_split(k, ''), lambda c: ord(c)::BIGINT), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS kind FROM told, tab),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS again FROM crc WHERE kind <> 0),
digest AS (SELECT *, md5(coalesce(conv_id::VARCHAR, '-') || ':' || length(role) || ':' || role || ':' || text) AS h FROM hurt),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, h, again) AS n, left(role, 1) AS initial FROM digest),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS nth, lag(initial) OVER (PARTITION BY conv_id ORDER BY n) AS prior FROM numbered),
rows_ AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^{space}]') THEN 2 WHEN nth > 1 THEN 3 WHEN NOT regexp_matches(text, '[.!?][{space}]*\\z') THEN 1 ELSE 0 END AS fault FROM seen),
walk AS (SELECT conv_id, 0::BIGINT AS n, {{'c': 0, 'a': ''}} AS e, {never} AS s, {never} AS u, {never} AS a FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT w.conv_id, x.n, {steps} FROM walk w JOIN rows_ x ON x.conv_id IS NOT DISTINCT FROM w.conv_id AND x.n = w.n + 1),
ends AS (SELECT w.conv_id, list_min([w.e, w.a, {way('u', INSERT, 'I')}, {way('s', 2 * INSERT, 'II')}]) AS best FROM walk w JOIN (SELECT conv_id, max(n) AS n FROM walk GROUP BY 1) m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.n = w.n),
letters AS (SELECT conv_id, unnest(string_split(best.a, '')) AS letter, generate_subscripts(string_split(best.a, ''), 1) AS i FROM ends WHERE best.a <> ''),
places AS (SELECT *, sum(CASE WHEN letter <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) AS n, sum(CASE WHEN letter <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) AS k FROM letters),
kept AS (SELECT p.conv_id, p.i, p.k, CASE WHEN p.letter = 'K' THEN x.role END AS own, CASE WHEN p.letter = 'I' THEN '' ELSE x.text END AS text,
    bool_or(p.letter = 'K' AND p.k = 1 AND x.initial = 's') OVER (PARTITION BY p.conv_id) AS led FROM places p LEFT JOIN rows_ x ON x.conv_id IS NOT DISTINCT FROM p.conv_id AND x.n = p.n WHERE p.letter <> 'D'),
text_ AS (SELECT conv_id, string_agg(coalesce(own, CASE WHEN (k + led::INTEGER) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY i) AS whole FROM kept GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 2) AS blank, count(*) FILTER (fault = 3) AS duplicate, count(*) FILTER (fault = 1) AS truncated,
    count(*) FILTER (prior || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY conv_id)
SELECT e.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, e.best.c::BIGINT AS cost, e.best.a AS audit, sha256(coalesce(t.whole, '')) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN text_ t ON t.conv_id IS NOT DISTINCT FROM e.conv_id
"""


ORACLE_SQL = _oracle()
