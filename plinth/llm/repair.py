"""Conversation structure repair by lightest derivation.

A conversation is well formed if the initials of its roles read s?(ua)+, or if it is empty. Its rows are kept, reroled or deleted,
and turns are inserted, at a cost each; what is looked for is the cheapest way, and of the cheapest the one whose edits' initials
come first. As deductions: ``(i, q)`` says that the first i rows are dealt with and the turns put out so far leave the grammar in
state q; each edit derives an item from one item, with a weight (cost, letter). ``agenda`` is Knuth's: items wait in a heap, and
the least is final when it is popped, as every deduction is superior: it raises the cost, or keeps it and takes a row more. Two
derivations of one item that cost the same have unlike letters somewhere before either ends (equal letters from one state are
equal edits), so appending keeps their order, and the order (cost, audit) is monotone, too.

Conversations may have any length. Rows are sorted over all tasks by conversation and turn; a task solves the conversations that
lie wholly in it, one by one. What crosses a task's edge, or is longer than a block, is solved block by block from every state
to every state: a block is itself a deduction from (block, q) to (block + 1, q'), and chains of blocks are joined the same way.
Equal rows are counted before anything is sorted, and what was said first is found by a minimum and a join, so neither a long
conversation nor a text that is said a million times is gathered anywhere.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from plinth.llm.common import prepare, tidy
from plinth.session import staged

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
#: States of the grammar: nothing yet, after a system turn, after a user's, after an assistant's; the first and last may end.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, ENDS = (0, 1, 2, 3), (0, 3)
#: The role that a reroled or inserted turn has in each state.
NEXT_ROLE = {0: "user", 1: "user", 2: "assistant", 3: "user"}
LEGAL = ("su", "ua", "au")
#: Rows and bytes of a block, at most (a longer row is alone).
BLOCK_ROWS, BLOCK_BYTES = 512, 4 << 20

FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
_WORDY = re.compile("[^\x20\x09-\x0d]")
_EMPTY = hashlib.sha256().hexdigest()

Row = tuple[str, str, int]  # role, text, fault


def agenda(rows: list[Row], start: int, ends: tuple[int, ...] | None) -> dict[int, tuple[int, str]]:
    """{state: (cost, audit)} of the lightest derivations over all rows from state ``start``: for each state that is reached, or, where
    ``ends`` are named, for the first of these that is final."""
    heap: list[tuple[int, int, str, int]] = [(0, 0, "", start)]
    final, found, many = set(), {}, len(rows)
    while heap:
        cost, i, audit, state = heapq.heappop(heap)
        if (i, state) in final:
            continue
        final.add((i, state))
        if i == many:
            if ends is None:
                found[state] = (cost, audit)
            elif state in ends:
                return {state: (cost, audit)}
        made = STEPS[state, NEXT_ROLE[state][0]]
        if (i, made) not in final:
            heapq.heappush(heap, (cost + INSERT_COST, i, audit + INSERT, made))
        if i == many:
            continue
        role, _, fault = rows[i]
        heapq.heappush(heap, (cost + DELETE_COST, i + 1, audit + DELETE, state))
        if fault in (BLANK, DUPLICATE):
            continue
        more = cost + TRUNCATED_COST * (fault == TRUNCATED)
        kept = STEPS.get((state, role[:1]))
        if kept is not None:
            heapq.heappush(heap, (more, i + 1, audit + KEEP, kept))
        heapq.heappush(heap, (more + REROLE_COST, i + 1, audit + REROLE, made))
    return found


class Rewriter:
    """Rows and letters of an audit to repaired turns, one after another, and their hash."""

    def __init__(self):
        self.state, self.hash, self.first = 0, hashlib.sha256(), True

    def turn(self, role: str, text: str, edit: str) -> tuple[str, str, str]:
        self.hash.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
        self.state, self.first = STEPS[self.state, role[:1]], False
        return role, text, edit

    def edits(self, letters: Iterator[str], row: Row | None) -> Iterator[tuple[str, str, str]]:
        """The turns up to and including ``row``'s; the rest of the letters where there is no row left."""
        for letter in letters:
            if letter == INSERT:
                yield self.turn(NEXT_ROLE[self.state], "", letter)
                continue
            if letter != DELETE:
                yield self.turn(row[0] if letter == KEEP else NEXT_ROLE[self.state], row[1], letter)
            return


def _fault(text: str, seen: bool) -> int:
    if not _WORDY.search(text):
        return BLANK
    if seen:
        return DUPLICATE
    return FINE if text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")[-1] in ".!?" else TRUNCATED


def _illegal(rows: list[Row]) -> int:
    return sum(a[0][:1] + b[0][:1] not in LEGAL for a, b in zip(rows, rows[1:]))


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_SOLVED = "kind string, conv {kind}, part int, block int, pos bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, hash string, role string, text string, costs array<bigint>, audits array<string>"


def _rows_of(columns: list[str], types: list[pa.DataType], found: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in found], t) for c, t in zip(columns, types)], columns)


def _solver(turns: bool, conv_type: pa.DataType):
    """Rows (conv, turn, role, text, n, first), sorted, to: ``conv`` for a conversation that is solved, ``block`` for a part of one
    that isn't, with its ``row``s; and, if wanted, ``turn``s of the solved ones."""
    names = [c.split()[0] for c in _SOLVED.split(", ")]
    kinds = [pa.string(), conv_type, pa.int32(), pa.int32(), *[pa.int64()] * 6, *[pa.string()] * 4, pa.list_(pa.int64()), pa.list_(pa.string())]

    def solved(conv, rows: list[Row]) -> Iterator[dict]:
        ((cost, audit),) = agenda(rows, 0, ENDS).values()
        writer, letters, place = Rewriter(), iter(audit), 0
        for row in [*rows, None]:
            for role, text, edit in writer.edits(letters, row):
                if turns:
                    yield {"kind": "turn", "conv": conv, "pos": place, "role": role, "text": text, "audit": edit}
                place += 1
        yield {"kind": "conv", "conv": conv, **counted(rows), "cost": cost, "audit": audit, "hash": writer.hash.hexdigest()}

    def counted(rows: list[Row]) -> dict:
        faults = [r[2] for r in rows]
        return {"blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED), "illegal": _illegal(rows)}

    def opened(conv, part: int, block: int, rows: list[Row]) -> Iterator[dict]:
        ways = [agenda(rows, q, None) for q in STATES]
        both = [w.get(q) for w in ways for q in STATES]
        ends = {"role": rows[0][0][:1], "text": rows[-1][0][:1]}
        yield {"kind": "block", "conv": conv, "part": part, "block": block, "pos": -1, **counted(rows), **ends, "costs": [x and x[0] for x in both], "audits": [x and x[1] for x in both]}
        for i, (role, text, _) in enumerate(rows):
            yield {"kind": "row", "conv": conv, "part": part, "block": block, "pos": i, "role": role, "text": text}

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part, block, own, left, held, size, last = TaskContext.get().partitionId(), 0, True, True, [], 0, None
        for batch in batches:
            for conv, role, text, n, first in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3, 4, 5))):
                if held and conv != last:
                    yield from solved(last, held) if own and not left else opened(last, part, block, held)
                    left, own, block, held, size = False, True, 0, [], 0
                last = conv
                for copy in range(n):
                    if held and (len(held) >= BLOCK_ROWS or size + len(text) > BLOCK_BYTES):
                        yield from opened(conv, part, block, held)
                        own, block, held, size = False, block + 1, [], 0
                    held.append((role, text, _fault(text, copy > 0 or not first)))
                    size += len(text)
        if held:
            yield from opened(last, part, block, held)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for row in found(batches):
            out.append(row)
            size += len(row.get("text") or "") + 200
            if size > BLOCK_BYTES:
                yield _rows_of(names, kinds, out)
                out, size = [], 0
        if out:
            yield _rows_of(names, kinds, out)

    return kernel


class _Way:
    """The best way to a state after some blocks; ways that agree up to a block share it."""

    __slots__ = ("cost", "audit", "start", "before")

    def __init__(self, cost: int, audit: str, start: int, before: _Way | None):
        self.cost, self.audit, self.start, self.before = cost, audit, start, before

    def earlier(self, other: _Way) -> bool:
        """Whether this way, as cheap as the other and as many blocks long, comes first by its letters."""
        mine, theirs, a, b = [], [], self, other
        while a is not b:
            mine.append(a.audit)
            theirs.append(b.audit)
            a, b = a.before, b.before
        return "".join(reversed(mine)) < "".join(reversed(theirs))


def _joiner(conv_type: pa.DataType):
    """Blocks, sorted by conversation and place, to a ``conv`` row for each conversation and a ``plan`` row for each block."""
    names = ["kind", "conv", "part", "block", "pos", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "role", "text"]
    kinds = [pa.string(), conv_type, pa.int32(), pa.int32(), *[pa.int64()] * 6, *[pa.string()] * 3]
    counts = ["blank", "duplicate", "truncated", "illegal"]

    def ended(conv, total: dict, ways: dict[int, _Way], places: list[tuple[int, int]]) -> Iterator[dict]:
        best = None
        for way in (ways[q] for q in ENDS if q in ways):
            if best is None or way.cost < best.cost or way.cost == best.cost and way.earlier(best):
                best = way
        chain, way = [], best
        while way.before is not None:
            chain.append(way)
            way = way.before
        yield {"kind": "conv", "conv": conv, **total, "cost": best.cost, "audit": "".join(w.audit for w in reversed(chain))}
        for (part, block), way in zip(places, reversed(chain)):
            yield {"kind": "plan", "conv": conv, "part": part, "block": block, "pos": -1, "text": way.audit}

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        conv, ways, places, total, last = None, {}, [], {}, ""
        for batch in batches:
            for row in batch.to_pylist():
                if places and row["conv"] != conv:
                    yield from ended(conv, total, ways, places)
                    places = []
                if not places:
                    conv, ways, total, last = row["conv"], {0: _Way(0, "", 0, None)}, dict.fromkeys(counts, 0), None
                new: dict[int, _Way] = {}
                for q, way in ways.items():
                    for to in STATES:
                        cost = row["costs"][4 * q + to]
                        if cost is not None:
                            at = _Way(way.cost + cost, row["audits"][4 * q + to], q, way)
                            if to not in new or at.cost < new[to].cost or at.cost == new[to].cost and at.earlier(new[to]):
                                new[to] = at
                for c in counts:
                    total[c] += row[c]
                if last is not None and last + row["role"] not in LEGAL:
                    total["illegal"] += 1
                ways, last = new, row["text"]
                places.append((row["part"], row["block"]))
        if places:
            yield from ended(conv, total, ways, places)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for row in found(batches):
            out.append(row)
            if len(out) >= BLOCK_ROWS:
                yield _rows_of(names, kinds, out)
                out = []
        if out:
            yield _rows_of(names, kinds, out)

    return kernel


def _writer(turns: bool, conv_type: pa.DataType):
    """``plan`` and ``row`` rows, sorted, to a ``hash`` row a conversation, and its ``turn``s if wanted. What is held is a plan and a row."""
    names, kinds = ["kind", "conv", "pos", "hash", "role", "text", "audit"], [pa.string(), conv_type, pa.int64(), *[pa.string()] * 4]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        writer, letters, conv, place = None, iter(()), None, 0

        def put(row: Row | None) -> Iterator[dict]:
            nonlocal place
            for role, text, edit in writer.edits(letters, row):
                if turns:
                    yield {"kind": "turn", "conv": conv, "pos": place, "role": role, "text": text, "audit": edit}
                place += 1

        for batch in batches:
            for own, pos, role, text in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if writer and (pos == -1 or own != conv):
                    yield from put(None)
                if writer is None or own != conv:
                    if writer:
                        yield {"kind": "hash", "conv": conv, "hash": writer.hash.hexdigest()}
                    writer, conv, place = Rewriter(), own, 0
                if pos == -1:
                    letters = iter(text)
                else:
                    yield from put((role, text, FINE))
        if writer:
            yield from put(None)
            yield {"kind": "hash", "conv": conv, "hash": writer.hash.hexdigest()}

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for row in found(batches):
            out.append(row)
            size += len(row.get("text") or "") + 200
            if size > BLOCK_BYTES:
                yield _rows_of(names, kinds, out)
                out, size = [], 0
        if out:
            yield _rows_of(names, kinds, out)

    return kernel


def _plain(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, text); a null role or text is one space."""
    space = lambda c: F.coalesce(df[c].cast("string"), F.lit(" "))
    return df.select(df[conv_col].alias("conv"), df[turn_col].cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"))


def _turn(column: str) -> Column:
    return F.col(column).asc_nulls_first()


def _solutions(rows: DataFrame, turns: bool) -> list[DataFrame]:
    """Of rows (conv, turn, role, text): the tables that together hold the kinds conv, hash and turn."""
    prepare(rows)
    kind = rows.schema["conv"].dataType.simpleString()
    conv_type = rows.select("conv").limit(0).toArrow().schema.field(0).type
    # Equal rows are counted. What is said in more than one turn has its first one, with null before all others.
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    rows = staged(rows.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("n")).withColumn("said", said), "turns")
    order = F.struct(F.col("turn").isNotNull().alias("is"), F.col("turn").alias("at"))
    again = rows.groupBy(F.col("conv").alias("c"), F.col("said").alias("s")).agg(F.min(order).alias("least"), F.count("*").alias("many")).filter("many > 1").drop("many")
    met = rows.join(again, F.col("conv").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s")), "left")
    met = met.select("conv", "turn", "role", "text", "n", (F.col("least").isNull() | (order == F.col("least"))).alias("first"), "said")
    met = staged(met, "turns-met")
    keys = [F.col("conv").asc_nulls_first(), _turn("turn"), F.col("role"), F.col("said")]
    dealt = met.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("said")
    found = staged(dealt.mapInArrow(tidy(_solver(turns, conv_type)), _SOLVED.format(kind=kind)), "turns-solved")

    place = ["conv", "part", "block"]
    blocks = found.filter("kind = 'block'").repartition("conv").sortWithinPartitions(*place)
    joined = staged(blocks.mapInArrow(tidy(_joiner(conv_type)), f"kind string, conv {kind}, part int, block int, pos bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, role string, text string"), "turns-joined")
    steps = [*place, "pos", "role", "text"]
    plans = joined.filter("kind = 'plan'").select(*steps).unionByName(found.filter("kind = 'row'").select(*steps))
    plans = plans.repartition("conv").sortWithinPartitions(*place, "pos").select("conv", "pos", "role", "text")
    written = plans.mapInArrow(tidy(_writer(turns, conv_type)), f"kind string, conv {kind}, pos bigint, hash string, role string, text string, audit string")
    return [found.filter("kind in ('conv', 'turn')"), joined.filter("kind = 'conv'"), staged(written, "turns-written") if turns else written]


def report(df: DataFrame, every: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation of ``df``, and of ``every``, a frame with the same id column whose conversations ``df`` may have
    lost: (id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).

    Rows are taken by turn, nulls first, and within a turn by role and a hash of role and text; equal rows are all there, and all but
    the first are duplicates. A null id is a conversation of its own; a null role or text is one space. A role without a
    character has no initial, and can't be kept. A conversation without rows has zeros, an empty audit and the empty string's hash.
    Other columns, whatever their names, play no part. No rows give no rows.
    """
    rows = _plain(df, conv_col, turn_col, role_col, text_col)
    ids = (df if every is None else every).select(F.col(conv_col).alias("conv")).distinct()
    span = (F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps")
    parts = [ids, rows.groupBy("conv").agg(span), *(t.filter("kind <> 'turn'") for t in _solutions(rows, False))]
    columns = ["conv", *_COUNTS, "audit", "hash"]
    same = [p.select(*(F.col(c) if c in p.columns else F.lit(None).cast("string" if c in ("audit", "hash") else "long").alias(c) for c in columns)) for p in parts]
    whole = same[0]
    for part in same[1:]:
        whole = whole.unionByName(part)
    whole = whole.groupBy("conv").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _COUNTS), F.max("audit").alias("audit"), F.max("hash").alias("hash"))
    return whole.select(F.col("conv").alias(conv_col), *_COUNTS, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("hash", F.lit(_EMPTY)).alias("repaired_sha256"))


def repaired(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired conversations: (id, turn, role, text, edit), turns from 0 without gaps. Cases are as in ``report``."""
    found = [t.filter("kind = 'turn'").select("conv", "pos", "role", "text", "audit") for t in _solutions(_plain(df, conv_col, turn_col, role_col, text_col), True) if "pos" in t.columns]
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    return whole.select(F.col("conv").alias(conv_col), F.col("pos").alias(turn_col), F.col("role").alias(role_col), F.col("text").alias(text_col), F.col("audit").alias("edit"))


def damaged(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, turn, role, text) with faults by crc32(``id:turn``) mod 20: 0 drops a row, 1 empties its text, 2 takes its ends of sentences,
    3 repeats it, 4 makes it the user's. A null id or turn reads as one space there."""
    text = lambda c: F.coalesce(df[c].cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text(conv_col), F.lit(":"), text(turn_col)).cast("binary")) % 20
    rows = df.select(df[conv_col].alias("c"), df[turn_col].alias("t"), text(role_col).alias("r"), text(text_col).alias("x"), kind.alias("kind")).filter("kind <> 0")
    cut = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("x", ".!?", "")).otherwise(F.col("x"))
    rows = rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.select(F.col("c").alias(conv_col), F.col("t").alias(turn_col), F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("r")).alias(role_col), cut.alias(text_col))


def oracle() -> str:
    """The report on damaged ``conversations``: row by row, the best of all edits for each state."""
    word, cut = "[^\\x20\\x09-\\x0D]", "[.!?]"
    role = "CASE q WHEN 2 THEN 'assistant' ELSE 'user' END"
    after = "CASE q WHEN 2 THEN 3 ELSE 2 END"
    plus = lambda w: f"CASE WHEN fixed = '' THEN '' ELSE fixed || chr(10) END || {w}"
    insert = lambda source: f"SELECT c, i, {after} AS q, cost + {INSERT_COST} AS cost, audit || 'I' AS audit, {plus(f'({role}) || chr(58)')} AS fixed FROM {source}"
    more = f"CASE WHEN fault = {TRUNCATED} THEN {TRUNCATED_COST} ELSE 0 END"
    return f"""
WITH RECURSIVE raw AS (
    SELECT conv_id, turn, coalesce(CAST(conv_id AS VARCHAR), ' ') AS c, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations
), bits AS (
    SELECT *, list_transform(range(8 * length(k)), lambda i: CAST((ascii(substr(k, CAST(i // 8 + 1 AS BIGINT), 1)) >> CAST(i % 8 AS INTEGER)) & 1 AS BIGINT)) AS b FROM raw
), crc AS (
    SELECT conv_id, c, turn, role, text, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda x, y: xor(x >> 1, 3988292384 * (xor(x, y) & 1))), CAST(4294967295 AS BIGINT)) % 20 AS kind FROM bits
), hurt AS (
    SELECT conv_id, c, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '{cut}', '', 'g') ELSE text END AS text
    FROM (SELECT *, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) FROM crc WHERE kind <> 0)
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS i FROM hurt
), seen AS (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again, lag(role) OVER (PARTITION BY c ORDER BY i) AS before FROM placed
), rows AS (
    SELECT *, CASE WHEN NOT regexp_matches(text, '{word}') THEN {BLANK} WHEN again THEN {DUPLICATE} WHEN NOT regexp_matches(text, '{cut}[\\x20\\x09-\\x0D]*$') THEN {TRUNCATED} ELSE {FINE} END AS fault FROM seen
), best AS (
    SELECT DISTINCT c, CAST(0 AS BIGINT) AS i, 0 AS q, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS fixed FROM rows
    UNION ALL
    (WITH one AS ({insert("best")}), two AS ({insert("one")}), here AS (SELECT * FROM best UNION ALL SELECT * FROM one UNION ALL SELECT * FROM two),
    made AS (
        SELECT h.c, h.i + 1 AS i, q, cost + {DELETE_COST} AS cost, audit || 'D' AS audit, fixed FROM here h JOIN rows r ON r.c = h.c AND r.i = h.i + 1
        UNION ALL SELECT h.c, h.i + 1, {after}, cost + {REROLE_COST} + {more}, audit || 'R', {plus(f"({role}) || chr(58) || text")} FROM here h JOIN rows r ON r.c = h.c AND r.i = h.i + 1 WHERE fault IN ({FINE}, {TRUNCATED})
        UNION ALL SELECT h.c, h.i + 1, CASE substr(role, 1, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, cost + {more}, audit || 'K', {plus("role || chr(58) || text")} FROM here h JOIN rows r ON r.c = h.c AND r.i = h.i + 1
        WHERE fault IN ({FINE}, {TRUNCATED}) AND CASE q WHEN 0 THEN substr(role, 1, 1) IN ('s', 'u') WHEN 2 THEN substr(role, 1, 1) = 'a' ELSE substr(role, 1, 1) = 'u' END)
    SELECT c, i, q, cost, audit, fixed FROM made QUALIFY row_number() OVER (PARTITION BY c, q ORDER BY cost, audit) = 1)
), last AS (SELECT best.* FROM best JOIN (SELECT c, max(i) AS i FROM rows GROUP BY 1) USING (c, i)
), one AS ({insert("last")}), two AS ({insert("one")}
), done AS (
    SELECT c, cost, audit, fixed FROM (SELECT * FROM last UNION ALL SELECT * FROM one UNION ALL SELECT * FROM two) WHERE q IN (0, 3) QUALIFY row_number() OVER (PARTITION BY c ORDER BY cost, audit) = 1
), counts AS (
    SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = {BLANK}) AS blank, count(*) FILTER (fault = {DUPLICATE}) AS duplicate, count(*) FILTER (fault = {TRUNCATED}) AS truncated,
        count(*) FILTER (before IS NOT NULL AND substr(before, 1, 1) || substr(role, 1, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY 1
)
SELECT conv_id, {", ".join(f"CAST(coalesce({x}, 0) AS BIGINT) AS {x}" for x in _COUNTS)}, coalesce(audit, '') AS audit, sha256(coalesce(fixed, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, c FROM raw) LEFT JOIN counts USING (c) LEFT JOIN done USING (c)
"""
