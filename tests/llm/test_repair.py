import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from plinth.llm import repair
from plinth.llm.repair import agenda, damaged, repaired, report

WORDY, GRAMMAR = re.compile("[^\x20\x09-\x0d]"), re.compile("(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, kind string, audit int"


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        last = WORDY.findall(text)[-1:]
        out.append(1 if not last else 2 if (role, text) in seen else 0 if last[0] in ".!?" else 3)
        seen.add((role, text))
    return out


def every_edit(rows, fault, inserts=2):
    """All edits of a few rows, tried one by one: (cost, audit, repaired turns)."""
    best = None
    made = [[("I", r) for r in way] for n in range(inserts + 1) for way in itertools.product(("user", "assistant"), repeat=n)]
    for edits in itertools.product(*[[("D", None)] if f in (1, 2) else [*([("K", None)] if r else []), ("R", "user"), ("R", "assistant"), ("D", None)] for f, (r, _) in zip(fault, rows)]):
        for gaps in itertools.product(made, repeat=len(rows) + 1):
            steps = list(gaps[0])
            for edit, gap in zip(enumerate(edits), gaps[1:]):
                steps += [edit, *gap]
            out, cost, audit = [], 0, ""
            for step in steps:
                if step[0] == "I":
                    out, cost, audit = [*out, (step[1], "")], cost + 3, audit + "I"
                    continue
                i, (letter, role) = step
                audit += letter
                cost += {"K": 0, "R": 3, "D": 4}[letter] + (3 if fault[i] == 3 and letter != "D" else 0)
                if letter != "D":
                    out.append((role or rows[i][0], rows[i][1]))
            if GRAMMAR.fullmatch("".join(r[:1] for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, out)
    return best


def backwards(rows, fault):
    """The same for many rows, from the end: what is left to do from row i on in a state."""
    n = len(rows)
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = {}
    for i in range(n, -1, -1):
        ways = {}
        for q in step:
            found = [(0, "", ())] if i == n and q in ("", "a") else []
            if i < n:
                later = lambda to: best.get((i + 1, to))
                found += [(c + 4, "D" + a, t) for c, a, t in [later(q)]]
                if fault[i] in (0, 3):
                    more = 3 * (fault[i] == 3)
                    for letter, role, cost in (("K", rows[i][0], 0), ("R", "user", 3), ("R", "assistant", 3)):
                        to = step[q].get(role[:1])
                        if to and (letter == "K" or role != "s") and later(to):
                            c, a, t = later(to)
                            found.append((c + cost + more, letter + a, ((role, rows[i][1]), t)))
            ways[q] = min(found, key=lambda x: x[:2]) if found else None
        for _ in range(3):
            for q in step:
                for role in ("user", "assistant"):
                    to = step[q].get(role[0])
                    if to and ways[to]:
                        c, a, t = ways[to]
                        way = (c + 3, "I" + a, ((role, ""), t))
                        if ways[q] is None or way[:2] < ways[q][:2]:
                            ways[q] = way
        best.update({(i, q): w for q, w in ways.items()})
    cost, audit, chain = best[0, ""]
    out = []
    while chain:
        out.append(chain[0])
        chain = chain[1]
    return cost, audit, out


def brute(rows, ids):
    groups = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
        groups[conv].append(((turn is not None, turn or 0), role, digest, text, turn))
    out, turns = [], []
    for conv in ids:
        own = sorted(groups[conv], key=lambda x: x[:3])
        said = [(x[1], x[3]) for x in own]
        fault = faults(said)
        cost, audit, fixed = backwards(said, fault)
        known = [x[4] for x in own if x[4] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out.append((conv, gaps, fault.count(1), fault.count(2), fault.count(3), illegal, cost, audit, digest))
        turns += [(conv, i, r, t, e) for i, ((r, t), e) in enumerate(zip(fixed, audit.replace("D", "")))]
    return sorted(out, key=str), sorted(turns, key=str)


def some(rng, n):
    texts = ["Fine.", "Why?", "cut off", "", " \t", "漢字!", "x \n", "No.\r\n", "\x1c", "é"]
    return [(rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "uncle", "", " "]), rng.choice(texts) if rng.random() < 0.6 else f"t{rng.randrange(99)}.") for _ in range(n)]


def test_agenda_against_all_edits():
    rng = random.Random(1)
    for n in [0, 1, 1, 2, 2, 2] + [3] * 12:
        rows = some(rng, n)
        fault = faults(rows)
        want = every_edit(rows, fault, 1 if n > 2 else 2)
        ((cost, audit),) = agenda([(*r, f) for r, f in zip(rows, fault)], 0, (0, 3)).values()
        assert (cost, audit) == want[:2] == backwards(rows, fault)[:2]


def test_agenda_on_long_conversations():
    rng = random.Random(2)
    for _ in range(60):
        rows = some(rng, rng.randrange(4, 60))
        fault = faults(rows)
        assert [*agenda([(*r, f) for r, f in zip(rows, fault)], 0, (0, 3)).values()] == [backwards(rows, fault)[:2]]


def table():
    rng = random.Random(3)
    rows = []
    for conv in [*range(60), None]:
        n = rng.choice([1, 2, 3, 5, 8, 20])
        rows += [(conv, rng.choice([i, i, i, None, 3]), *said, "x", 1) for i, said in enumerate(some(rng, n))]
    rows += [(100, i, *said, None, None) for i, said in enumerate(some(rng, 400))]  # longer than blocks
    rows += [(101, 5, "user", "Same.", None, None)] * 300 + [(101, i, "assistant", "Same.", None, None) for i in range(200)]
    rows += [(102, None, None, None, None, None), (103, -(2**62), "user", "z" * 500_000 + ".", "", 0), (103, 7, "assistant", "End.", "", 0)]
    return rows


@pytest.mark.parametrize("block", [512, 7])
def test_against_brute_force(spark, monkeypatch, block):
    rows = table()
    monkeypatch.setattr(repair, "BLOCK_ROWS", block)
    df = spark.createDataFrame(rows, SCHEMA)
    ids = {r[0] for r in rows} | {500}
    every = spark.createDataFrame([(i,) for i in ids], "conv_id long")
    want, turns = brute(rows, ids)
    assert sorted((tuple(r) for r in report(df, every).collect()), key=str) == want
    assert sorted((tuple(r) for r in repaired(df).collect()), key=str) == turns


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!", None, None) for c in range(12) for t in range(12)] + [(None, None, None, None, None, None)]
    want = []
    for c, t, role, text, *_ in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text or " ")}.get(kind, text or " ")
        want += [(c, t, "user" if kind == 4 else role or " ", text)] * {0: 0, 3: 2}.get(kind, 1)
    got = damaged(spark.createDataFrame(rows, SCHEMA))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str) and len({r[3] for r in want}) > 2


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert report(damaged(none), none).collect() == [] == repaired(none).collect()
    assert [tuple(r) for r in report(none, spark.createDataFrame([(None,)], "conv_id long")).collect()] == [(None, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
