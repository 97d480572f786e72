import hashlib
import random
import re

import numpy as np
import pytest

from plinth.llm.decontaminate import NEVER, contamination, drop_contaminated, grams, winnow
from tests.llm.test_common import thue_morse

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def fold(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window=13):
    words, hit, found = fold(text), set(), set()
    for item, body in items:
        own = fold(body)
        size = min(len(own), window)
        if not size:
            continue
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)}
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                found |= set() if item is None else {item}
    ids = sorted(map(str, found))
    n, h = len(words), len(hit)
    return n, h, len(ids), ids, hashlib.sha256(",".join(ids).encode()).hexdigest(), h > 0 and 20 * h >= n


def cases(seed=3):
    rng = random.Random(seed)
    make = lambda n, v: " ".join(f"{rng.choice('abÉ漢')}{rng.randrange(v)}" for _ in range(n))
    items = [(i, make(rng.choice([1, 2, 4, 5, 6, 12, 13, 14, 30, 60]), rng.choice([2, 4, 500]))) for i in range(40)]
    items += [(100, items[3][1]), (101, None), (102, ""), (103, "--"), (None, make(20, 100)), (2, "one two Three four five six seven eight nine ten eleven twelve thirteen")]
    docs = [None, "", "!!", "one two three four five six seven eight nine ten eleven twelve", "x ONE-two three four five six seven eight nine ten eleven twelve thirteen"]
    for _ in range(300):
        parts = [make(rng.randrange(30), rng.choice([2, 4, 500])) for _ in range(3)]
        for _ in range(rng.randrange(3)):
            own = fold(rng.choice(items)[1])
            a = rng.randrange(len(own) + 1)
            parts.insert(rng.randrange(4), ", ".join(own[a : a + rng.choice([5, 12, 13, 14, 40])]).upper() if rng.random() < 0.5 else " ".join(own))
        docs.append(" ".join(parts))
    docs.append("filler " * 400_000 + items[8][1])
    return docs, items


@pytest.mark.parametrize("bits", [None, 64])
def test_against_brute_force(spark, bits):
    docs, items = cases()
    rows = [(i, t, "x") for i, t in enumerate(docs)] + [(None, docs[9], None), (5, docs[5], "y"), (5, docs[5], "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in contamination(df, bench, bits=bits).collect()), key=str)
    want = sorted(((i, *brute(t, items)) for i, t, _ in rows), key=str)
    assert got == want
    kept = {r.doc_id for r in drop_contaminated(df, bench).collect()}
    assert kept == {r[0] for r in want if not r[-1]}


def test_every_shared_window_is_kept():
    rng = np.random.default_rng(1)
    for _ in range(50):
        shared = rng.integers(0, 6, 13).astype(np.uint64)
        kept = []
        for _ in range(2):
            words = np.concatenate([rng.integers(0, 6, rng.integers(0, 9)).astype(np.uint64), shared, rng.integers(0, 6, rng.integers(0, 9)).astype(np.uint64)])
            h = grams(words, len(words) - np.arange(len(words)), 5)
            kept.append(set(h[winnow(h, 9)].tolist()) - {int(NEVER)})
        assert kept[0] & kept[1]


def test_unlike_words_of_one_polynomial_hash(spark):
    a, b = thue_morse(2048)
    first = " ".join(f"w{i}" for i in range(12))
    df = spark.createDataFrame([(1, f"{first} {b}"), (2, f"{first} {a}")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, f"{first} {a}")], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in contamination(df, bench).collect()} == {1: 0, 2: 13}


def test_passage_common_on_both_sides(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    df = spark.createDataFrame([(i, f"a{i} {passage} z") for i in range(300)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, f"{passage} q{i}") for i in range(200)], "item_id long, text string")
    got = contamination(df, bench).select("n_hit", "n_items").distinct().collect()
    assert [tuple(r) for r in got] == [(20, 200)]


def test_clashing_columns_stay(spark):
    words = " ".join(f"w{i}" for i in range(14))
    df = spark.createDataFrame([(1, words, True, "x"), (2, "else", False, "y"), (3, None, None, None)], "doc_id long, text string, may_hit boolean, bad string")
    got = drop_contaminated(df, spark.createDataFrame([(1, words)], "item_id long, text string"))
    assert got.schema == df.schema and min((tuple(r) for r in got.collect()), key=str) == (2, "else", False, "y") and got.count() == 2


@pytest.mark.parametrize("rows", [[], [(None, None)]])
def test_empty(spark, rows):
    none = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[1:4] for r in contamination(none, bench).collect()] == [(0, 0, 0)] * len(rows)
