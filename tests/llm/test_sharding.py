import random
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings, strategies as st

from plinth.llm.sharding import assign, difference, placed, singles


@settings(deadline=None, max_examples=50)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=60), st.integers(2, 16))
def test_bins_hold_what_they_say(sizes, bins):
    joint, where = singles(sizes, bins)
    got = [0] * bins
    for s, w in zip(sizes, where):
        got[w] += s
    assert got == joint == sorted(joint)
    assert joint[-1] - joint[0] <= max(sizes)  # differencing never ends with more spread than the largest part


def test_joins_of_partial_partitions():
    rng = random.Random(3)
    parts = [[rng.randrange(100) for _ in range(5)] for _ in range(30)]
    joint, where = difference(parts)
    got = [0] * 5
    for part, to in zip(parts, where):
        assert sorted(to) == list(range(5))
        for s, w in zip(part, to):
            got[w] += s
    assert got == joint


def test_two_bins_as_in_the_textbook():
    rng = random.Random(8)
    for _ in range(50):
        sizes = [rng.randrange(1, 1000) for _ in range(12)]
        joint, _ = singles(sizes, 2)
        left = sorted(sizes)
        while len(left) > 1:
            left = sorted([*left[:-2], left[-1] - left[-2]])
        assert joint[1] - joint[0] == left[0]


@pytest.mark.parametrize("run,bundles", [(1 << 15, 1 << 11), (200, 40), (60, 20)])
def test_assign(spark, run, bundles, monkeypatch):
    monkeypatch.setattr("plinth.llm.sharding.SLOTS", 7)
    rng = random.Random(1)
    texts = [None, "", "é"] + [("w" * rng.randrange(1, 900)) + str(i) for i in range(600)]
    rows = [(i, rng.choice(texts), 7) for i in range(1500)] + [(None, texts[5], 1), (None, None, 1), (3, texts[5], 1), (3, texts[5], 1)]
    rows += [(5000 + i, "copy", 1) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = assign(df, run=run, bundles=bundles).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    home, slots, load = defaultdict(set), defaultdict(list), Counter()
    for r in got:
        home[r.size, r.text_crc32].add(r.shard)
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(len(x) == 1 for k, x in home.items() if k[0] > 1)  # null and empty look alike
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert len(load) == 16 and max(load.values()) - min(load.values()) <= (20 if run > 10_000 else 3 * sum(load.values()) // run)  # a few bundles
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}


def test_a_large_group_is_evened_out(spark):
    # One group of nine tenths of a shard; the rest must make up for it, bundled or not.
    rows = [(i, f"{i} " + "x" * (i * 37 % 200)) for i in range(6000)]
    total = sum(len(t) + 1 for _, t in rows)
    copies = int(0.9 * total / 15.1 / 101)
    df = spark.createDataFrame(rows + [(10_000 + i, "h" * 100) for i in range(copies)], "doc_id long, text string")
    for run, most in ((1 << 15, 1.001), (2000, 1.01)):
        load = Counter()
        for r in assign(df, run=run, bundles=500).collect():
            load[r.shard] += r.size
        assert max(load.values()) / min(load.values()) < most


def test_hot_group_stays_whole(spark):
    df = spark.createDataFrame([(i, "hot " * 50 if i % 2 else f"t{i}") for i in range(2000)], "doc_id long, text string")
    got = assign(df).collect()
    assert len({r.shard for r in got if r.size > 100}) == 1 and len(got) == 2000


def test_shards_do_not_depend_on_how_the_table_is_cut(spark):
    df = spark.createDataFrame([(i, f"{i} " + "x" * (i * 37 % 200)) for i in range(3000)], "doc_id long, text string")
    got = [sorted(map(tuple, assign(x, run=500, bundles=100).select("doc_id", "shard", "slot").collect())) for x in (df, df.repartition(3))]
    assert got[0] == got[1]


def test_many_groups_stay_balanced(spark):
    # Over several rounds: the spread is far below a group's mean share of a shard.
    rows = [(str(i), 50 + i * 7919 % 4000 + (10**6 if i % 20_000 == 0 else 0)) for i in range(120_000)]
    groups = spark.createDataFrame(rows, "id string, bytes long")
    load, size = Counter(), dict(rows)
    for r in placed(groups, 16, run=1 << 13, bundles=1 << 10).collect():
        load[r.shard] += size[r.id]
    assert sum(load.values()) == sum(size.values()) and max(load.values()) / min(load.values()) < 1.0005


@pytest.mark.parametrize("rows", [[], [(None, None)]])
def test_empty(spark, rows):
    got = assign(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.size, r.text_crc32, r.slot) for r in got] == [(1, 0, 0)] * len(rows)
