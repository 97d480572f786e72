import random

import pytest

import corpus_pipeline
from plinth.llm import similar
from plinth.llm.simhash import keep_one
from tests.llm.test_simhash import brute_components


def shingles(text, words=5):
    own = (text or "").lower().split()
    return {tuple(own[i : i + words]) for i in range(len(own) - words + 1)} or {tuple(own)}


def brute(rows):
    """(id, text) of the row that each component of similar texts keeps."""
    sets = [shingles(t) for _, t in rows]
    near = [(i, j) for j in range(len(rows)) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    comp = brute_components(range(len(rows)), near)
    return {c: min(rows[i][0] for i in comp if comp[i] == c) for c in set(comp.values())}, comp


def fixture():
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    line = " ".join(word() for _ in range(12))
    texts = []
    for i in range(60):
        own = [word() for _ in range(rng.choice([3, 30, 120]))]
        texts.append(" ".join(own))
        for _ in range(2):
            own = list(own)
            for _ in range(rng.choice([1, 2, 4])):
                own[rng.randrange(len(own))] = word()
            texts.append("\n".join(own).upper())
        texts.append(line + " " + " ".join(word() for _ in range(30)))
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("crowd", [2, 64])
def test_components_are_those_of_all_pairs(spark, crowd):
    rows = fixture()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept, _ = brute(rows)
    assert len(kept) < len(rows)
    assert sorted(r.doc_id for r in keep_one(df, crowd=crowd).collect()) == sorted(kept.values())


def test_stage_takes_near_copies_out(spark, tmp_path):
    rng = random.Random(9)
    words = [f"w{rng.randrange(5000)}" for _ in range(100)]
    near = [*words[:50], "other", *words[51:]]
    rows = [(1, " ".join(words), "en"), (2, " ".join(near), "en"), (3, " ".join(reversed(words)), "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = corpus_pipeline.near_dedup(spark, df, str(tmp_path))
    assert got.schema == df.schema and sorted(map(tuple, got.collect())) == [rows[0], rows[2]]


def test_repeated_and_null_ids_keep_a_row_of_each_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(7, a), (7, b), (7, b), (3, a), (None, c), (None, c), (None, b), (9, None), (8, "")]
    rows = [(*r, 1, "x") for r in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int, _n string")
    got = keep_one(df)
    assert got.schema == df.schema
    assert sorted((tuple(r)[:2] for r in got.collect()), key=str) == sorted([(3, a), (7, b), (None, c), (8, "")], key=str)


def near_group(n=400, seed=4):
    """Changed copies of one text, from none to many changes, with pairs of copies that share changes."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(150)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(12)):
            own[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        out.append(own)
    for own in out[: n // 8]:
        twin = list(own)
        twin[rng.randrange(150)] = "twin"
        out.append(twin)
    return [(i, " ".join(x)) for i, x in enumerate(out)]


def test_crowd_of_near_copies_makes_few_pairs(spark, monkeypatch):
    rows = near_group()
    kept, _ = brute(rows)
    assert 100 < len(kept) < len(rows) - 100
    made = []
    old = similar.similar
    monkeypatch.setattr(similar, "similar", lambda t, n, p, *a: (made.append(p.count()), old(t, n, p, *a))[1])
    got = sorted(r.doc_id for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(kept.values())
    assert made[0] < 12 * len(rows)


def test_counts_bound_the_distance_of_sets():
    import numpy as np

    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 300, 20_000):
        a = np.unique(rng.integers(0, 2**64 - 1, n, np.uint64, endpoint=True))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 2**64 - 1, n // 8, np.uint64)]))
        x, y = (np.frombuffer(similar.segment_counts(s), "<u2").astype(int) for s in (a, b))
        assert x.sum() == len(a) and np.abs(x - y).sum() <= len(np.setxor1d(a, b))


def test_moved_rows_are_an_error(spark):
    from pyspark.sql import functions as F

    from plinth.llm.rows import check_of, row_number_id, without

    df = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id long, text string")
    gone = df.select(row_number_id().alias("row"), check_of(F.col("text")), "doc_id").filter("doc_id % 7 = 3")
    assert sorted(r.doc_id for r in without(df, "text", gone).collect()) == [i for i in range(50) if i % 7 != 3]
    with pytest.raises(Exception, match="aren't where they were"):
        without(df, "text", gone.withColumn("check", F.col("check") + 1)).collect()


@pytest.mark.parametrize("rows", [[], [(None, None)]])
def test_empty(spark, rows):
    assert keep_one(spark.createDataFrame(rows, "doc_id long, text string")).count() == len(rows)


def crowded_pairs(seed=7):
    """Families of texts of 100 words that share 75, and pairs within that share 14 more: only a pair is similar, and its first
    elements may all be the family's."""
    rng = random.Random(seed)
    texts = []
    for family in range(12):
        held = [f"s{family}x{i}" for i in range(75)]
        for pair in range(15):
            both = [f"p{family}x{pair}x{i}" for i in range(14)]
            texts += [held + both + [f"o{rng.randrange(10**12)}" for _ in range(11)] for _ in range(2)]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("tile", [4, 256])
def test_crowds_lose_no_link_that_hubs_do_not_show(spark, monkeypatch, tile):
    monkeypatch.setattr(similar, "TILE", tile)
    rows = crowded_pairs()
    sets = [shingles(t, 1) for _, t in rows]
    assert all((5 * len(a & b) >= 4 * len(a | b)) == (i // 2 == j // 2) for i, a in enumerate(sets[:60]) for j, b in enumerate(sets[:60]))
    got = keep_one(spark.createDataFrame(rows, "doc_id long, text string"), words=1, crowd=8)
    assert sorted(r.doc_id for r in got.collect()) == list(range(0, len(rows), 2))
