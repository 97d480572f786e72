"""Sketches of drawings, and of groups of them, against exact counts and ranks."""

import random
from bisect import bisect_left, bisect_right

from pyspark.sql import functions as F

from plinth.operators import sketches as K


def test_merged_sketches_keep_their_bounds(spark):
    rng = random.Random(3)
    rows = [(c, "AB"[c % 2], f"t{rng.randrange(3000 * (1 + c % 3))}", rng.gauss(c, 50)) for c in range(12) for _ in range(2500)] + [(0, "A", None, None), (1, "B", "x", float("nan"))]
    df = spark.createDataFrame(rows, "commit_id long, layer string, text string, y double").repartition(5)
    fine = K.sketched(df, ["commit_id", "layer"], "text", "y")
    for keys in (["layer"], []):
        for r in K.merged(fine, keys).select(*keys, "n", "known", K.distinct_count().alias("d"), *(K.quantile(q).alias(f"q{i}") for i, q in enumerate((0.1, 0.5, 0.9))), K.rank(0.0).alias("at0")).collect():
            own = [x for x in rows if not keys or x[1] == r.layer]
            ys, texts = sorted(x[3] for x in own if x[3] is not None and x[3] == x[3]), {x[2] for x in own if x[2] is not None}
            assert r.n == len(own) and r.known == len(ys) and abs(r.d - len(texts)) <= 0.05 * len(texts)
            for q, v in ((0.1, r.q0), (0.5, r.q1), (0.9, r.q2)):
                assert bisect_left(ys, v) / len(ys) - 0.03 <= q <= bisect_right(ys, v) / len(ys) + 0.03
            assert abs(r.at0 - bisect_right(ys, 0.0) / len(ys)) <= 0.03


def test_small_groups_are_exact_and_nulls_count_for_nothing(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0), (1, "b", 3.0), (2, None, None)], "commit_id long, text string, y double")
    fine = K.sketched(df, ["commit_id"], "text", "y")
    got = {r.commit_id: (r.n, r.d, r.m) for r in fine.select("commit_id", "n", K.distinct_count().alias("d"), K.quantile(0.5).alias("m")).collect()}
    assert got == {1: (3, 2, 2.0), 2: (1, 0, None)}
    one = K.merged(fine, []).select("n", K.distinct_count().alias("d"), K.quantile(1.0).alias("top")).first()
    assert tuple(one) == (4, 2, 3.0)
    assert K.merged(fine.filter("commit_id = 2"), ["commit_id"]).select(K.distinct_count().alias("d"), K.quantile(0.5).alias("m")).first()[:] == (0, None)
    assert K.sketched(df.limit(0), ["commit_id"], "text", "y").agg(F.count("*")).first()[0] == 0
