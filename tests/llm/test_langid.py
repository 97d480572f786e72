import random
import zlib
from dataclasses import replace

import numpy as np
import pytest

from plinth.llm.langid import LanguageSettings, Sparse, counts, draw_threshold, features, fit, identify, keep_identified, sample, softmax, subwords, train

SMALL = LanguageSettings(per_language=200, buckets=1 << 11, epochs=4)
SOUNDS = {"xx": ["ba", "lo", "mi", "tu"], "yy": ["kra", "zhe", "vost", "ny"], "zz": ["é", "ñor", "ça", "qui"]}


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SOUNDS))
        text = " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.choice([5, 30, 200])))
        rows.append((i, text, lang if rng.random() < 0.9 else None, lang))
    return rows


def out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_held_out_accuracy_and_split(spark):
    rows = corpus()
    # Held-out rows carry a wrong label here: a fit that saw them would learn it.
    df = spark.createDataFrame([(i, t, "bad" if out(i) else l) for i, t, l, _ in rows], "doc_id long, text string, lang string")
    model = train(df, settings=SMALL)
    assert model.languages == sorted(SOUNDS)
    got = {r.doc_id: r for r in identify(df, model).collect()}
    assert all(got[i].held_out == out(i) for i, *_ in rows)
    right = [got[i].lang_pred == truth for i, _, _, truth in rows if out(i)]
    assert np.mean(right) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())
    assert keep_identified(df, model).count() == sum(r.accepted for r in got.values()) > 0.97 * len(rows)


def test_whole_text_counts_wherever_batches_are_cut(spark):
    model = fit([(i, l, features(t, i, SMALL.buckets)) for i, t, _, l in corpus(300)], SMALL)
    text = " ".join(t for _, t, _, l in corpus(3000, 2) if l == "xx")
    for part in (text, text * 40):
        data = np.frombuffer(part.encode(), np.uint8)
        total, n = np.zeros(len(model.languages)), 0
        for bucket in subwords(data, np.array([0, len(data)]), SMALL.buckets):
            bucket = bucket[bucket < SMALL.buckets]
            total += model.table[:, bucket].astype(float).sum(axis=1)
            n += len(bucket)
        assert np.allclose(model.logits(data, np.array([0, 0, len(data), len(data)]))[1], total / n, atol=1e-4)
    sparse = Sparse([counts(text, SMALL.buckets)])
    assert np.allclose(sparse.means(np.array([0]), model.table[:, :-1].T)[0], model.logits(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))[0], atol=1e-4)


def test_odd_texts(spark):
    rows = corpus(300)
    df = spark.createDataFrame([(i, t, l, 1) for i, t, l, _ in rows], "doc_id long, text string, lang string, score int")
    model = train(df, settings=SMALL)
    odd = [(1, None), (2, ""), (3, "123 -- !"), (4, "漢"), (None, rows[0][1]), (5, rows[0][1]), (5, rows[0][1]), (6, "٣٤ …"), (7, "a")]
    got = [(r[0], r[2], r[3] > 0, r[4]) for r in identify(spark.createDataFrame([(i, t, "q", 0) for i, t in odd], df.schema), model).collect()]
    unknown = [x[0] for x in got if x[1] == "und" and not x[2] and not x[3]]
    assert sorted(unknown) == [1, 2, 3, 6]
    assert len(got) == len(odd)


@pytest.mark.parametrize("rows", [[], [(None, None, None)], [(0, "text", None)]])
def test_nothing_to_learn(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = identify(df, train(df, settings=SMALL)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * len(rows)


def test_softmax_sums_to_one():
    assert np.allclose(softmax(np.array([[1000.0, -1000.0], [0.0, 0.0]])).sum(axis=1), 1)


def test_a_language_of_any_size_is_drawn():
    top = (1 << 63) - 1
    assert draw_threshold(5, 10) == draw_threshold(10, 10) == top
    for count in (11, 10**6, 8 * 10**8, 10**9 + 1, 5 * 10**13):
        got = draw_threshold(count, 1800)
        assert 0.999 < got / top * count / min(count, 1800) < 1.001


def test_draws_are_exact_and_whole(spark):
    rows = [(i, f"text {i} " + "w " * 3000 + f"end{i}", "big" if i % 10 else "small") for i in range(3000)]
    rows += [(7, "again and again", "big")] * 2000  # rows that repeat id and text are one
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    settings = LanguageSettings(per_language=50, buckets=1 << 11)
    got = sample(df, "doc_id", "text", "lang", settings)
    assert [sum(l == x for _, l, _ in got) for x in ("big", "small")] == [50, 50]
    assert got == sorted(got, key=lambda x: x[:2]) and len({h for h, _, _ in got}) == 100
    by = {h: (t, l) for h, t, l in df.selectExpr("shiftrightunsigned(xxhash64('language sample', doc_id, text), 1) h", "text", "lang").collect()}
    for h, l, own in got:
        assert by[h][1] == l and all((a == b).all() for x, y in zip(own, features(by[h][0], h, settings.buckets)) for a, b in zip(x, y))
    assert LanguageSettings().each(4) == 800 and LanguageSettings().each(200) == 32
    few = sample(df, "doc_id", "text", "lang", LanguageSettings(per_language=50, most_languages=1))
    assert {l for _, l, _ in few} == {"big"}


def test_fit_is_gradient_descent_on_a_linear_softmax():
    rows = [(i, l, features(t, i, 64)) for i, t, _, l in corpus(40)]
    settings = LanguageSettings(buckets=64, dims=3, epochs=2, batch=8)
    got = fit(rows, settings).table[:, :-1]
    # The same steps, text by text, in plain loops.
    rng, names = np.random.default_rng(20), sorted(SOUNDS)
    texts = [(own, names.index(l), h % 6 == 0) for h, l, three in rows for own in three[:3]]
    train_on = np.flatnonzero([not later for *_, later in texts])
    embed, layer = rng.normal(0, 0.1, (64, 3)), rng.normal(0, 0.1, (3, 3))
    steps, step = settings.epochs * -(-len(train_on) // 8), 0
    for _ in range(settings.epochs):
        order = rng.permutation(train_on)
        for low in range(0, len(order), 8):
            batch, rate = order[low : low + 8], settings.rate * (1 - step / steps)
            to_embed, to_layer = np.zeros_like(embed), np.zeros_like(layer)
            for i in batch:
                (bucket, share), label, _ = texts[i]
                mean = sum(embed[b] * w for b, w in zip(bucket, share))
                e = np.exp(mean @ layer)
                g = e / e.sum()
                g[label] -= 1
                to_layer += np.outer(mean, g) / len(batch)
                for b, w in zip(bucket, share):
                    to_embed[b] += w * (layer @ g)
            embed, layer, step = embed - rate * to_embed, layer - rate * to_layer, step + 1
    assert np.allclose(got, (embed @ layer).T, atol=1e-3)


def test_threshold_and_its_figure():
    rows = [(i, l, features(t, i, SMALL.buckets)) for i, t, _, l in corpus(900)]
    model = fit(rows, SMALL)
    assert 0 < model.threshold <= 0.5 and 0 <= model.rejected <= 1
    strict = fit(rows, replace(SMALL, most_threshold=1.0))
    assert strict.threshold >= model.threshold and strict.rejected >= model.rejected


def test_the_driver_fits_nothing(spark, monkeypatch):
    """The check: drawn rows and their fit are one task's, so the driver's memory holds the model alone."""
    df = spark.createDataFrame(corpus(120), "doc_id long, text string, lang string, truth string")
    here = fit(sample(df, "doc_id", "text", "lang", SMALL), SMALL)
    monkeypatch.setattr("plinth.llm.langid.sample", None)
    there = train(df, settings=SMALL)
    assert there.languages == here.languages and np.array_equal(there.table, here.table)
    assert (there.temperature, there.threshold) == (here.temperature, here.threshold)


def test_a_fit_holds_each_feature_once(monkeypatch):
    """The check: one task holds all drawn rows' features, so they come batch by batch and are held in as few bytes as they need."""
    import pyarrow as pa

    from plinth.llm import langid

    buckets = 1 << 12
    rows = [(h, l, features(t * 3, h, buckets)) for h, (_, t, _, l) in zip(random.Random(3).sample(range(10**6), 300), corpus(300))]
    raw = sum(b.nbytes + w.nbytes for *_, own in rows for b, w in own)

    def batches():
        for low in range(0, len(rows), 7):
            some = rows[low : low + 7]
            parts = [pa.array([[f[j].tobytes() for f in own] for *_, own in some], pa.list_(pa.binary())) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, *_ in some]), pa.array([l for _, l, _ in some]), *parts], ["h", "l", "bucket", "share"])

    settings = replace(SMALL, buckets=buckets)
    drawn = langid.gathered(batches(), buckets)
    assert drawn.runs.bucket is drawn.shuffled.bucket and drawn.runs.weight is drawn.shuffled.weight
    assert drawn.runs.bucket.nbytes + drawn.runs.weight.nbytes == raw * 6 // 8  # eight bytes a feature come in, six stay
    got, whole = langid.fitted(drawn, settings), fit(sorted(rows, key=lambda x: x[:2]), settings)
    assert np.array_equal(got.table, whole.table) and (got.temperature, got.threshold, got.rejected) == (whole.temperature, whole.threshold, whole.rejected)
    assert langid.fitted(langid.gathered(iter([]), buckets), settings).languages == []
