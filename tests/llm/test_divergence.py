import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from plinth.llm import divergence
from plinth.llm.divergence import audit, kept_terms, prefix_counts, refined, units

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, lang string, source string, value string, rank int"


def terms_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(rows, least=3, top=200):
    docs, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source, words = lang or "", source or "", terms_of(text)
        groups[lang].add(source)
        docs[lang].update(set(words))
        count[lang, source].update(words)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        n = {s: {t: count[lang, s][t] for t in kept} for s in sources}
        n[None] = {t: sum(n[s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 10**9 * (c + 1) // (sum(x.values()) + len(kept)) for t, c in x.items()} for s, x in n.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], p[None][t]), t) for t in kept if n[s][t] and p[s][t] > p[None][t]]
            for part, found in (("pair", pairs), ("term", sorted(terms, key=lambda x: (-x[0], x[1].encode()))[:top])):
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())))]
    return sorted(out)


def corpus():
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "B", "ü", "漢", "x" * 9, "Xy"]) * rng.randrange(1, 4) + rng.choice(["", "na", "nab", "nabc" * 12])
    rows = [(i, rng.choice([" ", "9", "_", "\x7f"]).join(word() for _ in range(rng.choice([0, 3, 40, 200]))), rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", "s2", None]), "x", 1) for i in range(150)]
    rows += [(i, "rare words of one document", "fr", f"s{i}", None, None) for i in range(2)]  # no kept term
    rows += [(900 + i, None if i % 2 else "", "it", f"s{i}", None, None) for i in range(3)]
    rows += [(None, "same twice Ärger", "es", "s", None, None)] * 3
    rows += [(7, "q" * 30_000 + " z", "en", "s9", None, None)] * 2 + [(8, "q" * 30_000, "en", "s8", None, None)]
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    got = sorted(tuple(r) for r in audit(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == brute(rows)
    assert {r[2] for r in got} == {"pair", "term"} and ("fr", "s0", "pair", "s1", 0, 1) in got and ("es", "s", "term") not in {r[:3] for r in got}


def test_blocks_units_and_ranks(spark, monkeypatch):
    rows = corpus()[:100]
    monkeypatch.setattr(divergence, "BLOCK", 20)
    monkeypatch.setattr(divergence, "UNIT_BYTES", 2000)
    monkeypatch.setattr(divergence, "AT_ONCE", 7)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(tuple(r) for r in audit(df, least_docs=2, top=3, first_width=1).collect()) == brute(rows, 2, 3)


def test_prefixes_of_too_few_documents_go(spark):
    rows = [(i, f"common{i % 2} solo{'xyz'[i % 3]}{i:c}tail once", "en", "s") for i in range(97, 103)] + [(1, "prefixone prefixtwo prefixthree prefixone", "en", "s")]
    found = units(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    first = prefix_counts(found, 4, None)
    assert first.filter("docs >= 3").count() == 3  # comm, once, solo: pref is in one document
    assert {r.term for r in kept_terms(found).collect()} == {"common", "once"}
    width, held = refined(found)
    assert width == 8 and divergence.passes(np.zeros(1, np.uint64), held.value).shape == (1,)


def test_counts_beyond_64_bits(spark):
    row = spark.createDataFrame([(10**13, 2 * 10**13, 5)], "n long, total long, v long")
    assert row.select(divergence._probability("n", "total")).first()[0] == 1 + 10**9 * (10**13 + 1) // (2 * 10**13 + 5)


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None, None)]])
def test_empty(spark, rows):
    assert audit(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_units_hold_what_words_take_for_a_run_of_texts_only(monkeypatch):
    """A unit of several runs is the same as one of a single run."""
    import pyarrow as pa

    from plinth.llm import divergence

    texts = [pa.array(["b a c", "", "A b b 1", "zz a", "c c c"]), pa.array(["x", "x", "", "y", "x"]), pa.array(["s", "t", "s", "s", "s"])]
    spans = []
    old = divergence.word_spans
    monkeypatch.setattr(divergence, "word_spans", lambda data, *a: (spans.append(len(data)), old(data, *a))[1])
    whole = divergence._unit(*texts)
    monkeypatch.setattr(divergence, "groups", lambda offsets: [(0, 2), (2, 3), (3, 5)])
    assert divergence._unit(*texts) == whole
    assert spans == [21, 5, 7, 9]


@pytest.mark.parametrize("dense", [0, 1 << 21])
def test_prefixes_are_looked_up_once_a_term_and_language(monkeypatch, dense):
    """The check: time goes with a unit's terms, not with the documents that hold them."""
    import pyarrow as pa

    monkeypatch.setattr(divergence, "DENSE", dense)
    rng = random.Random(5)
    words = ["alpha", "alphabet", "alpine", "beta", "betatron", "gamma", "gam"]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randrange(8))), "xy"[i % 2], "st"[i % 3 % 2]) for i in range(60)]
    (unit,) = divergence._units(iter([pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["t", "l", "s"])]))
    row = {n: unit.column(k)[0] for k, n in enumerate(unit.schema.names)}
    asked = []
    monkeypatch.setattr(divergence, "passes", lambda prints, held: (asked.append(len(prints)), np.ones(len(prints), bool))[1])
    for before in (None, (2, np.zeros(4, np.uint64))):
        _, docs, longest = divergence._prefixes(row, 4, before)
        want = {}
        for text, lang, _ in rows:
            for prefix in {w[:4] for w in text.split()}:
                want.setdefault((lang, prefix), [0, max(len(w) for t, l, _ in rows if l == lang for w in t.split() if w[:4] == prefix)])[0] += 1
        assert sorted(zip(docs.tolist(), longest.tolist())) == sorted(map(tuple, want.values()))
    assert asked == [2 * len(words)]


def test_units_make_row_groups_of_a_few(spark):
    """a task holds row groups whole, and a file has the more units the larger the input is."""
    import pyarrow.parquet as pq

    df = spark.range(5, numPartitions=1).selectExpr(f"repeat(concat('word', id, ' '), {divergence.UNIT_BYTES // 5}) AS text", "'en' AS lang", "'s' AS source")
    (file,) = units(df).inputFiles()
    held = pq.ParquetFile(file.removeprefix("file://")).metadata
    assert [held.row_group(i).num_rows for i in range(held.num_row_groups)] == [4, 1]
