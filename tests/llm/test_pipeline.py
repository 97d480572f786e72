import random
from pathlib import Path

import numpy as np

import __spark_entry__ as entry
import corpus_pipeline
from plinth.llm import langid
from plinth.llm.pieces import decode
from plinth.llm.queries import tokenizer_file
from tests.llm.test_decontaminate import brute as contamination
from tests.llm.test_quality import brute as quality
from tests.llm.test_similar import brute as similar


def fixture(spark, folder):
    rng = random.Random(12)
    word = lambda lang: "".join(rng.choice({"en": "thaoeinrs", "de": "eichnstügr"}[lang]) for _ in range(rng.randrange(2, 8)))
    items = [(i, " ".join(word("en") for _ in range(30))) for i in range(5)]
    docs = []
    for i in range(240):
        lang = rng.choice(["en", "de"])
        words = [word(lang) for _ in range(rng.choice([20, 80, 300]))]
        if i % 10 == 3:
            words = (words[:9] * 40)[:300]
        if i % 11 == 5:
            words[5:5] = items[i % 5][1].split()
        docs.append((i, " ".join(words), lang, f"s{i % 3}", 0))
    docs += [(1000 + i, docs[i][1] + (" end" if i % 2 else ""), docs[i][2], None, None) for i in range(40)]
    docs += [(2000, None, None, None, None), (2001, "", "en", "s", 1), (2002, "12 34 " * 40, "en", "s", 1), (7, docs[7][1], docs[7][2], "s1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, items


def test_run_against_brute_force(spark, tmp_path):
    docs, items = fixture(spark, tmp_path)
    left = [r for r in docs if quality(r[1])[-1]]
    assert 0 < len(left) < len(docs)
    frame = spark.createDataFrame(left, "doc_id long, text string, lang string, source string, n_chars long")
    model = langid.train(frame)
    accepted = model.accepts(*model.predict(__import__("pyarrow").array([r[1] for r in left])))
    left = [r for r, ok in zip(left, accepted) if ok]
    kept, comp = similar([r[:2] for r in left])
    first = {c: min((r for i, r in enumerate(left) if comp[i] == c), key=lambda r: r[0]) for c in kept}
    assert len(first) < len(left)
    clean = {r[0]: r for r in first.values() if not contamination(r[1], items)[-1]}
    assert len(clean) < len(first)
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = out.collect()
    assert sorted(r.doc_id for r in got) == sorted(clean)
    assert all(r.lossless and r.source == clean[r.doc_id][3] and r.n_pieces == len(np.frombuffer(r.pieces, "<u4")) for r in got)
    text = {r.doc_id: r.text for r in decode(out, tokenizer_file("piece_bpe_32k.model")).collect()}
    assert text == {i: r[1] for i, r in clean.items()}


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    fixture(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_entry_has_all_eleven():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
    assert "except" not in Path(corpus_pipeline.__file__).read_text()
