import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from plinth.llm.quality import RepetitionRules, judged, keep_clean, repetition_report
from tests.llm.test_common import thue_morse

WORD = re.compile("[^\x20\x09-\x0d]+")


def covered(words, size):
    grams = Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    return {j for i in range(len(words) - size + 1) if grams[tuple(words[i : i + size])] > 1 for j in range(i, i + size)}


def brute(text, rules=RepetitionRules()):
    text = text or ""
    words = WORD.findall(text)
    seen, dup_lines, dup_line_chars = set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            if line in seen:
                dup_lines += 1
                dup_line_chars += sum(map(len, WORD.findall(line)))
            seen.add(line)
    chars, symbols, again = sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(covered(words, 3))
    shares = {n: sum(len(words[j]) for j in covered(words, n)) for n in rules.gram_share}
    base = len(words) < rules.min_words or 100 * again > rules.max_repeat_words_percent * len(words)
    bad = symbols > rules.symbol_share * chars or dup_line_chars > rules.line_share * chars or any(shares[n] > s * chars for n, s in rules.gram_share.items())
    return (len(words), chars, symbols, dup_lines, again, dup_line_chars, *(shares[n] for n in sorted(shares)), base, not base and not bad)


def texts():
    rng = random.Random(5)
    out = [None, "", " ", "\n", "\n\n", "a", "a\n", "\na", "a b c a b c", "x\x85y\xa0z \x1c", "é ü\r\nü é\r\né ü", "a\n a\na\na ", "# | *"]
    for _ in range(300):
        n, v = rng.choice([3, 40, 80, 400]), rng.choice([2, 5, 30, 1000])
        out.append("".join(f"{rng.choice(['w', 'é', 'Ü', '|', '漢'])}{rng.randrange(v)}{rng.choice([' ', ' ', ' ', '  ', chr(10), chr(9)])}" for _ in range(n)))
    line = " ".join(f"q{i}" for i in range(30))
    a, b = thue_morse(2048)
    out += [f"{a}\n{b}", f"{a}\n{b}\n{a}", f"{a} x {b} y {a} x {b} z", f"{a} p q {b} p q", "in it\n" * 2 + f"{a}\n" * 3]
    out += [f"{line}\n{line}\nrest", "long " * 300_000, "z" * 3_000_000 + " end"]
    return out


def test_against_brute_force(spark):
    rows = [(i, t, "x", True) for i, t in enumerate(texts())]
    rows += [(None, "a b", None, None), (7, "again again", "y", None), (7, "again again", "y", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string, kept boolean")
    got = sorted((tuple(r) for r in repetition_report(df).collect()), key=str)
    assert got == sorted(((i, *brute(t)) for i, t, *_ in rows), key=str)


def test_keep_clean_passes_columns_on(spark):
    words = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, words, "a"), (2, "short", "b"), (3, None, None)], "doc_id long, text string, kept string")
    assert [tuple(r) for r in keep_clean(df).collect()] == [(1, words, "a")]
    assert keep_clean(df).schema == df.schema


def test_weak_hashes_change_nothing(monkeypatch):
    own = [t for t in texts() if t and len(t) < 5000]
    want = [brute(t) for t in own]
    monkeypatch.setattr("plinth.llm.quality.span_hashes", lambda d, s, e: ((e - s) % 2).astype(np.uint64))
    got = judged(pa.array(own), RepetitionRules())
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_chars_{n}" for n in range(5, 11)), "base_failed", "kept"]
    assert list(zip(*(got[n].tolist() for n in names))) == want


@pytest.mark.parametrize("rows", [[], [(None, None)]])
def test_empty(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert repetition_report(df).count() == len(rows)
