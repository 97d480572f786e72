import random
import re

import pytest
import xxhash

from plinth.operators.components import components
from plinth.llm.simhash import fingerprint, links, near_duplicates

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_print(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, joined):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in joined:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("crowd", [1, 4, 64])
def test_links_keep_components(spark, crowd):
    rng = random.Random(crowd)
    prints = {0, (1 << 64) - 1, 1 << 63, 5}
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(25):
            prints.add(x)
            for _ in range(rng.choice([1, 1, 2, 2, 3])):
                x ^= 1 << rng.randrange(64)
    base = rng.getrandbits(64)
    prints |= {base ^ (1 << rng.randrange(10)) ^ (1 << rng.randrange(10)) for _ in range(60)}
    want = brute_components(prints, [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2])
    edges = links(spark.createDataFrame([(signed(x),) for x in prints], "fp long"), crowd)
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in edges.collect())
    got = {a: c for a, c in components(edges).collect()}
    classes = lambda m: sorted(sorted(signed(x) if x >= 0 else x for x in m if m[x] == c) for c in set(m.values()))
    assert classes({x: got.get(signed(x), signed(x)) for x in prints}) == classes(want)


def test_long_chain_and_hub(spark):
    chain = [(i, i + 1) for i in range(300)]
    hub = [(1000, i) for i in range(1001, 1400)]
    got = dict(components(spark.createDataFrame(chain + hub + chain[:5] + [(7, 7)], "a long, b long")).collect())
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1400)}


def texts():
    rng = random.Random(2)
    out = [None, "", " \n", "One", "one", "ONE two", "É x", "é x", "a\x85b c\xa0d e", "x " * 200_000]
    for _ in range(40):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.choice([5, 50, 400]))]
        out += [" ".join(words), "\n".join(words).upper(), " ".join(words[:-1]), " ".join(words)]
    return out


def test_fingerprints_and_components(spark):
    rows = [(i * 3 % 171 + 4, t, None, i) for i, t in enumerate(texts())] + [(None, "one", "z", 1), (None, "nothing like it", "z", 1), (12, "one", "z", 1), (12, "one", "z", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    prints = [(i, brute_print(t)) for i, t, *_ in rows]
    known = {p for _, p in prints}
    comp = brute_components(known, [(a, b) for a in known for b in known if a < b and (a ^ b).bit_count() <= 2])
    least = {}
    for i, p in prints:
        if i is not None:
            least[comp[p]] = min(i, least.get(comp[p], i))
    want = sorted([(i, f"{p:016x}", least.get(comp[p])) for i, p in prints], key=str)
    assert sorted(map(tuple, near_duplicates(df).collect()), key=str) == want


def test_fingerprint_strips(monkeypatch):
    monkeypatch.setattr("plinth.llm.simhash.STRIP", 7)
    text = " ".join(f"w{i * i % 37}" for i in range(100))
    assert fingerprint(text.encode()) == brute_print(text)


@pytest.mark.parametrize("rows", [[], [(None, None)]])
def test_empty(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [tuple(r) for r in near_duplicates(df).collect()] == [(None, "0" * 16, None)] * len(rows)
