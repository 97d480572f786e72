import numpy as np

from plinth.llm import common
from plinth.llm.common import distinct_spans, repeats, span_hashes, unequal


def thue_morse(n):
    """The Thue-Morse word of n letters and its complement: polynomial hashes modulo a power of two don't tell them apart."""
    bits = [i.bit_count() & 1 for i in range(n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


def spans(words):
    raw = [w.encode() for w in words]
    size = np.array(list(map(len, raw)), np.int64)
    ends = np.cumsum(size)
    return np.frombuffer(b"".join(raw), np.uint8), ends - size, ends


def words():
    rng = np.random.default_rng(3)
    out = ["", "", "a", "é", *thue_morse(2048), *thue_morse(1024), "x" * 31, "x" * 32, "x" * 33, "x" * 40]
    return out + ["".join(rng.choice(list("ab"), rng.integers(0, 45))) for _ in range(3000)] + out


def test_distinct_spans_are_those_of_bytes(monkeypatch):
    own = words()
    for weak in (False, True):
        if weak:  # a hash that tells almost nothing apart
            monkeypatch.setattr(common, "span_hashes", lambda d, s, e: ((e - s) % 3).astype(np.uint64))
        code, first = distinct_spans(*spans(own))
        assert len(first) == len(set(own)) and all(own[first[c]] == w for c, w in zip(code.tolist(), own))


def test_repeats_with_weak_keys():
    own = words()
    data, starts, ends = spans(own)
    want = [own.count(w) > 1 for w in own], [w in own[:i] for i, w in enumerate(own)]
    same = lambda i, j: ~unequal(data, starts, ends, i, j)
    for keys in (span_hashes(data, starts, ends), ((ends - starts) % 5).astype(np.uint64)):
        again, later = repeats(keys, same, lambda i: own[i])
        assert (again.tolist(), later.tolist()) == want


def test_hashes_do_not_depend_on_place():
    data, starts, ends = spans(["q" * 7, "same words here", "z", "same words here", "", "é" * 30, "é" * 30])
    h = span_hashes(data, starts, ends)
    assert h[1] == h[3] and h[5] == h[6] and len(set(h.tolist())) == 5
