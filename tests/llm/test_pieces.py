import random
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest

from plinth.llm.pieces import SCALE, Sampler, SamplingSettings, decode, encode
from plinth.llm.queries import tokenizer_file

FILE = tokenizer_file("piece_bpe_32k.model")


@lru_cache
def sampler(theta=1.5, seed=0):
    return Sampler(FILE, SamplingSettings(theta, seed))


def run(texts, keys, own=None):
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum(list(map(len, raw)))])
    ids, ends = (own or sampler()).encode(np.frombuffer(b"".join(raw), np.uint8), offsets, np.asarray(keys, np.uint64))
    return [x.tolist() for x in np.split(ids, ends[:-1])] if len(texts) else []


def ways(text, v):
    """Every segmentation of a text with its weight, by plain recursion."""
    data = (" " + text).encode()

    def go(at):
        if at == len(data):
            return [((), 1.0)]
        out = []
        for stop in range(at + 1, len(data) + 1):
            if (i := v.pieces.get(data[at:stop])) is not None:
                out += [((i, *rest), w * v.weight[i] / SCALE ** v.size[i]) for rest, w in go(stop)]
        char = next(data[at:s].decode() for s in range(at + 1, at + 5) if not (data[s : s + 1] and 0x80 <= data[s] < 0xC0))
        if char.encode() not in v.pieces:
            own = tuple(int(v.byte[b]) for b in char.encode())
            weight = np.prod([v.weight[i] / SCALE for i in own])
            out += [((*own, *rest), w * weight) for rest, w in go(at + len(char.encode()))]
        return out

    return dict(go(0))


@pytest.mark.parametrize("text", ["the cat", "an  end", "é漢𓀀", "a\nb", "x▁y", "    in"])
def test_draws_follow_the_weights(text):
    want = ways(text, sampler().v)
    total, n = sum(want.values()), 20_000
    got = Counter(map(tuple, run([text] * n, range(n))))
    assert set(got) <= set(want)
    chi = sum((got[w] - n * p / total) ** 2 / (n * p / total) for w, p in want.items() if n * p / total >= 5)
    cells = sum(n * p / total >= 5 for p in want.values())
    assert chi < cells + 5 * (2 * cells) ** 0.5 + 10


def odd_texts():
    rng = random.Random(6)
    signs = ["a", "the", "É", "漢", "7", "\n", "\t", "▁", "  ", "\0", "￾", "𓀀", "😀", "ing", "́", "\x85", "\xa0", "\r", "<s>", "<0x41>"]
    out = ["", " ", "  ", "\n", "▁", "a", " a ", "z" * 5000, "漢" * 400, "𓀀" * 200, " " * 1000, "ab" * 24, "word " * 20_000]
    return out + ["".join(rng.choice(signs) + rng.choice(["", " "]) for _ in range(rng.randrange(60))) for _ in range(400)]


def test_lossless_and_independent_of_batches():
    texts = odd_texts()
    keys = [i * 7919 for i in range(len(texts))]
    got = run(texts, keys)
    own = sampler()
    ids, ends = np.array([i for x in got for i in x]), np.cumsum(list(map(len, got)))
    data, stops = own.decode(ids, ends)
    raw = [t.encode() for t in texts]
    assert data.tobytes() == b"".join(raw) and stops.tolist() == np.cumsum(list(map(len, raw))).tolist()
    order = list(range(len(texts)))
    random.Random(1).shuffle(order)
    for part in (order[:200], order[200:201], order[201:]):
        assert run([texts[i] for i in part], [keys[i] for i in part]) == [got[i] for i in part]
    assert run(texts, keys, Sampler(FILE, SamplingSettings(seed=1))) != got


def test_long_units_draw_as_short_ones_do(monkeypatch):
    texts = [t for t in odd_texts() if len(t) < 2000]
    want = run(texts, range(len(texts)))
    monkeypatch.setattr("plinth.llm.pieces.UNIT_BYTES", 0)
    assert run(texts, range(len(texts))) == want


def test_plain_decoder_agrees():
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=FILE)
    texts = [t for t in odd_texts() if t and "\0" not in t]
    assert [model.decode(x) for x in run(texts, range(len(texts)))] == texts


def test_operator(spark):
    texts = [None, *odd_texts()]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(None, "no key", 1), (None, "no key", 2), (5, "again", 3), (5, "again", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_pieces int")
    got = encode(df, FILE)
    found = got.collect()
    assert len(found) == len(rows) and all(r.lossless for r in found)
    want = run([t or "" for _, t, _ in rows], [(-1 if i is None else i) % 2**64 for i, *_ in rows])
    key = lambda i, x: (-1 if i is None else i, tuple(x))
    assert sorted(key(r.doc_id, np.frombuffer(r.pieces, "<u4").tolist()) for r in found) == sorted(key(i, x) for (i, *_), x in zip(rows, want))
    assert Counter((r.doc_id, r.text) for r in decode(got, FILE).collect()) == Counter((i, t or "") for i, t, _ in rows)


@pytest.mark.parametrize("rows", [[], [(None, None)]])
def test_empty(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [(r.n_pieces, bytes(r.pieces), r.lossless) for r in encode(df, FILE).collect()] == [(0, b"", True)] * len(rows)
