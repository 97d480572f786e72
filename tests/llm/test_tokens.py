import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from plinth.llm.files import old_file
from plinth.llm.queries import tokenizer_file
from tests.llm.test_common import thue_morse
from plinth.llm.tokens import ChunkEncoder, ShardReader, read_ids, write_ids

FILE = tokenizer_file("byte_bpe_50k.json")


def texts():
    rng = random.Random(4)
    signs = ["a", "Z", "é", "漢", "7", "'s", "!", "\n", "\t", "\x1c", "\x85", "\xa0", "᠎", " ", "​", "don't", "word", "<|endoftext|>", "́", "😀"]
    out = [None, "", " ", "  ", " a", "a ", "a  b", "a \n b", "the<|endoftext|> end", "x" * 70_000, "many words " * 30_000]
    a, b = thue_morse(2048)
    out += [f"xx {a} {b} yy", f"xx {b} yy", f"{a} {a}", "of <|endoftext|> it", " <|endoftext|>", "<|endoftext|><|endoftext|> x"]
    for _ in range(400):
        out.append("".join(rng.choice(signs) + rng.choice(["", " ", " ", "  "]) for _ in range(rng.randrange(40))))
    return out


def plain():
    return Tokenizer.from_file(FILE)


def test_chunks_encode_as_whole_texts_do():
    own, given = ChunkEncoder(FILE), texts()
    raw = [(t or "").encode() for t in given]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum(list(map(len, raw)))])
    want = [x.ids for x in plain().encode_batch([t or "" for t in given], add_special_tokens=False)]
    for _ in range(2):
        ids, ends = own.encode(data, offsets)
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == want
    own.MOST = 1
    assert own.encode(data, offsets)[0].tolist() == ids.tolist()
    for i in range(len(raw)):
        assert own.encode(np.frombuffer(raw[i], np.uint8), np.array([0, len(raw[i])]))[0].tolist() == want[i]


def test_weak_hashes_change_nothing(monkeypatch):
    weak = lambda d, s, e: ((e - s) % 3).astype(np.uint64)
    monkeypatch.setattr("plinth.llm.common.span_hashes", weak)
    monkeypatch.setattr("plinth.llm.tokens.span_hashes", weak)
    own, given = ChunkEncoder(FILE), [t or "" for t in texts() if not t or len(t) < 5000]
    raw = [t.encode() for t in given]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum(list(map(len, raw)))])
    want = [x.ids for x in plain().encode_batch(given, add_special_tokens=False)]
    for _ in range(2):
        ids, ends = own.encode(data, offsets)
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == want


@pytest.mark.parametrize("shard_ids", [16_000_000, 40_000])
def test_files_round_trip(spark, shard_ids):
    given = texts()
    order = list(range(len(given)))
    random.Random(1).shuffle(order)
    rows = [(i * 2 - 60, given[i], "x") for i in order] + [(None, "no id", "y"), (40, "again", "y"), (40, "again", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    manifest = write_ids(df, FILE, shard_ids=shard_ids)
    assert manifest.count() > (1 if shard_ids < 10**6 else 0)
    got = read_ids(manifest).orderBy("start").collect()
    assert len(got) == len(rows)
    tokenizer, start = plain(), 0
    own = {}
    for i, t, _ in rows:
        own.setdefault(i, []).append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])
    last = None
    for row in got:
        ids = np.frombuffer(row.ids, "<u4").tolist()
        assert ids in own[row.id]
        assert row.start == start
        assert last is None or row.id >= last
        start, last = start + len(ids), row.id
    with old_file(manifest.first()["path"]) as source:
        reader = ShardReader(source)
        alone = reader.ids(1, 2)
        assert alone.tolist() == reader.ids(0, 3)[512:1024].tolist()


def test_rows_of_one_id_go_to_several_files(spark):
    rows = [(None if i % 5 else i, f"text number {i % 3}") for i in range(1000)] + [(7, "again")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = write_ids(df, FILE, shard_ids=600)
    docs = [r.docs for r in manifest.collect()]
    assert len(docs) > 5 and max(docs) < 2 * sum(docs) / len(docs)
    got = read_ids(manifest).orderBy("start").collect()
    assert [r.id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert read_ids(write_ids(none, FILE)).collect() == []
    null = spark.createDataFrame([(None, None)], "doc_id long, text string")
    assert [(r.id, r.start, bytes(r.ids)) for r in read_ids(write_ids(null, FILE)).collect()] == [(None, 0, b"\0\0\0\0")]
