"""Token ids in binary files, Huffman-coded.

Texts are encoded once, and the ids staged. Counts of all ids make one canonical length-limited code; the ids are then
dealt out by ranges of document ids, and every task streams its documents, in order, into a file of its own: coded blocks,
then a footer with the code's lengths, the documents' ids and sizes and each block's bit offset. A reader needs the footer
and the blocks it wants, nothing else.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from plinth.llm.common import differ, distinct_spans, groups, prepare, span_hashes, tidy, utf8
from plinth.llm.files import new_file, old_file
from plinth.llm.huffman import BLOCK, Code, code_lengths
from plinth.session import scratch_path, staged

MAGIC = b"PLNTHUF1"
#: Ids of a file, about.
SHARD_IDS = 16_000_000
#: Bytes of text that are encoded together.
RUN_BYTES = 4 << 20
#: Tasks that read files; each reads its share.
MOST_TASKS = 10_000
#: Ids that are coded or decoded at once.
PIECE = BLOCK * 2048


class ChunkEncoder:
    """Encodes texts chunk by chunk, each distinct chunk once.

    A byte-level BPE first cuts a text by a pattern in which a run of letters, digits or signs takes one space before it
    along. So wherever one space stands between two characters that aren't white space, a cut is certain, and what is
    left and right of it is encoded as if it stood alone. (Cuts are made only where neighbouring bytes rule white space
    beyond ASCII out, too; fewer cuts do no harm.) Known chunks are looked up by a hash and compared by their bytes; what a batch
    brings that isn't known is encoded as one text, whose ids fall to the chunks by their sizes.
    """

    #: Known chunks; beyond that all are forgotten.
    MOST = 1_000_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = np.zeros(max(names.values()) + 1, np.int64)  # bytes of each id; a character of its name stands for a byte
        for name, i in names.items():
            self.size[i] = len(name)
        self.clear()

    def clear(self) -> None:
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # hashes, ascending, and the chunk's number
        self.text, self.begin = np.zeros(0, np.uint8), np.zeros(1, np.int32)  # the bytes of all chunks by number
        self.edge, self.ids = np.zeros(1, np.int32), np.zeros(0, np.uint16 if len(self.size) <= 1 << 16 else np.int32)

    #: Bytes that are no white space by themselves; and those that may begin or end white space beyond ASCII.
    PLAIN = np.zeros(256, bool)
    PLAIN[33:127] = True
    LEAD = np.zeros(256, bool)
    LEAD[0xC3:0xE0] = True

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Places of spaces at which a chunk begins."""
        at = np.flatnonzero(data == 32)
        at = at[(at > 1) & (at < len(data) - 1)]
        before, after = data[at - 1], data[at + 1]
        left = self.PLAIN[before] | ((before >= 0x80) & (before < 0xC0) & self.LEAD[data[at - 2]])
        return at[left & (self.PLAIN[after] | self.LEAD[after])]

    def learn(self, chunks: list[bytes], alone: np.ndarray) -> np.ndarray:
        """Encode chunks that aren't known; those marked alone may not stand before another one. Their numbers."""
        join = np.flatnonzero(~alone)
        text = b"".join([chunks[i] for i in join.tolist()]).decode()
        own = self.tokenizer.encode_batch_fast([text, *(chunks[i].decode() for i in np.flatnonzero(alone).tolist())], add_special_tokens=False)
        parts = [np.array(x.ids, np.int32) for x in own]
        stops = np.cumsum([len(chunks[i]) for i in join.tolist()])
        count = np.zeros(len(chunks), np.int64)
        reach = np.cumsum(self.size[parts[0]])
        last = np.searchsorted(reach, stops)
        if len(stops) and not (reach[last] == stops).all():
            raise ValueError("an id reaches over a certain cut")
        count[join] = np.diff(last + 1, prepend=0)
        count[alone] = [len(x) for x in parts[1:]]
        order = np.concatenate([join, np.flatnonzero(alone)])
        number = np.empty(len(chunks), np.int64)
        number[order] = np.arange(len(self.edge) - 1, len(self.edge) - 1 + len(chunks))
        self.edge = np.concatenate([self.edge, (self.edge[-1] + np.cumsum(count[order])).astype(np.int32)])
        self.ids = np.concatenate([self.ids, *(x.astype(self.ids.dtype) for x in parts)])
        self.text = np.concatenate([self.text, np.frombuffer(b"".join([chunks[i] for i in order.tolist()]), np.uint8)])
        self.begin = np.concatenate([self.begin, (self.begin[-1] + np.cumsum([len(chunks[i]) for i in order.tolist()])).astype(np.int32)])
        return number

    def known(self, data: np.ndarray, a: np.ndarray, b: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of chunks, -1 for those that aren't known, and which hashes are taken."""
        if not len(self.keys):
            return np.full(len(a), -1), np.zeros(len(a), bool)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        number, taken = self.place[at].astype(np.int64), self.keys[at] == hashes
        size = b - a
        hit = np.flatnonzero(taken & (self.begin[number + 1] - self.begin[number] == size))
        hit = hit[~differ(data, a[hit], self.text, self.begin[number[hit]], size[hit])]
        out = np.full(len(a), -1)
        out[hit] = number[hit]
        return out, taken

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each ends. Texts are bytes between offsets."""
        if len(self.edge) > self.MOST or max(len(self.text), len(self.ids)) + len(data) > 1 << 28:
            self.clear()
        if not len(data):
            return self.ids[:0], np.zeros(len(offsets) - 1, np.int64)
        begins = np.zeros(len(data) + 1, bool)
        begins[self.cuts(data)] = True
        # A space that is a text's first or last byte stands next to another text's end: no cut.
        begins[offsets] = begins[np.maximum(offsets - 1, 0)] = False
        heads = offsets[:-1][np.diff(offsets) > 0]
        begins[heads] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))
        code, first = distinct_spans(data, starts, ends)
        a, b = starts[first], ends[first]
        hashes = span_hashes(data, a, b)
        number, taken = self.known(data, a, b, hashes)
        new = np.flatnonzero(number < 0)
        if len(new):
            begins[:] = False
            begins[heads] = True
            # What stands at a text's head, or ends otherwise than a certain cut allows, isn't joined to others.
            alone = begins[a[new]] | ~(self.PLAIN[data[b[new] - 1]] | ((data[b[new] - 1] >= 0x80) & self.LEAD[data[np.maximum(b[new] - 2, 0)]]))
            raw = data.tobytes()
            number[new] = self.learn([raw[i:j] for i, j in zip(a[new].tolist(), b[new].tolist())], alone)
            # One chunk of each hash is found again; another with the same hash is encoded each time.
            keys, pick = np.unique(hashes[new[~taken[new]]], return_index=True)
            place = number[new[~taken[new]]][pick]
            at = np.searchsorted(self.keys, keys)
            self.keys, self.place = np.insert(self.keys, at, keys), np.insert(self.place, at, place.astype(np.int32))
        codes = number[code]
        begin = self.edge[codes].astype(np.int64)
        size = self.edge[codes + 1] - begin
        total = np.cumsum(size)
        pick = np.repeat(begin - (total - size), size) + np.arange(total[-1])
        return self.ids[pick], np.concatenate([[0], total])[np.searchsorted(starts, offsets[1:])]


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """This process's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def encoded(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, width: int = 4) -> DataFrame:
    """(id long, ids binary): each row's ids as little-endian unsigned numbers of ``width`` bytes, ``end_id`` last. A null text is empty:
    its ids are the end id alone. Rows with null or repeated ids stay."""
    prepare(df)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = utf8(batch.column(1))
            runs = [own.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in groups(offsets, RUN_BYTES)]
            ids, ends = np.concatenate([x for x, _ in runs]), np.cumsum(np.concatenate([np.diff(e, prepend=0) for _, e in runs]))
            where = np.ones(len(ids) + len(ends), bool)
            where[ends + np.arange(len(ends))] = False
            out = np.full(len(where), end_id, f"<u{width}")
            out[where] = ids
            ids = out
            ends = width * (ends + np.arange(1, len(ends) + 1))
            offsets = np.concatenate([[0], ends]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])], ["id", "ids"])

    return df.select(df[id_col].cast("long"), df[text_col].cast("string")).mapInArrow(tidy(kernel), "id bigint, ids binary")


def id_counts(narrow: DataFrame, width: int, vocabulary: int) -> np.ndarray:
    """How often each id occurs. Tasks send a row for each id they saw; the driver gets one for each id of the vocabulary."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), f"<u{width}"), minlength=vocabulary) if len(x.as_buffer()) > 2 * vocabulary else 0
            small = [np.frombuffer(x.as_buffer(), f"<u{width}") for x in batch.column(0) if len(x.as_buffer()) <= 2 * vocabulary]
            if small:
                total += np.bincount(np.concatenate(small), minlength=vocabulary)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["sym", "n"])

    out = np.zeros(vocabulary, np.int64)
    for row in narrow.select("ids").mapInArrow(tidy(kernel), "sym bigint, n bigint").groupBy("sym").agg(F.sum("n").alias("n")).collect():
        out[row["sym"]] = row["n"]
    return out


class ShardWriter:
    """Streams documents into one file."""

    def __init__(self, out, code: Code):
        self.out, self.code = out, code
        self.place = out.write(MAGIC) or len(MAGIC)
        self.pending: list[np.ndarray] = []
        self.waiting = self.total = 0
        self.blocks: list[np.ndarray] = []
        self.docs: list[int | None] = []
        self.sizes: list[int] = []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.sizes.append(len(ids))
        self.pending.append(ids)
        self.waiting += len(ids)
        if self.waiting >= PIECE:
            self.flush(self.waiting // BLOCK * BLOCK)

    def flush(self, n: int) -> None:
        flat = np.concatenate(self.pending) if self.pending else np.zeros(0, np.int32)
        for low in range(0, n, PIECE):
            data, offsets = self.code.encode(flat[low : min(low + PIECE, n)])
            self.blocks.append(offsets + 8 * self.place)
            self.out.write(data)
            self.place += len(data)
        self.pending, self.waiting = [flat[n:]], len(flat) - n
        self.total += n

    def close(self) -> None:
        self.flush(self.waiting)
        parts = {
            "lengths": self.code.lengths.tobytes(),
            "docs": np.array([-1 if d is None else d for d in self.docs], "<i8").tobytes(),
            "null": np.packbits(np.array([d is None for d in self.docs], bool)).tobytes(),
            "sizes": np.array(self.sizes, "<u8").tobytes(),
            "blocks": np.concatenate([np.zeros(0, np.int64), *self.blocks]).astype("<u8").tobytes(),
        }
        packed = {k: zlib.compress(v, 6) for k, v in parts.items()}
        head = json.dumps({"block": BLOCK, "ids": self.total, "docs": len(self.docs), "end": self.place, "parts": {k: len(v) for k, v in packed.items()}}).encode()
        self.out.write(b"".join([*packed.values(), head, len(head).to_bytes(4, "little"), MAGIC]))


class ShardReader:
    """Reads one file: its footer at once, coded blocks as asked."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        tail = self.at(size - 12, 12)
        if tail[4:] != MAGIC:
            raise ValueError("not a file of coded ids")
        n = int.from_bytes(tail[:4], "little")
        self.head = json.loads(self.at(size - 12 - n, n))
        place, parts = self.head["end"], {}
        for name, length in self.head["parts"].items():
            parts[name] = zlib.decompress(self.at(place, length))
            place += length
        self.code = Code(np.frombuffer(parts["lengths"], np.uint8))
        null = np.unpackbits(np.frombuffer(parts["null"], np.uint8))[: self.head["docs"]].astype(bool)
        self.docs = [None if x else d for d, x in zip(np.frombuffer(parts["docs"], "<i8").tolist(), null.tolist())]
        self.edge = np.concatenate([[0], np.cumsum(np.frombuffer(parts["sizes"], "<u8").astype(np.int64))])
        self.blocks = np.frombuffer(parts["blocks"], "<u8").astype(np.int64)

    def at(self, place: int, n: int) -> bytes:
        self.source.seek(place)
        return self.source.read(n)

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids of blocks first to last (excluded)."""
        n = min(last * self.head["block"], self.head["ids"]) - first * self.head["block"]
        if n <= 0:
            return np.zeros(0, np.int32)
        begin = int(self.blocks[first]) // 8
        end = int(self.blocks[last]) // 8 + 1 if last < len(self.blocks) else self.head["end"]
        return self.code.decode(self.at(begin, end - begin), self.blocks[first:last] - 8 * begin, n, self.head["block"])

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, place of its first id, ids) of each document, in the file's order; blocks are decoded a piece at a time."""
        step, have, low = PIECE // self.head["block"], np.zeros(0, np.int32), 0
        block = 0
        for i, doc in enumerate(self.docs):
            a, b = int(self.edge[i]), int(self.edge[i + 1])
            got = [have]
            while low + sum(map(len, got)) < b:
                if block >= len(self.blocks):
                    raise ValueError("the file ends before its last document")
                got.append(self.ids(block, block + step))
                block += step
            if len(got) > 1:
                have, low = np.concatenate([have[a - low :], *got[1:]]), a
            yield doc, a, have[a - low : b - low]


def write_ids(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, end_id: int = 0, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode all texts and write them to files; the manifest: (shard, path, docs, ids, bytes), shards in ascending id order.

    Rows with null ids come first; rows that repeat an id stand together, in any order of their own. No rows give no files.
    Files hold nearly equal numbers of rows, whatever the ids: where one id has many rows, they go to several files.
    """
    from tokenizers import Tokenizer

    spark = prepare(df)
    folder = folder or scratch_path(spark, "token-files")
    vocabulary = max(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True), end_id + 1)
    width = 2 if vocabulary <= 1 << 16 else 4
    own = staged(encoded(df, tokenizer, id_col, text_col, end_id, width).withColumn("row", F.monotonically_increasing_id()), "token-ids")
    counts = id_counts(own, width, vocabulary)
    code = spark.sparkContext.broadcast(code_lengths(counts))  # a byte for each id of the vocabulary

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        shard = TaskContext.get().partitionId()
        with new_file(folder, f"ids-{shard:06d}", ".plh") as (out, path):
            writer = ShardWriter(out, Code(code.value))
            batch = first
            while batch is not None:
                for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                    writer.add(doc, np.frombuffer(ids.as_buffer(), f"<u{width}").astype(np.int32))
                batch = next(batches, None)
            writer.close()
            row = [shard, path, len(writer.docs), writer.total, out.tell()]
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["shard", "path", "docs", "ids", "bytes"])

    shards = max(1, -(-int(counts.sum()) // shard_ids))
    order = [F.col("id").asc_nulls_first(), F.col("row").asc()]
    dealt = own.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    return staged(dealt.mapInArrow(tidy(kernel), "shard bigint, path string, docs bigint, ids bigint, bytes bigint"), "manifest")


def read_ids(manifest: DataFrame) -> DataFrame:
    """(id, start, ids) of every document in the files of a manifest: start is the number of ids of all documents before
    it, ids are little-endian unsigned 32-bit numbers."""
    files = manifest.count()
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    placed = manifest.select("path", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start")).repartition(min(max(files, 1), MOST_TASKS))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs, begin, own, size = [], [], [], 0
                with old_file(path) as source:
                    for doc, a, ids in ShardReader(source).documents():
                        docs.append(doc)
                        begin.append(start + a)
                        own.append(ids.astype("<u4").tobytes())
                        size += len(ids)
                        if size >= PIECE:
                            yield out(docs, begin, own)
                            docs, begin, own, size = [], [], [], 0
                yield out(docs, begin, own)

    def out(docs: list, begin: list, own: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(begin, pa.int64()), pa.array(own, pa.binary())], ["id", "start", "ids"])

    return placed.mapInArrow(tidy(kernel), "id bigint, start bigint, ids binary")
