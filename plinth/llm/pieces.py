"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

The lattice of a text has an edge for each piece that stands somewhere in it. Forward filtering sums the weights of all
ways to each position; backward sampling then walks from the end, taking each edge with its share, so that a segmentation
comes out with probability in proportion to its weight. What is drawn is fixed by the row's key, the place in the text and
a seed: any run, on any cluster, gives the same segmentation.

Where two neighbouring bytes stand next to each other in no piece, no edge passes, so the lattice falls apart there into
units, mostly words with the space before them. The distinct units of a few MB of text are filtered together in numpy, one
byte position of all units at a time, and so are the draws, one piece of all units at a time.

The vocabulary's scores are ranks of merges, not probabilities. A piece of rank r weighs (r + 1) ** -theta, a Zipf law:
frequent pieces are likelier, and few pieces likelier than many. A character without a piece is spelled in byte pieces, and
so is a literal U+2581, the sign that stands for a space: that is what keeps decoding lossless.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plinth.llm.common import BYTE_VALUES, distinct_spans, groups, mix, prepare, tidy, utf8

SPACE = "\u2581"
#: Bytes of text whose units are filtered together.
RUN_BYTES = 1 << 18
#: Units of more bytes are filtered alone, with weights rescaled as they go.
UNIT_BYTES = 48
#: All ways over the same bytes gain this factor for each byte, which keeps sums of products within a float's range.
SCALE = 100.0


@dataclass(frozen=True)
class SamplingSettings:
    theta: float = 1.5
    seed: int = 0


class Vocabulary:
    """Pieces of a model by their bytes (spaces as spaces), with weights; a hash table of them and of all their prefixes."""

    STEP = np.uint64(0x9E3779B97F4A7C15)
    BITS = 18

    def __init__(self, path: str, theta: float):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        first = special.index(False)
        spelled, self.byte, self.pieces = [b""] * n, np.zeros(256, np.int32), {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                spelled[i] = bytes([int(piece[3:5], 16)])
                self.byte[spelled[i][0]] = i
            elif not special[i]:
                spelled[i] = piece.replace(SPACE, " ").encode()
                self.pieces[spelled[i]] = i
        self.size = np.array(list(map(len, spelled)), np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)
        rank = np.where(special, n, np.arange(n) - first)  # a byte piece is rarer than any other
        self.weight = (rank + 1.0) ** -theta * SCALE**self.size
        self.longest = max(map(len, self.pieces))
        self.joined = np.zeros(1 << 16, bool)  # byte pairs that stand within a piece
        known: dict[bytes, int] = {}
        for piece, i in self.pieces.items():
            raw = np.frombuffer(piece, np.uint8).astype(np.int64)
            self.joined[raw[:-1] * 256 + raw[1:]] = True
            for k in range(1, len(piece)):
                known.setdefault(piece[:k], -1)
            known[piece] = i
        hashes = np.array([self.hash(x) for x in known], np.uint64)
        slot = (hashes >> np.uint64(64 - self.BITS)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        nth = np.arange(len(order)) - np.searchsorted(slot[order], slot[order])
        self.keys = np.zeros((int(nth.max()) + 1, 1 << self.BITS), np.uint64)
        self.values = np.zeros(self.keys.shape, np.int32)
        self.keys[nth, slot[order]] = hashes[order]
        self.values[nth, slot[order]] = np.array(list(known.values()), np.int32)[order]

    def hash(self, piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * int(self.STEP) + int(BYTE_VALUES[b])) & (1 << 64) - 1
        return h

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Id of each piece, -1 for what is only a prefix of pieces, -2 for all else."""
        slot = (hashes >> np.uint64(64 - self.BITS)).astype(np.int64)
        out = np.full(len(hashes), -2, np.int32)
        left = np.arange(len(hashes))
        for keys, values in zip(self.keys, self.values):
            at = slot[left]
            key = keys[at]
            hit = key == hashes[left]
            out[left[hit]] = values[at[hit]]
            left = left[~hit & (key != 0)]
            if not len(left):
                break
        return out


class Lattice:
    """Filtered lattices of many units. Node ``base[u] + p`` is byte p of unit u; ``key`` ascends over all edges, grouped by
    the node they end in, and is that node plus the cumulative share of the edge among those that end there."""

    def __init__(self, v: Vocabulary, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        size = ends - starts
        count = size + 1
        self.base = np.cumsum(count) - count
        nodes = int(count.sum())
        unit = np.repeat(np.arange(len(size)), size)
        byte = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        text = data[np.repeat(starts, size) + byte]
        node = self.base[unit] + byte
        room = size[unit] - byte
        self.place = np.zeros(nodes, np.int64)
        self.place[node] = byte
        self.place[self.base + size] = size

        lead = np.flatnonzero((text & 0xC0) != 0x80)
        width = np.ones(256, np.int64)
        width[0xC0:0xE0], width[0xE0:0xF0], width[0xF0:] = 2, 3, 4
        whole = np.zeros(len(text), bool)  # characters that are pieces
        sources, targets, ids = [], [], []
        at, h = lead, np.zeros(len(lead), np.uint64)
        for length in range(1, v.longest + 1):
            fits = room[at] >= length
            at, h = at[fits], h[fits]
            if not len(at):
                break
            h = h * v.STEP + BYTE_VALUES[text[at + length - 1]]
            found = v.find(h)
            hit = found >= 0
            sources.append(node[at[hit]])
            targets.append(node[at[hit]] + length)
            ids.append(found[hit])
            if length <= 4:
                own = at[hit]
                whole[own[width[text[own]] == length]] = True
            more = found > -2
            at, h = at[more], h[more]
        spell = np.zeros(len(text) + 1, np.int32)
        bare = lead[~whole[lead]]
        np.add.at(spell, bare, 1)
        np.add.at(spell, np.minimum(bare + np.minimum(width[text[bare]], room[bare]), len(text)), -1)
        bare = np.flatnonzero(np.cumsum(spell[:-1]) > 0)
        sources.append(node[bare])
        targets.append(node[bare] + 1)
        ids.append(v.byte[text[bare]])

        source, target, ids = (np.concatenate(x) for x in (sources, targets, ids))
        order = np.argsort((target & 0xFFFF).astype(np.uint16), kind="stable")
        order = order[np.argsort((target[order] >> 16).astype(np.uint16), kind="stable")] if nodes < 1 << 32 else np.argsort(target, kind="stable")
        source, target, ids = source[order], target[order], ids[order]
        weight = v.weight[ids]
        sums = np.zeros(nodes)
        sums[self.base] = 1.0
        step = self.place[target].astype(np.uint8)
        by = np.argsort(step, kind="stable")
        edge = np.concatenate([[0], np.cumsum(np.bincount(step, minlength=1))])
        for p in range(1, len(edge) - 1):
            own = by[edge[p] : edge[p + 1]]
            if len(own):
                begin = np.flatnonzero(np.diff(target[own], prepend=-1))
                sums[target[own[begin]]] = np.add.reduceat(sums[source[own]] * weight[own], begin)
        share = sums[source] * weight / sums[target]
        total = np.cumsum(share)
        begin = np.flatnonzero(np.diff(target, prepend=-1)) if len(target) else np.zeros(0, np.int64)
        before = np.repeat(total[begin] - share[begin], np.diff(begin, append=len(target)))
        self.key = target + np.minimum(total - before, 1.0)
        last = np.append(begin[1:], len(target))[: len(begin)] - 1
        self.key[last] = target[last] + 1.0
        self.end = np.zeros(nodes, np.int64)
        self.end[target[last]] = last + 1
        self.back, self.id, self.final = source, ids, self.base + size


class Sampler:
    """Samples segmentations of texts."""

    def __init__(self, path: str, settings: SamplingSettings = SamplingSettings()):
        self.v, self.settings = Vocabulary(path, settings.theta), settings

    @staticmethod
    def shares(salt: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Numbers in [0, 1), fixed by the salt and the place."""
        return (mix(salt + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)) * 2.0**-53

    def long_unit(self, unit: bytes, salt: np.uint64) -> list[int]:
        """The same for one long unit: two numbers a byte are all it holds; edges are looked up again on the way back."""
        v, n = self.v, len(unit)
        width = [1] * 0xC0 + [2] * 0x20 + [3] * 0x10 + [4] * 0x10
        bare = np.zeros(n, bool)
        i = 0
        while i < n:
            w = width[unit[i]]
            bare[i : i + w] = unit[i : i + w] not in v.pieces
            i += w
        sums, get, weight = np.zeros(n + 1), v.pieces.get, v.weight.tolist()
        sums[0] = 1.0
        recent = [1.0]  # sums of the last positions, rescaled together

        def edges(j: int) -> list[tuple[int, int]]:
            own = [(i, k) for i in range(j - 1, max(0, j - v.longest) - 1, -1) if (k := get(unit[i:j])) is not None]
            return [*own, (j - 1, int(v.byte[unit[j - 1]]))] if bare[j - 1] else own

        shift = np.zeros(n + 1)  # log of what a position's sum was divided by
        logs = 0.0
        for j in range(1, n + 1):
            low = j - len(recent)
            value = sum(recent[i - low] * weight[k] for i, k in edges(j))
            recent.append(value)
            if len(recent) > v.longest:
                recent.pop(0)
            top = max(recent)
            if top > 1e100 or top < 1e-100:
                recent = [x / top for x in recent]
                logs += float(np.log(top))
            sums[j], shift[j] = recent[-1], logs
        share = self.shares(np.full(n + 1, salt, np.uint64), np.arange(n + 1)).tolist()
        out, j = [], n
        while j:
            own = edges(j)
            parts = [sums[i] * np.exp(shift[i] - shift[j]) * weight[k] for i, k in own]
            want, total = share[j] * sum(parts), 0.0
            for (i, k), part in zip(own, parts):
                total += part
                if want < total and part:
                    break
            out.append(k)
            j = i
        return out[::-1]

    def encode(self, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each ends. A text gets a space in front first, an empty one none.
        ``keys`` are the rows' unsigned 64-bit keys."""
        full = np.diff(offsets) > 0
        data = np.insert(data, offsets[:-1][full], 32)
        offsets = offsets + np.concatenate([[0], np.cumsum(full)])
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(full), np.int64)
        begins = np.zeros(len(data), bool)
        begins[1:] = ~self.v.joined[data[:-1].astype(np.int64) * 256 + data[1:]] & ((data[1:] & 0xC0) != 0x80)
        begins[offsets[:-1][full]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))
        bound = np.searchsorted(starts, offsets)
        count = np.diff(bound)
        row = np.repeat(np.arange(len(count)), count)
        ordinal = np.arange(len(starts)) - bound[row]
        seed = mix(keys * np.uint64(0xD6E8FEB86659FD93) + np.uint64(self.settings.seed))
        salt = mix(seed[row] + ordinal.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))

        short = np.flatnonzero(ends - starts <= UNIT_BYTES)
        own, first = distinct_spans(data, starts[short], ends[short])
        order, first = np.argsort(own, kind="stable"), short[first]
        unit = own[order]
        x = Lattice(self.v, data, starts[first], ends[first])

        # Draws go through the units in the lattice's order: neighbours then look at the same few edges.
        n, live, now, steps = np.zeros(len(starts), np.int64), short[order], x.final[unit], []
        while len(live):
            pick = np.minimum(np.searchsorted(x.key, now + self.shares(salt[live], x.place[now]), "right"), x.end[now] - 1)
            steps.append((live, x.id[pick]))
            n[live] += 1
            now = x.back[pick]
            more = x.place[now] > 0
            live, now = live[more], now[more]
        alone = {}
        for i in np.flatnonzero(ends - starts > UNIT_BYTES).tolist():
            alone[i] = self.long_unit(data[starts[i] : ends[i]].tobytes(), salt[i])
            n[i] = len(alone[i])
        end = np.cumsum(n)
        out = np.empty(int(end[-1]), np.int32)
        for s, (at, ids) in enumerate(steps):
            out[end[at] - 1 - s] = ids
        for i, ids in alone.items():
            out[end[i] - n[i] : end[i]] = ids
        return out, np.concatenate([[0], end])[bound[1:]]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all texts, and where each ends: pieces spelled out, without the space in front."""
        size = self.v.size[ids]
        total = np.cumsum(size)
        pick = np.repeat(self.v.start[ids] - (total - size), size) + np.arange(total[-1] if len(total) else 0)
        data = self.v.bytes[pick]
        edge = np.concatenate([[0], total])[ends]
        begin = np.concatenate([[0], edge[:-1]])
        keep = np.ones(len(data), bool)
        keep[begin[edge > begin]] = False
        return data[keep], edge - np.cumsum(edge > begin)


_SAMPLERS: dict[tuple[str, SamplingSettings], Sampler] = {}


def sampler(path: str, settings: SamplingSettings) -> Sampler:
    if (path, settings) not in _SAMPLERS:
        _SAMPLERS[path, settings] = Sampler(path, settings)
    return _SAMPLERS[path, settings]


def _binary(data: np.ndarray, ends: np.ndarray, kind: pa.DataType = pa.binary()) -> pa.Array:
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(kind, len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", settings: SamplingSettings = SamplingSettings(), keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``df``: its id (and the columns in ``keep``), n_pieces, pieces (ids as little-endian unsigned
    32-bit numbers) and lossless (decoding gives the text back).

    Draws are fixed by an integer id, the text and the settings: rows that repeat get the same pieces; null ids share one
    key. A null or empty text has no pieces, and is lossless. Columns of ``df`` that aren't named play no part.
    """
    prepare(df)
    columns = [df[id_col], *(df[c] for c in keep)]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    names = [id_col, *keep]
    last = len(columns) + 1

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sampler(model, settings)
        for batch in batches:
            text, offsets = utf8(batch.column(last))
            keys = batch.column(last - 1).to_numpy(zero_copy_only=False).view(np.uint64)
            for a, b in groups(offsets, RUN_BYTES):
                raw, at = text[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                ids, ends = own.encode(raw, at, keys[a:b])
                back, stops = own.decode(ids, ends)
                if np.array_equal(back, raw) and np.array_equal(stops, at[1:]):
                    lossless = np.ones(b - a, bool)
                else:
                    lossless = np.array([x == y for x, y in zip(_binary(back, stops).to_pylist(), _binary(raw, at[1:]).to_pylist())])
                n = np.diff(ends, prepend=0).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(a, b - a) for c in batch.columns[: last - 1]), pa.array(n), _binary(ids.astype("<u4"), 4 * ends), pa.array(lossless)],
                    [*names, "n_pieces", "pieces", "lossless"],
                )

    key = F.coalesce(df[id_col].cast("long"), F.lit(-1)).alias("_key")
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", n_pieces bigint, pieces binary, lossless boolean"
    return df.select(*columns, key, df[text_col].cast("string").alias("_text")).mapInArrow(tidy(kernel), schema)


def decode(df: DataFrame, model: str, id_col: str = "doc_id", pieces_col: str = "pieces") -> DataFrame:
    """(id, text) for each row of what ``encode`` returns; null pieces give null."""
    prepare(df)
    kind = df.schema[id_col].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sampler(model, SamplingSettings())
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            raw, ends = own.decode(np.frombuffer(data.tobytes(), "<u4").astype(np.int64), offsets[1:] // 4)
            text = _binary(raw, ends, pa.string())
            if batch.column(1).null_count:
                text = pa.array([None if x is None else t for x, t in zip(batch.column(1).to_pylist(), text.to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), text], [id_col, "text"])

    return df.select(df[id_col], df[pieces_col]).mapInArrow(tidy(kernel), f"`{id_col}` {kind}, text string")
