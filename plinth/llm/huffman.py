"""Canonical length-limited Huffman coding of ids, in numpy.

Codes are at most ``LIMIT`` bits long (package-merge finds the best such lengths). Only the lengths are stored: symbols
sorted by (length, id) get consecutive codes. Ids are coded in blocks of ``BLOCK``, and the bit offset at which each block
begins is a checkpoint, so any block can be decoded alone, and many at once: each step looks the next ``LIMIT`` bits of all
blocks up in one table.
"""

from __future__ import annotations

import heapq

import numpy as np

LIMIT = 20
BLOCK = 512


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of each symbol's code; 0 for symbols that don't occur. Plain Huffman, or package-merge where that is too long."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols don't fit codes of {limit} bits")
    heap = [(int(counts[s]), i) for i, s in enumerate(used)]
    heapq.heapify(heap)
    parent, n = [0] * (2 * len(used) - 1), len(used)
    while len(heap) > 1:
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i] = parent[j] = n
        heapq.heappush(heap, (a + b, n))
        n += 1
    depth = [0] * n
    for i in range(n - 2, -1, -1):
        depth[i] = depth[parent[i]] + 1
    if max(depth[: len(used)]) > limit:
        depth = _package_merge(counts[used], limit)
    lengths[used] = depth[: len(used)]
    return lengths


def _package_merge(counts: np.ndarray, limit: int) -> np.ndarray:
    """Best lengths of at most ``limit`` bits: of each level's merged list of coins, half are packaged for the next; walking
    back, how many coins a level takes says how many symbols have a code at least that long."""
    order = np.argsort(counts, kind="stable")
    coins = counts[order].astype(np.int64)
    n, levels, package = len(coins), [], np.zeros(0, np.int64)
    for _ in range(limit):
        merged = np.concatenate([coins, package])
        by = np.argsort(merged, kind="stable")
        levels.append(by < n)
        merged = merged[by]
        package = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for single in reversed(levels):
        own = int(single[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out = np.zeros(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """The canonical code of given lengths."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, np.uint8)
        self.width = int(self.lengths.max(initial=0))
        order = np.lexsort((np.arange(len(self.lengths)), self.lengths))
        order = order[self.lengths[order] > 0]
        size = self.lengths[order].astype(np.int64)
        spans = np.left_shift(np.int64(1), self.width - size)
        first = np.cumsum(spans) - spans
        self.codes = np.zeros(len(self.lengths), np.uint64)
        self.codes[order] = (first >> (self.width - size)).astype(np.uint64)
        self._order, self._spans = order, spans
        self._table: tuple[np.ndarray, np.ndarray] | None = None

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, length) for each value of the next ``width`` bits."""
        if self._table is None:
            symbol = np.zeros(1 << self.width, np.int32)
            symbol[: int(self._spans.sum())] = np.repeat(self._order, self._spans)
            self._table = symbol, self.lengths[symbol].astype(np.int64) if len(self.lengths) else np.zeros(1 << self.width, np.int64)
        return self._table

    def encode(self, ids: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
        """The bits of all ids, first bit highest, and the bit offset of each block."""
        size = self.lengths[ids].astype(np.int64)
        if len(ids) and not size.all():
            raise ValueError("an id has no code")
        end = np.cumsum(size)
        begin = end - size
        total = int(end[-1]) if len(ids) else 0
        words = np.zeros(total // 64 + 2, np.uint64)
        cell, room = begin >> 6, 64 - (begin & 63)
        code = self.codes[ids]
        over = np.maximum(size - room, 0)  # bits that go to the next word
        high = np.left_shift(code >> over.astype(np.uint64), np.maximum(room - size, 0).astype(np.uint64))
        if len(ids):
            start = np.flatnonzero(np.diff(cell, prepend=-1))
            words[cell[start]] = np.bitwise_or.reduceat(high, start)
            split = np.flatnonzero(over)
            words[cell[split] + 1] |= code[split] << (64 - over[split]).astype(np.uint64)
        return words.byteswap().tobytes()[: -(-total // 8)], begin[::block].copy()

    def decode(self, data: bytes, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
        """The n ids of consecutive blocks (all full but the last) that begin at the given bit offsets of ``data``."""
        out = np.zeros((len(offsets), block), np.int32)
        if not n:
            return out.reshape(-1)[:0]
        symbol, length = self.table()
        raw = np.frombuffer(data + b"\0" * 8, np.uint8)
        # Every four bytes from each byte on, as one number: a code of up to 25 bits lies within.
        four = (raw[:-3].astype(np.uint32) << 24) | (raw[1:-2].astype(np.uint32) << 16) | (raw[2:-1].astype(np.uint32) << 8) | raw[3:]
        at, last = offsets.astype(np.int64).copy(), n - (len(offsets) - 1) * block
        mask, drop = np.uint32((1 << self.width) - 1), 32 - self.width
        for step in range(block):
            live = slice(None) if step < last else slice(0, len(offsets) - 1)
            if step >= last and len(offsets) == 1:
                break
            here = at[live]
            window = (four[here >> 3] >> (drop - (here & 7)).astype(np.uint32)) & mask
            out[live, step] = symbol[window]
            here += length[window]
            at[live] = here
        return out.reshape(-1)[:n]
