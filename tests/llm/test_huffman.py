import heapq

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from plinth.llm.huffman import Code, code_lengths


def best_cost(counts):
    heap = [c for c in counts if c]
    if len(heap) == 1:
        return heap[0]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        s = heapq.heappop(heap) + heapq.heappop(heap)
        cost += s
        heapq.heappush(heap, s)
    return cost


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 10**9), min_size=1, max_size=60), st.integers(6, 20))
def test_lengths(counts, limit):
    counts = np.array(counts)
    lengths = code_lengths(counts, limit).astype(int)
    used = lengths[counts > 0]
    assert (lengths[counts == 0] == 0).all() and (used >= 1).all() and used.max(initial=0) <= limit
    if len(used) > 1:
        assert sum(2.0**-used) == 1
    if counts.any() and limit == 20 and len(used) < 20:
        assert (lengths * counts).sum() == best_cost(counts.tolist())


def test_limit_is_optimal_against_search():
    counts = np.array([1, 1, 2, 3, 5, 8, 13])
    best = min(
        sum(c * l for c, l in zip(counts, ls))
        for ls in __import__("itertools").product(range(1, 5), repeat=7)
        if sum(2.0**-l for l in ls) <= 1
    )
    assert (code_lengths(counts, 4).astype(int) * counts).sum() == best


@pytest.mark.parametrize("n", [0, 1, 2, 511, 512, 513, 5000])
@pytest.mark.parametrize("symbols", [1, 2, 300, 70_000])
def test_round_trip(n, symbols):
    rng = np.random.default_rng(n + symbols)
    ids = np.minimum(rng.geometric(0.01, n), symbols) - 1 if symbols < 70_000 else rng.integers(0, symbols, n)
    counts = np.bincount(ids, minlength=symbols)
    code = Code(code_lengths(counts))
    data, offsets = code.encode(ids)
    assert len(data) == -(-int((code.lengths[ids]).sum()) // 8)
    assert (code.decode(data, offsets, n) == ids).all()
    if len(offsets) > 2:  # one block alone
        assert (code.decode(data, offsets[1:2], 512) == ids[512:1024]).all()
