"""What several operators share: texts as byte buffers, words as spans of them, and 64-bit hashes of spans, all in numpy.

Every kernel below takes whole texts. Byte-level work is masks of a byte a byte; all else is a few numbers a word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from plinth.session import ship

#: Rows in an Arrow batch: texts average a few KB, and a batch is held whole by each Python worker.
BATCH_ROWS = 1000
#: Bytes in one, about: long texts come in smaller batches.
BATCH_BYTES = 8 << 20
#: Bytes of text that a kernel works on at once (a longer text goes alone).
GROUP_BYTES = 1 << 20


def prepare(df: DataFrame) -> SparkSession:
    """The frame's session, with the package shipped and Arrow batches of a bounded number of rows and bytes (settings
    of the session, which stay)."""
    spark = df.sparkSession
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def tidy(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The kernel, which at a task's end gives memory that is free back to the system: Python workers live on from task to
    task, and what their allocators keep adds up beside the executor's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(batches)
        finally:
            release()

    return run


def release() -> None:
    """Give memory that is free back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string (or binary) array; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def groups(offsets: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows [lo, hi) of at most ``limit`` bytes together, or one longer row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that sums of bytes times powers spread over all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: A random-looking 64-bit value for each byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))

#: Spans of up to so many bytes are hashed and compared eight bytes at a time, all spans at once; longer ones one by one.
SHORT = 32
#: Keeps the first n bytes of eight.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number; zeros follow the end."""
    return np.ndarray((len(data) + 1,), "<u8", buffer=np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end) of ``data``: equal bytes give equal hashes wherever they stand. Unlike bytes may
    share one, so whoever decides by equality compares bytes as well (``repeats``, ``distinct_spans``)."""
    size = ends - starts
    out = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    eights, live = _eights(data), np.flatnonzero((size > 0) & (size <= SHORT))
    for low in range(0, SHORT, 8):
        live = live[size[live] > low]
        if not len(live):
            break
        out[live] = mix(out[live] ^ (eights[starts[live] + low] & _FIRST[np.minimum(size[live] - low, 8)]))
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].data)
    return out


def differ(data: np.ndarray, at: np.ndarray, other: np.ndarray, to: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether as many bytes of ``data`` from ``at`` on differ from those of ``other`` from ``to`` on, one by one."""
    left, right = _eights(data), _eights(other) if other is not data else None
    right = left if right is None else right
    out, live = np.zeros(len(size), bool), np.flatnonzero((size > 0) & (size <= SHORT))
    for low in range(0, SHORT, 8):
        live = live[size[live] > low] if low else live
        if not len(live):
            break
        out[live] |= ((left[at[live] + low] ^ right[to[live] + low]) & _FIRST[np.minimum(size[live] - low, 8)]) != 0
    for k in np.flatnonzero(size > SHORT).tolist():
        out[k] = not np.array_equal(data[at[k] : at[k] + size[k]], other[to[k] : to[k] + size[k]])
    return out


def unequal(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the bytes of spans i and j differ, one by one."""
    size = (ends - starts)[i]
    out = size != (ends - starts)[j]
    same = np.flatnonzero(~out)
    out[same] = differ(data, starts[i[same]], data, starts[j[same]], size[same])
    return out


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each span, the same for two if and only if their bytes are; and the first span of each number."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = span_hashes(data, starts, ends)
    order = np.argsort(keys, kind="stable")
    fresh = np.diff(keys[order], prepend=~keys[order[:1]]) != 0
    first, code = order[fresh], np.empty(n, np.int64)
    code[order] = np.cumsum(fresh) - 1
    other = np.flatnonzero(first[code] != np.arange(n))
    other = other[unequal(data, starts, ends, other, first[code[other]])]
    if len(other):  # unlike spans of one hash
        names, extra = {}, []
        for i in other.tolist():
            name = data[starts[i] : ends[i]].tobytes()
            if name not in names:
                names[name] = len(first) + len(extra)
                extra.append(i)
            code[i] = names[name]
        first = np.concatenate([first, np.array(extra, np.int64)])
    return code, first


#: Bytes of words: all but the six ASCII white-space characters; and a-z, A-Z, 0-9 and all beyond ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, bool)
ALNUM[128:] = ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (one more at the end)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    word = is_word[data]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    first[edge] = word[edge]
    last[:-1] &= ~word[1:]
    last[edge - 1] = word[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of a per-word array over each row's words."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def covered(at: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of ``length`` words that begins at one of the distinct positions ``at``."""
    edge = np.zeros(n + 1, np.int32)
    edge[at] += 1
    edge[at + length] -= 1
    return np.cumsum(edge[:-1]) > 0


def hashed_again(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order, again = np.argsort(keys, kind="stable"), np.zeros(len(keys), bool)
    joined = keys[order][1:] == keys[order][:-1]
    again[order[1:]] = joined
    again[order[:-1]] |= joined
    return again


def repeats(keys: np.ndarray, same: Callable[[np.ndarray, np.ndarray], np.ndarray], name: Callable[[int], Hashable]) -> tuple[np.ndarray, np.ndarray]:
    """Which of some things occur more than once, and which of them aren't the first of their kind. Things of unlike keys
    differ; those of one key are compared: ``same(i, j)`` tells, one by one, which are equal, and ``name(i)`` is equal for
    equal things (asked only where unlike things share a key)."""
    n = len(keys)
    again, later = np.zeros(n, bool), np.zeros(n, bool)
    if n > 1:
        order = np.argsort(keys, kind="stable")
        joined = keys[order][1:] == keys[order][:-1]
        i, j = order[:-1][joined], order[1:][joined]
        equal = same(i, j)
        again[i] = again[j] = later[j] = True
        if not equal.all():
            group = np.cumsum(np.concatenate([[True], ~joined]))
            mixed = np.isin(group, np.unique(group[1:][joined][~equal]))
            seen: dict[Hashable, int] = {}
            for k in order[mixed].tolist():
                again[k] = later[k] = False
            for k in order[mixed].tolist():
                key = (int(keys[k]), name(k))
                if key in seen:
                    again[seen[key]] = again[k] = later[k] = True
                else:
                    seen[key] = k
    return again, later
