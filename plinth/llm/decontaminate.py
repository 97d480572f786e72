"""Benchmark decontamination by winnowing.

Of the hashes of a window's k-grams, winnowing keeps the least: the window's fingerprint. A text's fingerprints are those of
its windows, about two for each w + 1 words, and texts that share a window share its fingerprint, so no window can be missed.

The test side becomes a table of its windows, each with its fingerprint, a digest of its words, and the set of items that
hold it. Training texts are read once. What they send on are the windows whose fingerprint a Bloom filter of the test side's
lets pass; the filter has a fixed greatest size, and what it lets pass wrongly goes in the join. There fingerprints meet, and
a hit counts where it extends to the whole window, which equal digests (BLAKE2b of the words, 128 bits) say. Windows that
overlap make up longer spans. Nothing of either side but the filter passes through the driver, and a passage that is common on
both sides is one row a text and window: sets of items have a name, so neither side is multiplied by the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F, types as T

from plinth.llm.common import ALNUM, LOWER, groups, mix, prepare, span_hashes, tidy, utf8, word_spans
from plinth.session import spare, staged

WINDOW = 13
K = 5
#: Bits of the filter: so many for each fingerprint of the test side, and at least and at most (32 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 256, 1 << 20, 1 << 28
PROBES = 3

NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def grams(words: np.ndarray, left: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams that begin at each word; where fewer than k words are left, NEVER."""
    rolled = words.copy()
    for j in range(1, k):
        rolled[:-j] = rolled[:-j] * np.uint64(0x2545F4914F6CDD1D) + words[j:]
    rolled = mix(rolled)
    rolled[left < k] = NEVER
    return rolled


def slide(values: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Least (or greatest) value of each w neighbours, the shorter runs at the end included."""
    pick = np.minimum if least else np.maximum
    out, have = values, 1
    while have < w:
        step = min(have, w - have)
        out = np.append(pick(out[:-step], out[step:]), out[-step:]) if len(out) > step else out
        have += step
    return out


def winnow(hashes: np.ndarray, w: int) -> np.ndarray:
    """Which hashes are the least of at least one window of w neighbours; ties are all kept. What is cut off at the ends of
    the array counts as NEVER."""
    if not len(hashes):
        return np.zeros(0, bool)
    around = np.concatenate([np.full(w - 1, NEVER), hashes, np.full(w - 1, NEVER)])
    least = slide(around, w, True)[: len(hashes) + w - 1]  # of the window that begins here
    return (slide(least, w, False)[: len(hashes)] == hashes) & (hashes != NEVER)


def fingerprints(words: np.ndarray, left: np.ndarray, size: int, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word the fingerprint of the window of ``size`` words that begins there, and whether one does. Only windows of
    full length are winnowed; those of shorter items are one gram."""
    k = min(k, window) if size == window else size
    least = slide(grams(words, left, k), size - k + 1, True)
    return mix(least + np.uint64(size)), left >= size


def _probes(prints: np.ndarray, bits: int) -> list[np.ndarray]:
    """The places of a fingerprint in the filter: other bits of it for each probe."""
    return [(mix(prints + np.uint64(i)) & np.uint64(bits - 1)).astype(np.int64) for i in range(PROBES)]


def _folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lower-cased bytes, starts and ends of words, rows' bounds among them, words' hashes, and the words left in the row."""
    data = LOWER[data]
    starts, ends, bounds = word_spans(data, offsets, ALNUM)
    words = span_hashes(data, starts, ends)
    return data, starts, ends, bounds, words, np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(words))


def _digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, size: int) -> list[bytes]:
    """A digest of the ``size`` words from each place ``at`` on."""
    if not len(at):
        return []
    near = np.zeros(len(starts) + 1, np.int64)
    near[at] += 1
    near[at + size] -= 1
    wanted = np.flatnonzero(np.cumsum(near[:-1]) > 0)
    raw = data.tobytes()
    words = dict(zip(wanted.tolist(), (raw[i:j] for i, j in zip(starts[wanted].tolist(), ends[wanted].tolist()))))
    return [hashlib.blake2b(b" ".join([words[i] for i in range(x, x + size)]), digest_size=16).digest() for x in at.tolist()]


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """(print, digest, n, item) of each window of each row; ``n`` is its number of words, ``item`` the id as a string."""
    prepare(benchmark)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, edges = utf8(batch.column(1))
            for a, b in groups(edges):
                data, starts, ends, bounds, words, left = _folded(whole[edges[a] : edges[b]], edges[a : b + 1] - edges[a])
                count = np.diff(bounds)
                for size in np.unique(np.minimum(count, window)).tolist():
                    if not size:
                        continue
                    prints, ok = fingerprints(words, left, size, window, k)
                    at = np.flatnonzero(ok & np.repeat(count >= window, count)) if size == window else bounds[:-1][count == size]
                    rows = np.searchsorted(bounds, at, "right") - 1
                    items = batch.column(0).take(pa.array(rows + a))
                    yield pa.RecordBatch.from_arrays([pa.array(prints[at].view(np.int64)), pa.array(_digests(data, starts, ends, at, size), pa.binary()), pa.array(np.full(len(at), size, np.int32)), items], ["print", "digest", "n", "item"])

    rows = benchmark.select(benchmark[id_col].cast("string").alias("i"), benchmark[text_col].cast("string").alias("t"))
    return rows.mapInArrow(tidy(kernel), "print bigint, digest binary, n int, item string")


def print_filter(windows: DataFrame, bits: int | None = None) -> Broadcast:
    """A Bloom filter of the windows' fingerprints. Its bits are gathered as numbers of 64, so the driver gets at most
    MOST_BITS / 64 rows however many windows there are."""
    spark = windows.sparkSession
    bits = bits or min(max(1 << (windows.count() * BITS_EACH).bit_length(), LEAST_BITS), MOST_BITS)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(_probes(batch.column(0).to_numpy().view(np.uint64), bits)))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.uint64(1) << (at & 63).astype(np.uint64)).view(pa.int64())], ["at", "bit"])

    rows = windows.select("print").mapInArrow(tidy(kernel), "at bigint, bit bigint").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(out)


def _passes(prints: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which fingerprints may be among the test side's. Neighbours mostly share one, so runs are looked up once."""
    change = np.flatnonzero(np.diff(prints, prepend=~prints[:1]) != 0)
    some, ok = prints[change], np.ones(len(change), bool)
    for at in _probes(some, len(held) << 6):
        ok &= (held[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)) == 1
    return np.repeat(ok, np.diff(change, append=len(prints)))


def _candidates(data: np.ndarray, offsets: np.ndarray, held: np.ndarray, sizes: list[int], window: int, k: int) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
    """For a run of texts: numbers of words, of windows that the filter lets pass, and those: (place in the text, words,
    fingerprint, digest), text by text."""
    data, starts, ends, bounds, words, left = _folded(data, offsets)
    found = []
    for size in sizes:
        prints, ok = fingerprints(words, left, size, window, k)
        at = np.flatnonzero(ok & _passes(prints, held)) if len(prints) else np.zeros(0, np.int64)
        rows = np.searchsorted(bounds, at, "right") - 1
        found += zip(rows.tolist(), (at - bounds[rows]).tolist(), [size] * len(at), prints[at].view(np.int64).tolist(), _digests(data, starts, ends, at, size))
    found.sort(key=lambda x: x[0])
    count = np.diff(bounds)
    return count, np.bincount(np.array([x[0] for x in found], np.int64), minlength=len(count)), found


_WINDOWS = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int32()), ("print", pa.int64()), ("digest", pa.binary())]))


class Search:
    """The test side of a benchmark, ready to be met by training texts."""

    def __init__(self, benchmark: DataFrame, id_col: str, text_col: str, window: int = WINDOW, k: int = K, bits: int | None = None):
        self.window, self.k = window, k
        windows = staged(item_windows(benchmark, id_col, text_col, window, k), "item-windows")
        self.sizes = sorted(r["n"] for r in windows.select("n").distinct().collect())  # at most ``window``
        self.held = print_filter(windows, bits)
        # Items are gathered by window, an item once; equal sets get one name.
        sets = windows.groupBy("print", "digest").agg(F.array_sort(F.collect_set("item")).alias("items"))
        sets = staged(sets.withColumn("set", F.sha2(F.to_json("items"), 256)), "window-items")
        self.windows = sets.select("print", "digest", "set")
        self.items = staged(sets.groupBy("set").agg(F.first("items").alias("items")), "item-sets")

    def candidates(self, df: DataFrame) -> DataFrame:
        """(id, n_words, found) of each row (id, text): the windows that the filter lets pass."""
        held, sizes, window, k = self.held, self.sizes, self.window, self.k

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = utf8(batch.column(1))
                for a, b in groups(offsets):
                    count, many, found = _candidates(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], held.value, sizes, window, k)
                    parts = list(zip(*found)) or [()] * 5
                    flat = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(parts[1:], _WINDOWS.value_type)], fields=list(_WINDOWS.value_type))
                    edge = pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(count.astype(np.int64)), pa.ListArray.from_arrays(edge, flat)], ["id", "n_words", "found"])

        kind = df.schema[0].dataType.simpleString()
        return df.mapInArrow(tidy(kernel), f"id {kind}, n_words bigint, found array<struct<at:bigint,n:int,print:bigint,digest:binary>>")

    def judged(self, df: DataFrame) -> DataFrame:
        """(id, n_words, n_hit, items, contaminated) of each row (id, text)."""
        own = staged(self.candidates(df).withColumn("row", F.monotonically_increasing_id()), "candidates")
        met = own.select("row", F.inline("found")).join(self.windows, ["print", "digest"]).select("row", "at", (F.col("at") + F.col("n")).alias("end"), "set")
        met = staged(met, "hits")
        before = Window.partitionBy("row").orderBy("at", "end").rowsBetween(Window.unboundedPreceding, -1)
        new = F.greatest(F.lit(0), F.col("end") - F.greatest("at", F.coalesce(F.max("end").over(before), F.lit(0))))
        hits = met.select("row", new.alias("new")).groupBy("row").agg(F.sum("new").alias("n_hit"))
        items = met.select("row", "set").distinct().join(self.items, "set").groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        none = F.array().cast("array<string>")
        out = own.select("row", "id", "n_words").join(hits.join(items, "row"), "row", "left").select("id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"))
        return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))

    def may_hit(self, df: DataFrame, text_col: str, name: str) -> DataFrame:
        """``df`` with a column ``name``: whether the filter lets any window of the text pass."""
        held, sizes, window, k, place = self.held, self.sizes, self.window, self.k, df.columns.index(text_col)

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = utf8(batch.column(place).cast(pa.string()))
                some = []
                for a, b in groups(offsets):
                    _, _, _, bounds, words, left = _folded(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    hit = np.zeros(len(words) + 1, np.int64)
                    for size in sizes if len(words) else ():
                        prints, ok = fingerprints(words, left, size, window, k)
                        hit[1:] |= ok & _passes(prints, held.value)
                    hit = np.cumsum(hit)
                    some.append(hit[bounds[1:]] > hit[bounds[:-1]])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(some) if some else np.zeros(0, bool))], [*batch.schema.names, name])

        return df.mapInArrow(tidy(kernel), T.StructType([*df.schema.fields, T.StructField(name, T.BooleanType())]))


def contamination(
    df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, k: int = K, bits: int | None = None,
) -> DataFrame:
    """One row for each row of ``df``: its id, n_words, n_hit, n_items, items (ids as sorted strings), items_sha256 and
    contaminated (at least a twentieth of its words are hit).

    A null text has no words, and no hit: n_items 0, items_sha256 that of the empty string. Items without a word match nothing.
    An item with a null id hits words, but has no name to count or list; rows that share an item id are one item. Rows of
    ``df`` with a null or repeated id are judged one by one. An empty benchmark hits nothing. Other columns play no part.
    """
    prepare(df)
    found = Search(benchmark, item_id, item_text, window, k, bits).judged(df.select(df[id_col], df[text_col].cast("string")))
    return found.select(
        F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``df``, all columns as they are, that aren't contaminated: equal texts stay or go together, null ones stay.

    Texts that the filter finds nothing in aren't moved; the others are joined to the digests of contaminated texts."""
    prepare(df)
    search = Search(benchmark, item_id, item_text)
    text = F.col(text_col).cast("string")
    flag, bad = spare(df, "may_hit"), spare(df, "bad")
    flagged = search.may_hit(df, text_col, flag)
    maybe = flagged.filter(flag).drop(flag)
    judged = search.judged(maybe.select(F.sha2(text, 256).alias("id"), text.alias("t")))
    gone = staged(judged.filter("contaminated").select(F.col("id").alias(bad)).distinct(), "contaminated")
    return flagged.filter(~F.col(flag)).drop(flag).union(maybe.join(gone, F.sha2(text, 256) == F.col(bad), "left_anti"))
