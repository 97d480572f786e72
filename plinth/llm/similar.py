"""Which texts' sets of word shingles are similar: what SimHash near-dedup verifies, and how it finds what fingerprints miss.

Fingerprints within two bits find copies with a word changed in a long text, not all that are similar at 0.8 (those differ by
up to a dozen of 64 bits, where a grid tells nothing apart). So candidates come from both: links of fingerprints (``simhash``),
and shared rare shingles. Segments' bit counts of whole sets bound their distance, and spare most pairs the comparison. Two sets of similarity t or more share an element among the first n - ceil(t n) + 1 of each, in any
one order of all elements (the prefix filter); the order here is by hash, but elements that a sample of texts finds common come
last. Every candidate is verified by the whole sets.

An element that up to ``crowd`` sets hold among their first makes all their pairs candidates, less those whose first elements
share too little for the rest to make up. One that more sets hold is a crowd: each member is first compared to two hubs of it, the
sets with the most such elements. In a group of near copies those are the least changed ones, and mostly join all of it. What hubs
leave apart is compared in full: all pairs of a crowd's members in different components by then, dealt over tasks (``crossing``).

No text is shuffled. Rows are numbered, and passes over the texts are told by number which rows to look at (``rows``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from plinth.llm.common import LOWER, NOT_SPACE, groups, mix, span_hashes, tidy, utf8, word_spans
from plinth.llm.rows import decided, met, text_check
from plinth.session import staged

WORDS = 5
#: Least similarity, as a fraction.
SIMILARITY = (4, 5)
CROWD = 32
#: Members of a crowd that one task compares to all of it.
TILE = 256
#: Parts of the range of hashes, a power of two.
SEGMENTS = 128
#: One text of so many is looked through for common shingles, of which the most frequent are kept (2 MB).
SAMPLE = 64
COMMON = 1 << 18


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text its distinct shingles as ascending 64-bit hashes, A-Z as a-z; all of a text of fewer words is one."""
    data, offsets = utf8(column)
    for lo, hi in groups(offsets):
        part, at = LOWER[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, bounds = word_spans(part, at, NOT_SPACE)
        hashes = span_hashes(part, starts, ends)
        for a, b in zip(bounds[:-1], bounds[1:]):
            own = hashes[a:b]
            k = min(words, len(own))
            if not k:
                yield own
                continue
            found = np.zeros(len(own) - k + 1, np.uint64)
            for i in range(k):
                found = mix(found + own[i : len(own) - k + 1 + i] + np.uint64(k))
            yield np.unique(found)


def set_print(own: np.ndarray) -> int:
    """The SimHash of a set: a bit is 1 if it is in over half the elements' hashes. An empty set's is 0."""
    total = np.zeros(64, np.int64)
    for low in range(0, len(own), 1 << 16):
        part = own[low : low + (1 << 16)]
        total += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(own), bitorder="little").view("<i8")[0])


def segment_counts(own: np.ndarray) -> bytes:
    """How many elements a set has in each of ``SEGMENTS`` equal parts of the range of hashes: the bit counts of its segments,
    taken as a string of 2^64 bits. Moving from one set to another changes one count by one for each element that they don't
    share, so the Manhattan distance of counts is at most the number of those (also where counts are cut off at 2^16 - 1)."""
    edge = np.searchsorted(own, np.arange(SEGMENTS, dtype=np.uint64) << np.uint64(64 - SEGMENTS.bit_length() + 1))
    return np.minimum(np.diff(edge, append=len(own)), 65535).astype("<u2").tobytes()


def prefix(own: np.ndarray, common: np.ndarray, least: tuple[int, int] = SIMILARITY) -> np.ndarray:
    """The first elements in the order of all: enough that every set similar to ``own`` has one of them in its own."""
    n = len(own)
    late = common[np.minimum(np.searchsorted(common, own), len(common) - 1)] == own if len(common) else np.zeros(n, bool)
    return np.concatenate([own[~late], own[late]])[: n + 1 + (-n * least[0] // least[1])] if n else own


def keyed(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """(row, id, check, key, fp, n, counts, some) of rows (row, id, check, text): a hash and the SimHash of the text's set, its
    size, its segments' counts, and of one set of ``SAMPLE`` its elements."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, prints, sizes, counts, some = [], [], [], [], []
            for own in shingle_sets(batch.column(3), words):
                keys.append(xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63))
                prints.append(set_print(own))
                sizes.append(len(own))
                counts.append(segment_counts(own))
                some.append(own.view(np.int64) if keys[-1] % SAMPLE == 0 else None)
            columns = [pa.array(keys, pa.int64()), pa.array(prints, pa.int64()), pa.array(sizes, pa.int32()), pa.array(counts, pa.binary()), pa.array(some, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["row", "id", "check", "key", "fp", "n", "counts", "some"])

    kind = texts.schema[1].dataType.simpleString()
    return texts.mapInArrow(tidy(kernel), f"row bigint, id {kind}, check bigint, key bigint, fp bigint, n int, counts binary, some array<bigint>")


def common_elements(keyed_rows: DataFrame) -> np.ndarray:
    often = keyed_rows.filter("some is not null").dropDuplicates(["key"]).select(F.explode("some").alias("h")).groupBy("h").agg(F.count("*").alias("c"))
    rows = often.filter("c > 1").orderBy(F.desc("c"), "h").limit(COMMON).select("h").toArrow()
    return np.sort(rows.column("h").to_numpy().view(np.uint64))


def _chosen(texts: DataFrame, folder: str, schema: str, one: Callable[[np.ndarray], object], words: int) -> DataFrame:
    """(node, value) for the rows of ``texts`` (one column, the frame's order) that a folder of decisions names."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, places, known in met(batches, folder, lambda b, at: text_check(b.column(0), at)):
            if known is None:
                continue
            found = [one(own) for own in shingle_sets(batch.column(0).take(pa.array(places)), words)]
            yield pa.RecordBatch.from_arrays([known.column("row").combine_chunks(), pa.array(found, pa.binary() if "binary" in schema else pa.list_(pa.int64()))], ["node", "value"])

    return texts.mapInArrow(tidy(kernel), f"node bigint, value {schema}")


def candidates(texts: DataFrame, nodes: DataFrame, common: np.ndarray, words: int = WORDS, least: tuple[int, int] = SIMILARITY, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of nodes (node, check, n) that share first elements; a node is the number of a row of ``texts``. And the members
    (node, h, c, n, m) of crowds, of whose pairs only those with hubs are listed: sets of n elements, m of the first ones crowds'."""
    held = texts.sparkSession.sparkContext.broadcast(common)
    folder = decided(nodes.filter("n > 0").select(F.col("node").alias("row"), "check"))
    first = staged(_chosen(texts, folder, "array<bigint>", lambda own: prefix(own, held.value, least).view(np.int64), words), "first-elements")
    each = first.select("node", F.explode("value").alias("h"))
    shared = each.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1")
    members = staged(each.join(shared, "h").join(nodes.select("node", "n"), "node"), "sharing")
    few, many = members.filter(F.col("c") <= crowd), members.filter(F.col("c") > crowd)
    lengths = staged(members.groupBy("node").agg(F.max("n").alias("n"), F.count_if(F.col("c") > crowd).alias("m")), "lengths")
    pairs = few.alias("p").join(few.alias("q"), (F.col("p.h") == F.col("q.h")) & (F.col("p.node") < F.col("q.node")) & _sized("p.n", "q.n", least))
    pairs = pairs.groupBy(F.col("p.node").alias("a"), F.col("q.node").alias("b")).agg(F.count("*").alias("met"))
    pairs = pairs.join(lengths.selectExpr("node as a", "n as na", "m as ma"), "a").join(lengths.selectExpr("node as b", "n as nb", "m as mb"), "b")
    pairs = pairs.filter(_enough("met + least(ma, mb)", least)).select("a", "b")
    # Hubs: of each crowd the set of whose first elements the greatest share is crowds', then the smallest; and the next one.
    share = F.col("m") / (F.col("n") - F.expr(_after("n", least)))
    many = many.join(lengths.select("node", "m"), "node")
    ranked = many.withColumn("rank", F.struct(share.alias("share"), (-F.col("n")).alias("n"), (-F.col("node")).alias("node")))
    top = ranked.groupBy("h").agg(F.max("rank").alias("one"))
    next_ = ranked.join(top, "h").filter(F.col("rank") < F.col("one")).groupBy("h").agg(F.max("rank").alias("two"))
    hubs = top.join(next_, "h").select("h", F.explode(F.array("one", "two")).alias("hub")).select("h", (-F.col("hub.node")).alias("hub"), (-F.col("hub.n")).alias("hn"))
    stars = many.join(hubs, "h").filter((F.col("node") != F.col("hub")) & _sized("n", "hn", least)).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    return pairs.union(stars.distinct()).distinct(), many


def crossing(crowds: DataFrame, joined: DataFrame, least: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Pairs (a, b) of members (node, h, c, n, m) of one crowd that ``joined`` (node, component) has in different components.

    A pair that shares first elements of no crowd as well was a candidate already, so these share crowds' ones only, enough of them
    for the rest to make up. A crowd's members are dealt out, and each part meets all of it in a task of its own."""
    own = crowds.join(joined.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = own.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("h")
    own = staged(own.join(mixed, "h").withColumn("tiles", F.ceil(F.col("c") / TILE)), "mixed-crowds")
    side = lambda df, x: df.select("h", "tile", *(F.col(c).alias(f"{k}{x}") for c, k in (("node", ""), ("n", "n"), ("m", "m"), ("component", "g"))))
    a = side(own.withColumn("tile", F.pmod(F.xxhash64("node", "h"), "tiles")), "a")
    b = side(own.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))), "b")
    met = a.join(b.hint("merge"), ["h", "tile"]).filter((F.col("a") < F.col("b")) & (F.col("ga") != F.col("gb")) & _sized("na", "nb", least) & F.expr(_enough("least(ma, mb)", least)))
    shared = met.groupBy("a", "b").agg(F.count("*").alias("met"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return shared.filter(_enough("met", least)).select("a", "b")


def _after(n: str, least: tuple[int, int]) -> str:
    """How many elements come after the first ones of a set of n."""
    return f"(({n} * {least[0]}L + {least[1] - 1}) div {least[1]} - 1)"


def _enough(met: str, least: tuple[int, int]) -> str:
    """Whether sets of na and nb elements that share at most ``met`` first ones can be similar: what else they share comes after the first
    elements of one."""
    return f"({met} + greatest({_after('na', least)}, {_after('nb', least)})) * {sum(least)} >= (na + nb) * {least[0]}L"


def _sized(a: str, b: str, least: tuple[int, int]):
    """Whether sets of these sizes can be similar."""
    return F.expr(f"least({a}, {b}) * {least[1]}L >= greatest({a}, {b}) * {least[0]}L")


def close(nodes: DataFrame, pairs: DataFrame, least: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of nodes (node, n, counts) whose sizes and segments' counts allow them to be similar: the Manhattan
    distance of counts is no more than the number of elements that they may not share."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("counts").alias(f"c{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(_sized("na", "nb", least))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(utf8(batch.column(i))[0].tobytes(), "<u2").reshape(-1, SEGMENTS).astype(np.int32) for i in (4, 5))
            size = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
            apart = np.abs(x - y).sum(axis=1)
            yield batch.select([0, 1]).filter(pa.array(apart * sum(least) <= size * (least[1] - least[0])))

    return both.select("a", "b", "na", "nb", "ca", "cb").mapInArrow(tidy(kernel), "a bigint, b bigint")


def similar(texts: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int = WORDS, least: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose whole sets are similar."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    folder = decided(nodes.join(wanted, "node").select(F.col("node").alias("row"), "check"))
    sets = staged(_chosen(texts, folder, "binary", lambda own: own.tobytes(), words), "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("value").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("value").alias("y")), "b")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(least[1] * shared >= least[0] * (len(x) + len(y) - shared))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(tidy(kernel), "a bigint, b bigint")
