"""SimHash near-duplicates by segment popcounts.

A 64-bit fingerprint is cut into 16 segments, and maps to the vector of their bit counts. Flipping a bit moves one
coordinate by one, so the Manhattan distance of two vectors never exceeds the Hamming distance of their fingerprints: a
range join in that grid misses no link, and what it finds is verified by the exact distance.

Points at distance 2 or less have a grid point at distance 1 or less from both. So every fingerprint is put into the cell
of its own vector and of the 32 around it, and partners share a cell. Most cells hold one fingerprint and go. In cells of
up to ``CROWD`` all pairs are verified. A fuller cell is cut once more, by a grid whose segments are single bits, where the
Manhattan distance *is* the Hamming distance: its fingerprints go to the 64-bit points of the cell within one flip. Such a
point has 65 neighbours at most, and all of them are within two flips of one another, so linking each to the least one
keeps the components as they are without listing pairs. Distinct fingerprints alone take part; copies join at the end.

``keep_one`` takes near-duplicates out of a corpus: texts similar at 0.8 by 5-word shingles. Links of fingerprints are its
candidates, with those that ``similar`` adds, as fingerprints within two bits are few of such texts; all are verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from plinth.llm.common import prepare, tidy
from plinth.llm import similar
from plinth.operators.components import components
from plinth.llm.rows import check_of, pinned, row_number_id, without
from plinth.session import staged

WORDS = 3
RADIUS = 2
SEGMENTS = 16
CROWD = 64
#: Shingles that are turned into bits at once.
STRIP = 1 << 16


def fingerprint(text: bytes, words: int = WORDS, seed: int = 42) -> int:
    """Bit i is set if it is in over half the XXH64 of the text's word shingles, repeats included; no words: 0."""
    own = text.lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not own:
        return 0
    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    shingles = map(b" ".join, zip(*(own[i:] for i in range(words)))) if len(own) >= words else iter([b" ".join(own)])
    n, count = max(1, len(own) - words + 1), np.zeros(64, np.int64)
    for low in range(0, n, STRIP):
        hashes = np.fromiter(map(digest, (x for x, _ in zip(shingles, range(min(STRIP, n - low))))), np.uint64, min(STRIP, n - low))
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.uint32)
    return int(sum(1 << i for i in np.flatnonzero(2 * count > n).tolist()))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): a fingerprint for each row of ``df``, as a signed long. A null or empty text has fingerprint 0."""
    prepare(df)
    kind = df.schema[id_col].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_buffer().to_pybytes()) if x.is_valid else 0 for x in batch.column(1).cast(pa.binary())), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    return df.select(df[id_col], df[text_col].cast("string")).mapInArrow(tidy(kernel), f"id {kind}, fp bigint")


#: The lowest bit of each segment.
UNITS = sum(1 << 4 * i for i in range(SEGMENTS))


def _cells(distinct: DataFrame) -> DataFrame:
    """(fp, k, cell): the grid cells of each fingerprint, whose 16 popcounts of 0 to 4 are packed four bits each. k is 0 for
    its own cell; 2i+1 and 2i+2 have the i-th count raised and lowered by one, where that leads to a cell."""
    own = distinct.selectExpr("fp", " + ".join(f"(shiftrightunsigned(fp, {i}) & {UNITS}L)" for i in range(4)) + " as own")
    moved = own.select("fp", "own", F.explode(F.array(*map(F.lit, range(2 * SEGMENTS + 1)))).alias("k"))
    moved = moved.withColumn("at", F.expr("shiftright(k - 1, 1) * 4")).withColumn("count", F.expr("shiftrightunsigned(own, at) & 15"))
    moved = moved.filter("k = 0 or if(k % 2 = 1, count < 4, count > 0)")
    return moved.select("fp", "k", F.expr("case when k = 0 then own when k % 2 = 1 then own + shiftleft(1L, at) else own - shiftleft(1L, at) end").alias("cell"))


def _points(members: DataFrame) -> DataFrame:
    """(fp, point): the 64-bit points of a member's cell within one flip of it: itself in its own cell, else the flips of
    the segment's unset (raised) or set (lowered) bits."""
    bits = members.select("fp", "k", F.explode(F.array(*map(F.lit, range(4)))).alias("j"))
    bits = bits.withColumn("bit", F.expr("shiftleft(1L, shiftright(greatest(k, 1) - 1, 1) * 4 + j)"))
    bits = bits.filter("if(k = 0, j = 0, (fp & bit = 0) = (k % 2 = 1))")
    return bits.select("fp", F.expr("if(k = 0, fp, fp ^ bit)").alias("point"))


def links(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) between fingerprints ``fp`` of ``distinct`` (no repeats), each at Hamming distance 1 or 2, whose
    components are those of all such pairs."""
    cells = _cells(distinct)
    shared = staged(cells.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1"), "cells")
    members = staged(cells.join(shared, "cell"), "members")
    few = members.filter(F.col("n") <= crowd)
    pairs = few.alias("p").join(few.alias("q"), (F.col("p.cell") == F.col("q.cell")) & (F.col("p.fp") < F.col("q.fp")))
    near = pairs.filter(F.expr(f"bit_count(p.fp ^ q.fp) <= {RADIUS}")).select(F.col("p.fp").alias("a"), F.col("q.fp").alias("b"))
    many = _points(members.filter(F.col("n") > crowd))
    least = many.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    starred = many.join(least, "point").filter("fp != a").select("a", F.col("fp").alias("b"))
    return near.union(starred).filter(F.expr(f"bit_count(a ^ b) between 1 and {RADIUS}")).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """One row for each row of ``df``: its id, its fingerprint (16 hex digits) and component_id, the least id that links
    lead to, its own included.

    Null and empty texts have fingerprint zero and link like any other. A null id is never an end of a chain: the row's
    component is that of its fingerprint, null if no row with that fingerprint or linked to it has an id. Rows that repeat
    stay rows. Ids are integers. No rows give no rows; other columns play no part.
    """
    own = staged(fingerprints(df, id_col, text_col), "fingerprints")
    nodes = staged(own.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    joined = components(links(nodes.select("fp"), crowd))
    # Components are named by their least fingerprint; each then takes the least id among its fingerprints.
    named = staged(nodes.join(joined, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("c")), "named")
    final = named.groupBy("c").agg(F.min("least").alias("component_id"))
    labels = named.select("fp", "c").join(final, "c").select("fp", "component_id")
    return own.join(labels, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def similar_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = similar.WORDS, least: tuple[int, int] = similar.SIMILARITY, crowd: int = similar.CROWD) -> DataFrame:
    """(row, id, check, component, kept) for each row of a pinned ``df`` by its number: components of texts whose sets of word
    shingles are similar, and whether a row is the one that stays of its component."""
    text = df[text_col].cast("string")
    own = df.select(row_number_id().alias("row"), df[id_col].alias("id"), check_of(text), text.alias("t"))
    own = staged(similar.keyed(own, words), "set-keys")
    # A node is a distinct set, known by two hashes and its size, and named by the number of its first row.
    node = own.groupBy("key", "fp", "n").agg(F.min("row").alias("node"), F.min_by("check", "row").alias("check"), F.first("counts").alias("counts"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best"))
    nodes = staged(node, "set-nodes")
    texts = df.select(text.alias("t"))
    firsts = staged(nodes.groupBy("fp").agg(F.min("node").alias("first")), "prints")
    edges = links(firsts.select("fp"), crowd)
    near = edges.join(firsts.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(firsts.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    near = near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    near = near.union(nodes.join(firsts, "fp").filter("node != first").select("first", "node"))
    found, crowds = similar.candidates(texts, nodes, similar.common_elements(own), words, least, crowd)
    pairs = staged(similar.close(nodes, near.union(found).distinct(), least), "pairs")
    linked = staged(similar.similar(texts, nodes, pairs, words, least), "similar")
    joined = components(linked)
    # Members of crowds that are apart so far: all their pairs are looked at.
    apart = staged(similar.close(nodes, similar.crossing(crowds, joined, least), least), "crossing")
    if not apart.isEmpty():
        joined = components(linked.union(similar.similar(texts, nodes, apart, words, least)))
    named = nodes.join(joined.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("key", "fp", "n", "best", F.coalesce("component", "node").alias("component"))
    kept = named.groupBy("component").agg(F.min("best").alias("b")).select("component", F.col("b.row").alias("first"))
    named = named.select("key", "fp", "n", "component").join(kept, "component")
    return own.select("row", "id", "check", "key", "fp", "n").join(named, ["key", "fp", "n"]).select("row", "id", "check", "component", (F.col("row") == F.col("first")).alias("kept"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = similar.WORDS, least: tuple[int, int] = similar.SIMILARITY, crowd: int = similar.CROWD) -> DataFrame:
    """The rows of ``df``, all columns as they are, less near-duplicates: one row of each component of texts whose sets of word
    shingles are similar, that with the least id (any before a null one); of rows that share it, the first.

    Null, empty and blank texts have the same set, an empty one: one of them stays. No rows give no rows."""
    prepare(df)
    df = pinned(df)
    found = staged(similar_rows(df, id_col, text_col, words, least, crowd), "similar-rows")
    return without(df, text_col, found.filter("not kept"))
