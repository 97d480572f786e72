"""Sharding by Karmarkar-Karp differencing: rows of equal text stay together, and shards' bytes come out nearly equal.

A partial partition is a list of bins with sizes. Differencing takes the two partial partitions of largest spread and joins
them oppositely ordered, the fullest bin of one with the emptiest of the other, until one is left.

One law holds at every size: groups are dealt by a hash of their text into runs of about ``RUN``, as many as that takes, each
run is differenced into bundles, and bundles are the groups of the next round; the last run, when all fit into one, is
differenced into shards. Which run a group is in depends on the groups alone, not on how the table is cut.

Bundles of one round are about equally large, so by themselves they'd leave shards a bundle apart. A hash puts a 32nd of the
groups into a finer tier, and a 1024th into a finest one, which are bundled apart all the way. The last differencing takes the
largest spreads first: coarse bundles even out what large groups unbalance, and each finer tier, whose bytes exceed a coarser
bundle for each shard, what the coarser one left.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from plinth.llm.common import prepare
from plinth.session import staged

SHARDS = 16
#: Groups that are differenced together, and into how many bundles where that isn't the last time. The last run is the
#: driver's: an id and a size for each of its groups.
RUN, BUNDLES = 1 << 15, 1 << 11
#: Of so many groups one is in the tier, from coarse to finest; the finer ones are differenced into a quarter of the bundles each.
TIERS = (1, 32, 1024)
#: Rows of a window that numbers slots.
SLOTS = 50_000


def difference(parts: list[list[int]]) -> tuple[list[int], list[list[int]]]:
    """Join partial partitions (each a list of as many bin sizes). Returns the sizes of the joint bins, ascending, and for
    each part the joint bin of each of its bins.

    The tree of joins is kept as, for each join, which bin of either side became which; a walk from the root down composes
    them, so the whole costs a constant number of lists a part."""
    bins = len(parts[0])
    heap, tree = [], []
    for i, part in enumerate(parts):
        order = sorted(range(bins), key=part.__getitem__)
        sizes = [part[j] for j in order]
        heap.append((sizes[0] - sizes[-1], i, sizes))
        tree.append((None, None, order))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, x = heapq.heappop(heap)
        _, j, y = heapq.heappop(heap)
        joint = [a + b for a, b in zip(x, reversed(y))]
        order = sorted(range(bins), key=joint.__getitem__)
        sizes = [joint[k] for k in order]
        tree.append((i, j, order))
        heapq.heappush(heap, (sizes[0] - sizes[-1], len(tree) - 1, sizes))
    sizes = heap[0][2]
    out: list[list[int]] = [[] for _ in parts]
    stack = [(len(tree) - 1, list(range(bins)))]  # node, final bin of each of its sorted bins
    while stack:
        node, final = stack.pop()
        left, right, order = tree[node]
        # The node's k-th sorted bin is its order[k]-th unsorted one.
        unsorted = [0] * bins
        for k, j in enumerate(order):
            unsorted[j] = final[k]
        if left is None:
            out[node] = unsorted
        else:
            stack.append((left, unsorted))
            stack.append((right, unsorted[::-1]))
    return sizes, out


def singles(sizes: list[int], bins: int) -> tuple[list[int], list[int]]:
    """Difference single sizes: the joint bins' sizes, ascending, and the bin of each.

    The same joins as ``difference`` of partitions that have one bin in use each, in the space of what is in use. While bins are
    empty, what joins a partition takes one of them; a single that joins a full one is a bin's new place; other joins
    keep which bin became which, a few bytes a bin."""
    heap: list[tuple[int, int, list[int]]] = [(-s if bins > 1 else 0, i, [s]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    # A node is the items of a partition with a bin for each; or (node, item, place); or (node, node, order).
    nodes: dict[int, object] = {i: [i] for i in range(len(sizes))}
    made = len(sizes)
    while len(heap) > 1:
        _, i, x = heapq.heappop(heap)
        _, j, y = heapq.heappop(heap)
        left, right = nodes.pop(i), nodes.pop(j)
        if len(x) < len(y):
            x, y, left, right = y, x, right, left
        if len(x) + len(y) <= bins and isinstance(left, list) and isinstance(right, list):
            for item, size in zip(right, y):
                at = bisect_left(x, size)
                x.insert(at, size)
                left.insert(at, item)
            node, sizes_now = left, x
        elif len(y) == 1 and len(x) == bins and isinstance(right, list):
            size = x.pop(0) + y[0]
            at = bisect_left(x, size)
            x.insert(at, size)
            node, sizes_now = (left, right[0], at), x
        else:
            whole = [np.concatenate([np.zeros(bins - len(v), np.int64), np.array(v, np.int64)]) for v in (x, y)]
            joint = whole[0] + whole[1][::-1]
            order = np.argsort(joint, kind="stable")
            node, sizes_now = (left, right, order.astype(np.uint16 if bins <= 1 << 16 else np.int64)), joint[order].tolist()
        spread = sizes_now[-1] - (sizes_now[0] if len(sizes_now) == bins else 0)
        nodes[made] = node
        heapq.heappush(heap, (-spread, made, sizes_now))
        made += 1
    _, top, found = heap[0]
    out = [0] * len(sizes)
    stack = [(nodes[top], np.arange(bins))]  # node, final bin of each of its sorted bins
    while stack:
        node, final = stack.pop()
        if isinstance(node, list):
            for item, to in zip(node, final[bins - len(node) :].tolist()):
                out[item] = to
        elif isinstance(node[1], int):
            below, item, at = node
            out[item] = int(final[at])
            stack.append((below, np.concatenate([final[at : at + 1], final[:at], final[at + 1 :]])))
        else:
            unsorted = np.empty(bins, np.int64)
            unsorted[node[2]] = final
            stack += [(node[0], unsorted), (node[1], unsorted[::-1])]
    return [0] * (bins - len(found)) + found, out


def bundled(groups: DataFrame, runs: int, bundles: int) -> DataFrame:
    """(id, bundle, bytes, tier) of groups (id, bytes, tier), dealt by a hash of the id into runs, each tier of which is differenced
    into bundles."""

    def joined(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("tier").to_pylist(), table.column("id").to_pylist(), table.column("bytes").to_pylist()))
        names: list[str] = []
        for tier in range(len(TIERS)):
            sizes = [x for t, _, x in rows if t == tier]
            bins = min(bundles if tier == 0 else max(bundles // 4, 1), len(sizes))
            names += [f"{key[0].as_py()}:{tier}:{w}" for w in (singles(sizes, bins)[1] if sizes else [])]
        return pa.table({"id": pa.array([i for _, i, _ in rows], pa.string()), "bundle": pa.array(names, pa.string()), "bytes": pa.array([x for _, _, x in rows], pa.int64()), "tier": pa.array([t for t, _, _ in rows], pa.int32())})

    return groups.withColumn("run", F.pmod(F.xxhash64("id"), F.lit(runs))).groupBy("run").applyInArrow(joined, "id string, bundle string, bytes bigint, tier int")


def placed(groups: DataFrame, shards: int, run: int = RUN, bundles: int = BUNDLES) -> DataFrame:
    """(id, shard) of groups (id, bytes)."""
    spark, levels = groups.sparkSession, []
    draw = F.pmod(F.xxhash64("id", F.lit("tier")), F.lit(TIERS[-1]))
    groups = groups.select("id", "bytes", sum((draw < TIERS[-1] // t).cast("int") for t in TIERS[1:]).alias("tier"))
    while (n := groups.count()) > run:
        level = staged(bundled(groups, -(-n // run), bundles), "shard-bundles")
        levels.append(level.select("id", "bundle"))
        # A bundle is known by its round as well, so that hashes deal it anew.
        groups = staged(level.groupBy(F.concat_ws("/", F.lit(str(len(levels))), "bundle").alias("id"), "tier").agg(F.sum("bytes").alias("bytes")), "shard-groups")
    last = sorted((r["id"], r["bytes"]) for r in groups.collect())  # at most ``run``
    where = singles([s for _, s in last], shards)[1] if last else []
    out = spark.createDataFrame(pa.table({"id": pa.array([i for i, _ in last], pa.string()), "shard": pa.array(where, pa.int32())}))
    for k, level in reversed([*enumerate(levels, 1)]):
        out = level.withColumn("bundle", F.concat_ws("/", F.lit(str(k)), "bundle")).join(out.withColumnRenamed("id", "bundle"), "bundle").select("id", "shard")
    return out


def assign(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, run: int = RUN, bundles: int = BUNDLES) -> DataFrame:
    """One row for each row of ``df``: its id, size (UTF-8 bytes of the text and 1), text_crc32, law ``bytes``, shard,
    slot (0, 1, ... within the shard, by a hash of the id and the id) and grown_shard (null under this law).

    Equal texts share a shard, however many rows have them. A null text has size 1 and the crc32 of no bytes; nulls are one
    group, apart from empty texts. Null and repeated ids are rows like any other. No rows give no rows.
    """
    prepare(df)
    text = df[text_col].cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    rows = staged(
        df.select(df[id_col].alias("id"), size.alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.coalesce(F.sha2(text, 256), F.lit("")).alias("digest")),
        "shard-rows",
    )
    groups = staged(rows.groupBy(F.col("digest").alias("id")).agg(F.sum("size").alias("bytes")), "shard-groups")
    places = placed(groups, shards, run, bundles).withColumnRenamed("id", "digest")
    sharded = staged(rows.join(places, "digest").drop("digest"), "sharded")
    return numbered(sharded, shards).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def numbered(sharded: DataFrame, shards: int) -> DataFrame:
    """Slots without gaps: each shard's rows fall into buckets by a hash, are numbered within, and begin where the buckets
    before end. Rows that repeat are counted, and their count is cut into parts of ``SLOTS`` that are spread by a hash as well;
    so a window holds about ``SLOTS`` rows or parts, whatever the shard's size and however often a row repeats."""
    counts = sharded.groupBy("shard", "id", "size", "text_crc32").agg(F.count("*").alias("n"))
    parts = staged(counts.withColumn("part", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("long"), F.lit(SLOTS).cast("long")))).withColumn("m", F.least(F.lit(SLOTS), F.col("n") - F.col("part"))), "shard-parts")
    buckets = max(4, -(-parts.count() // (SLOTS * shards)) * 4)
    spread = parts.withColumn("bucket", F.pmod(F.xxhash64("id", "size", "text_crc32", "part"), F.lit(buckets)))
    total = spread.groupBy("shard", "bucket").agg(F.sum("m").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = total.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "bucket").orderBy("id", "size", "text_crc32", "part").rowsBetween(Window.unboundedPreceding, -1)
    first = spread.withColumn("at", F.coalesce(F.sum("m").over(inside), F.lit(0))).join(base, ["shard", "bucket"])
    first = staged(first.select("shard", "id", "size", "text_crc32", (F.col("base") + F.col("at")).cast("long").alias("first"), "m"), "shard-slots")
    one = first.filter("m = 1").select("shard", "id", "size", "text_crc32", F.col("first").alias("slot"))
    many = first.filter("m > 1").repartition("shard", "first").withColumn("slot", F.explode(F.sequence("first", (F.col("first") + F.col("m") - 1).cast("long")))).select(*one.columns)
    return one.union(many)
