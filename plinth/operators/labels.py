"""Where a sheet's column of labels ends: vetoes and refinements of a boundary along x, for all sheets at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plinth.functions.members import is_loose_title, is_row_title, is_value, is_zone_title
from plinth.functions.numbers import median, nearest_rank
from plinth.functions.signals import let, stripped
from plinth.session import spare


def bad_splits(items: DataFrame, splits: DataFrame) -> DataFrame:
    """(commit_id, is_bad) for splits (commit_id, boundary) of items (commit_id, x, text): of ten items or more that span
    400 or more, a left part that is wider than 0.3 of the span, reaches beyond 0.33 of it, holds more than 0.45 of the items,
    or ends beyond 0.36 of it, isn't a column of labels but lies between columns of values."""
    left = F.col("x") <= F.col("boundary")
    stats = items.join(splits, "commit_id").groupBy("commit_id").agg(
        F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.count_if(left).alias("m"), F.min(F.when(left, F.col("x"))).alias("l0"), F.max(F.when(left, F.col("x"))).alias("l1"), F.first("boundary").alias("b"),
    )
    span = F.col("x1") - F.col("x0")
    bad = (F.col("l1") - F.col("l0") > span * 0.30) | (F.col("l1") > F.col("x0") + span * 0.33) | ((F.col("b") - F.col("x0")) / span > 0.36) | (F.col("m") > F.col("n") * 0.45)
    return stats.select("commit_id", F.coalesce((F.col("n") >= 10) & (F.col("m") > 0) & (span >= 400) & bad, F.lit(False)).alias("is_bad"))


def tight_boundaries(items: DataFrame, splits: DataFrame) -> DataFrame:
    """(commit_id, boundary, mode) where splits (commit_id, boundary, mode) of items (commit_id, x, text) are narrowed: to
    the right end of the row titles left of the boundary, and a margin (``|hdr_cluster``); where that doesn't narrow a split by
    ratio, to the middle of five or more short texts there (``|hdr_med_fallback``). It's narrowed only if titles lie close, and
    labels and enough values are left on either side."""
    text, x, b = stripped(F.col("text")), F.col("x"), F.col("boundary")
    met = items.join(splits, "commit_id")
    held, kind = spare(met, "label"), spare(met, "title")
    # What a text is is told once, and only left of the boundary; later stages read the two columns.
    inside = (x <= b) & (text != "")
    met = met.withColumn(held, F.when(inside, let(text, lambda t: ~is_zone_title(t) & ~is_value(t))))
    met = met.withColumn(kind, F.when(F.col(held), let(text, lambda t: is_loose_title(t, F.lit(True)) | is_row_title(t, F.lit(True)))))
    title, short = F.col(kind), F.col(held) & (F.length(text) <= 22)
    stats = met.groupBy("commit_id").agg(
        F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.first("boundary").alias("b"), F.first("mode").alias("m"),
        F.collect_list(F.when(title, x)).alias("titles"), F.collect_list(F.when(short, x)).alias("shorts"),  # a sheet's labels
    )
    span = F.col("x1") - F.col("x0")
    many = F.size("titles") >= 5
    end = lambda q, f: F.when(many, nearest_rank(F.col("titles"), q)).otherwise(f("titles"))
    low, high = end(0.10, F.array_min), end(0.90, F.array_max)
    wide = F.least(span * 0.45, F.greatest(F.col("b") - F.col("x0"), span * 0.02, F.lit(400.0)) * 1.05, F.lit(12_000.0))
    first = F.when((span >= 250) & (F.size("titles") >= 1) & (high - low <= wide), high + F.greatest(F.lit(70.0), F.least(span * 0.024, F.lit(560.0))))
    second = F.when(F.size("shorts") >= 5, median(F.col("shorts")) + F.greatest(F.lit(85.0), F.least(span * 0.028, F.lit(520.0))))
    narrower = lambda c: F.when(c < F.col("b") - 0.5, c)
    found = stats.select("commit_id", "n", "b", "m", narrower(first).alias("one"), narrower(second).alias("two"))
    sides = items.join(found, "commit_id").groupBy("commit_id", "n", "b", "m", "one", "two").agg(
        *(F.count_if(F.col("x") <= F.col(c)).alias(f"{c}_left") for c in ("one", "two"))
    )
    enough = lambda c: F.coalesce((F.col(f"{c}_left") >= 1) & (F.col("n") - F.col(f"{c}_left") >= F.greatest(F.lit(4), F.floor(F.col("n") / 24))), F.lit(False))
    by_title, by_short = enough("one"), enough("two") & F.col("m").startswith("left_ratio")
    pick = lambda a, b_, c: F.when(by_title, a).when(by_short, b_).otherwise(c)
    return sides.select("commit_id", pick(F.col("one"), F.col("two"), F.col("b")).alias("boundary"), pick(F.concat("m", F.lit("|hdr_cluster")), F.concat("m", F.lit("|hdr_med_fallback")), F.col("m")).alias("mode"))
