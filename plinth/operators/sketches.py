"""Approximate aggregates that merge (A23): a table of sketches of each drawing, from which counts of distinct texts and quantiles of any
group of drawings come without reading a drawing again.

Distinct counts are HyperLogLog sketches, quantiles KLL ones, both of bounded size and built and merged by Spark's own aggregates:
a new drawing's sketches are one more row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Size of the sketches: 2^LG buckets, whose error is about 1.04 / sqrt(2^LG), 1.6 % at 12; and KLL's k, whose rank error is about 1.3 % at 200.
LG, K = 12, 200


def sketched(items: DataFrame, keys: Sequence[str], distinct: str, value: str) -> DataFrame:
    """(keys, n, known, distinct, quantiles): for each group of ``items`` its rows, those with a value, and sketches of the distinct values of
    one column and of the numbers of another. Nulls are in neither; a group of nulls only has null for the sketch. NaN is no number."""
    number = F.col(value).cast("double")
    number = F.when(~F.isnan(number), number)
    return items.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count(number).alias("known"), F.hll_sketch_agg(F.col(distinct).cast("string"), F.lit(LG)).alias("distinct"), F.when(F.count(number) > 0, F.kll_sketch_agg_double(number, F.lit(K))).alias("quantiles")
    )


def merged(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sketches of coarser groups, from those of finer ones."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("known").alias("known"), F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("quantiles").alias("quantiles"))


def distinct_count(sketch: str = "distinct") -> Column:
    return F.coalesce(F.hll_sketch_estimate(sketch), F.lit(0))


def quantile(share: float, sketch: str = "quantiles") -> Column:
    """The value whose rank is about so large a share of all; null where there is none."""
    return F.when(F.col("known") > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(share)))


def rank(value: float, sketch: str = "quantiles") -> Column:
    """About which share of the numbers are at most the value."""
    return F.when(F.col("known") > 0, F.kll_sketch_get_rank_double(sketch, F.lit(value)))
