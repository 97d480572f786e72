"""Numbers 1, 2, ... in an order, without one task for all rows: rows are sorted over all tasks by ranges, numbered in each, and each range
begins where those before it end. What is added up in one place is a count a range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plinth.session import spare, staged


def numbered(df: DataFrame, order: Sequence[str | Column], name: str, start: int = 0) -> DataFrame:
    """``df`` with a column ``name``: its rows' numbers in an order, from ``start`` + 1. Rows of equal order get numbers next to one
    another. A column of that name is replaced."""
    part, place, base = (spare([*df.columns, name], n) for n in ("part", "place", "base"))
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    held = staged(ranged.withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id()), "numbered")
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = held.groupBy(part).agg(F.count("*").alias(base)).withColumn(base, F.coalesce(F.sum(base).over(before), F.lit(0)))
    own = F.row_number().over(Window.partitionBy(part).orderBy(place))
    out = held.withColumn(name, own) if name not in df.columns else held.drop(name).withColumn(name, own)
    return out.join(F.broadcast(starts), part).withColumn(name, (F.col(name) + F.col(base) + F.lit(start)).cast("long")).drop(part, place, base)  # a row a range is broadcast
