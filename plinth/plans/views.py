"""Drawing tables derived from the star schema, each as a DataFrame and as the same SQL for DuckDB.

A supplier is a drawing; its line items are the texts on it, at a place made of price and quantity; parts give shapes,
nations give windows, events give points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plinth.session import table

TEXTS = """
SELECT l_suppkey AS commit_id, l_orderkey * 10 + l_linenumber AS id, l_extendedprice AS x, l_linenumber - l_quantity * 100 AS y, l_returnflag AS layer,
    CASE WHEN l_linestatus = 'O' THEN 'TEXT' ELSE 'MTEXT' END AS entity_type,
    concat(CAST(l_linenumber AS VARCHAR), '-D', CAST(p_size AS VARCHAR), ' @', CAST(CAST(l_quantity AS INT) * 10 AS VARCHAR), ' ', CAST(p_size * 20 AS VARCHAR), 'x', CAST(l_linenumber * 100 AS VARCHAR)) AS text
FROM lineitem JOIN part ON l_partkey = p_partkey
"""

SHAPES = """
SELECT l_suppkey AS commit_id, l_orderkey * 10 + l_linenumber AS id, l_returnflag AS layer, l_linenumber AS color, l_extendedprice AS minx, l_extendedprice + l_quantity AS maxx, l_discount * 1000 AS miny,
    l_discount * 1000 + l_tax * 1000 AS maxy, CASE l_linenumber WHEN 1 THEN 'LINE' WHEN 2 THEN 'CIRCLE' WHEN 3 THEN 'ARC' WHEN 4 THEN 'LWPOLYLINE' WHEN 5 THEN 'HATCH' ELSE 'INSERT' END AS entity_type
FROM lineitem
"""

WINDOWS = "SELECT n_nationkey AS window_id, n_nationkey * 3000e0 AS x0, n_nationkey * 3000e0 + 2500e0 AS x1, 10e0 AS y0, 60e0 + n_nationkey AS y1 FROM nation"

POINTS = "SELECT user_id AS commit_id, event_id AS id, value AS x, CAST(event_id % 100 AS DOUBLE) AS y, event_type AS entity_type FROM events"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text items: commit_id, id, x, y, layer, entity_type, text."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    joined = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    number = lambda c: c.cast("string")
    text = F.concat(number(F.col("l_linenumber")), F.lit("-D"), number(F.col("p_size")), F.lit(" @"), number(F.col("l_quantity").cast("int") * 10), F.lit(" "), number(F.col("p_size") * 20), F.lit("x"), number(F.col("l_linenumber") * 100))
    return joined.select(
        F.col("l_suppkey").alias("commit_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_extendedprice").alias("x"),
        (F.col("l_linenumber") - F.col("l_quantity") * 100).alias("y"), F.col("l_returnflag").alias("layer"),
        F.when(F.col("l_linestatus") == "O", "TEXT").otherwise("MTEXT").alias("entity_type"), text.alias("text"),
    )


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes by their extents: commit_id, id, layer, color, entity_type, minx, maxx, miny, maxy."""
    n = F.col("l_linenumber")
    kind = F.when(n == 1, "LINE").when(n == 2, "CIRCLE").when(n == 3, "ARC").when(n == 4, "LWPOLYLINE").when(n == 5, "HATCH").otherwise("INSERT")
    low = F.col("l_discount") * 1000
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("commit_id"), (F.col("l_orderkey") * 10 + n).alias("id"), F.col("l_returnflag").alias("layer"), n.alias("color"), F.col("l_extendedprice").alias("minx"),
        (F.col("l_extendedprice") + F.col("l_quantity")).alias("maxx"), low.alias("miny"), (low + F.col("l_tax") * 1000).alias("maxy"), kind.alias("entity_type"),
    )


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows: window_id, x0, x1, y0, y1."""
    x0 = F.col("n_nationkey") * F.lit(3000.0)
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("window_id"), x0.alias("x0"), (x0 + 2500.0).alias("x1"), F.lit(10.0).alias("y0"), (F.col("n_nationkey") + F.lit(60.0)).alias("y1"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points: commit_id, id (unique), x, y, entity_type."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("commit_id"), F.col("event_id").alias("id"), F.col("value").alias("x"), (F.col("event_id") % 100).cast("double").alias("y"), F.col("event_type").alias("entity_type"))
