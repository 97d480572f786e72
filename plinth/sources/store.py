"""Sinks: drawings' rows into partitioned tables, uploads with their checksums, and the history of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plinth.sources.dxf import MOST_MEMBERS


def entities_of(rows: DataFrame, commit_id: Column) -> DataFrame:
    """Entity rows with a geometry, for the table of entities."""
    out = rows.filter((F.col("row_kind") == "entity") & (F.size("points") > 0))
    keep = ["entity_type", "layer", "color", "points", "cx", "cy", "minx", "miny", "maxx", "maxy", "props", "insert_key", "block_path"]
    return out.select(commit_id.alias("commit_id"), F.col("seq").alias("id"), *keep)


def blocks_of(rows: DataFrame, commit_id: Column) -> DataFrame:
    """The first definition of each name, numbered by its row, with its members (null for blocks of more than
    ``MOST_MEMBERS``), as ``spatial.block_shapes`` takes them."""
    own = rows.withColumn("commit_id", commit_id)
    fields = [F.col("seq").alias("id"), F.col("x").alias("base_x"), F.col("y").alias("base_y"), F.col("n").alias("entity_count")]
    first = own.filter("row_kind = 'block'").groupBy("commit_id", "block_name").agg(F.min_by(F.struct(*fields), "seq").alias("d"))
    member = F.struct("seq", "entity_type", "layer", F.lit(False).alias("from_dimension"), "points")
    members = own.filter("row_kind = 'member'").groupBy("commit_id", "block_name").agg(F.array_sort(F.collect_list(member)).alias("members"))  # bounded by MOST_MEMBERS
    small = F.when(F.col("d.entity_count") <= MOST_MEMBERS, F.coalesce("members", F.array().cast(members.schema["members"].dataType)))
    return first.join(members, ["commit_id", "block_name"], "left").select("commit_id", "d.id", F.col("block_name").alias("name"), "d.base_x", "d.base_y", "d.entity_count", small.alias("members"))


def inserts_of(rows: DataFrame, commit_id: Column) -> DataFrame:
    out = rows.filter("row_kind = 'insert'")
    return out.select(commit_id.alias("commit_id"), F.col("insert_key").alias("id"), "block_name", "layer", "color", F.col("x").alias("insert_x"), F.col("y").alias("insert_y"), "rotation", "scale_x", "scale_y")


def attributes_of(rows: DataFrame, inserts: DataFrame, commit_id: Column) -> DataFrame:
    """Attributes of inserts that are there."""
    out = rows.filter("row_kind = 'attribute'").select(commit_id.alias("commit_id"), F.col("insert_key").alias("insert_id"), "tag", "value")
    return out.join(inserts.select("commit_id", F.col("id").alias("insert_id")), ["commit_id", "insert_id"], "left_semi")


def statistics(rows: DataFrame) -> DataFrame:
    """S3: entities of each type and blocks with a name of their own, by file."""
    named = F.when((F.col("row_kind") == "block") & ~F.col("block_name").startswith("*"), F.lit("BLOCK"))
    kind = F.coalesce(named, F.when(F.col("row_kind") == "entity", F.col("entity_type")))
    return rows.withColumn("kind", kind).filter("kind is not null").groupBy("path", "kind").agg(F.count("*").alias("n"))


def write_partitioned(df: DataFrame, path: str, mode: str = "append") -> None:
    """A table in a folder for each drawing; rows of a drawing go to one task, which sorts them for tight statistics of
    extents."""
    order = [c for c in ("entity_type", "minx", "id") if c in df.columns]
    df.repartition("commit_id").sortWithinPartitions("commit_id", *order).write.mode(mode).partitionBy("commit_id").parquet(path)


def uploads(files: DataFrame) -> DataFrame:
    """Name (safe characters, at most 200), checksum and size of each file of a ``binaryFile`` scan."""
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"[^\w.\-가-힣]", "_")
    return files.select("path", F.when(F.length(name) > 200, F.sha2(F.col("path"), 256)).otherwise(name).alias("name"), F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("size"))


def run_history(runs: DataFrame, commit_id: int | None = None) -> DataFrame:
    """Runs of all drawings or one, the latest first."""
    out = runs if commit_id is None else runs.filter(F.col("commit_id") == commit_id)
    return out.orderBy(F.col("id").desc())
