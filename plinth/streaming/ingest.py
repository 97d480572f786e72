"""Ingest of drawings as a stream: files arrive, rows are appended, a status table follows each drawing.

A file source lists each drawing once, and its checkpoint holds what is done. A batch is written under its number, in
overwrite mode, so a batch that is repeated after a failure replaces itself; a status is written when its rows are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from plinth.sources import dxf, store

READY, FAILED = "READY", "FAILED"


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    """DXF files as they arrive."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.dxf").load(folder)


def statuses(rows: DataFrame) -> DataFrame:
    """READY with the number of entities, or FAILED with the message, of each file."""
    out = rows.groupBy("path").agg(F.count_if(F.col("row_kind") == "entity").alias("entities"), F.max(F.when(F.col("row_kind") == "error", F.col("value"))).alias("message"))
    return out.select("path", F.when(F.col("message").isNull(), READY).otherwise(FAILED).alias("status"), "entities", "message")


def ingest(spark: SparkSession, folder: str, target: str, checkpoint: str, skip_off_layers: bool = False) -> StreamingQuery:
    """Start the stream: entities and statuses below ``target``, a folder for each batch."""

    def write(files: DataFrame, batch: int) -> None:
        rows = dxf.scan(files, skip_off_layers)
        staging = f"{target}/rows/batch={batch}"
        rows.write.mode("overwrite").parquet(staging)  # one scan of the drawings for all that follows
        own = spark.read.parquet(staging)
        store.entities_of(own, F.xxhash64("path")).write.mode("overwrite").parquet(f"{target}/entities/batch={batch}")
        statuses(own).write.mode("overwrite").parquet(f"{target}/status/batch={batch}")

    return arriving(spark, folder).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def next_status(status: str | None, event: str) -> str | None:
    """PENDING, PROCESSING, then READY or FAILED; an event that doesn't fit changes nothing."""
    return {("PENDING", "start"): "PROCESSING", ("PROCESSING", "done"): READY, ("PROCESSING", "fail"): FAILED}.get((status, event), status)
