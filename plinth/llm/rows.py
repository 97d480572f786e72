"""What is decided about rows goes back to them without moving them.

Rows are numbered by partition and place (``row_number_id``). What a job decides about some of them, a few numbers and strings
a row, is shuffled by partition and written to one file for each, in the shared folder. A second pass over the same frame reads
in each task the file of its own partition, so large columns never leave the task that scans them.

Both passes must see the same rows in the same places. A scan of files does if its splits are the same, so the least number
of splits, which would follow the executors that are alive, is fixed (``pinned``); every decision carries a check value of its
row, and a row that isn't where it was is an error, not a wrong result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from plinth.llm.common import tidy
from plinth.llm.files import opened
from plinth.session import scratch_path, staged

#: A row's number is its partition times this, and its place.
SPAN = 1 << 33


def pinned(df: DataFrame) -> DataFrame:
    """``df``, whose scans are split alike from now on (a setting of the session, which stays). A frame that is shuffled, whose
    rows may come in another order each time, is written as a table first."""
    spark = df.sparkSession
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        df = staged(df, "pinned")
    if not spark.conf.get("spark.sql.files.minPartitionNum", None):
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    return df


def row_number_id() -> Column:
    """A row's number, to be selected from a pinned frame directly."""
    return F.monotonically_increasing_id()


def _place(folder: str, part: int) -> str:
    return f"{folder}/{part % 1000:03d}/rows-{part:07d}.arrow"


def decided(decisions: DataFrame) -> str:
    """Write decisions (``row``, ``check``, any more columns; a row once) by partition; the folder they are in.

    A file's name and rows are the same in every attempt, so a task that is run again writes the same file again. It's written
    under another name and then renamed, so an attempt that is killed leaves no part of it."""
    folder = scratch_path(decisions.sparkSession, "decisions")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sink, out, n, where = -1, None, None, 0, None

        def close() -> None:
            out.close()
            sink.close()
            system, place = where
            try:
                system.move(f"{place}.{mark}", place)
            except OSError:  # where a rename doesn't replace: another attempt was first
                if system.get_file_info(place).type == fs.FileType.NotFound:
                    raise
                system.delete_file(f"{place}.{mark}")

        mark = uuid.uuid4().hex
        try:
            for batch in batches:
                own = batch.column(0).to_numpy() // SPAN
                for a, b in zip(edges := [0, *(np.flatnonzero(np.diff(own)) + 1).tolist()], [*edges[1:], len(own)]):
                    if a == b:
                        continue
                    if own[a] != part:
                        if out:
                            close()
                        part = int(own[a])
                        system, place = where = opened(_place(folder, part))
                        system.create_dir(place.rpartition("/")[0], recursive=True)
                        sink = system.open_output_stream(f"{place}.{mark}", compression=None)
                        out, n = ipc.new_stream(sink, batch.schema), n + 1
                    out.write_batch(batch.slice(a, b - a))
        except BaseException:
            if sink:
                sink.close()
            raise
        if out:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["files"])

    dealt = decisions.withColumn("_part", F.expr(f"row div {SPAN}")).repartition("_part").sortWithinPartitions("_part", "row").drop("_part")
    dealt.mapInArrow(tidy(kernel), "files bigint").agg(F.sum("files")).collect()
    return folder


def own_decisions(folder: str) -> pa.Table | None:
    """The decisions of this task's partition, by row; None where there are none."""
    system, place = opened(_place(folder, TaskContext.get().partitionId()))
    if system.get_file_info(place).type == fs.FileType.NotFound:
        return None
    with system.open_input_stream(place, compression=None) as source, ipc.open_stream(source) as stream:
        return stream.read_all()


def met(batches: Iterator[pa.RecordBatch], folder: str, check: Callable[[pa.RecordBatch, np.ndarray], np.ndarray]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.Table | None]]:
    """(batch, places, decisions): of each batch of this task the places that a decision is about, and those decisions.
    ``check(batch, places)`` gives the rows' check values."""
    known = own_decisions(folder)
    rows = known.column("row").to_numpy() % SPAN if known else np.zeros(0, np.int64)
    begin, seen = 0, 0
    for batch in batches:
        a, b = np.searchsorted(rows, (begin, begin + batch.num_rows))
        places = rows[a:b] - begin
        if b > a and not np.array_equal(check(batch, places), known.column("check").to_numpy()[a:b]):
            raise ValueError("rows aren't where they were when it was decided about them")
        yield batch, places, known.slice(a, b - a) if b > a else None
        begin, seen = begin + batch.num_rows, seen + int(b - a)
    if seen != len(rows):
        raise ValueError("there are fewer rows than when it was decided about them")


def text_check(column: pa.Array, places: np.ndarray) -> np.ndarray:
    """crc32 of texts at some places, null as empty, as ``F.crc32`` has it."""
    import zlib

    return np.array([zlib.crc32(x.as_buffer() if x.is_valid else b"") for x in column.take(pa.array(places))], np.int64)


def without(df: DataFrame, text_col: str, gone: DataFrame) -> DataFrame:
    """``df`` less the rows in ``gone`` (``row``, and ``check``, the crc32 of the row's text)."""
    folder, place = decided(gone.select("row", "check")), df.columns.index(text_col)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, places, _ in met(batches, folder, lambda b, at: text_check(b.column(place).cast(pa.string()), at)):
            keep = np.ones(batch.num_rows, bool)
            keep[places] = False
            yield batch.filter(pa.array(keep))

    return df.mapInArrow(tidy(kernel), df.schema)


def check_of(text: Column) -> Column:
    return F.crc32(F.coalesce(text.cast("string"), F.lit("")).cast("binary")).alias("check")
