"""Session helpers shared by the whole library (nothing here knows about a single operator)."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("plinth")
    defaults = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "12g",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where unset, the context's own checkpoint folder. A
    local session without either gets one; a cluster must name one, as its machines see no folder of the driver's."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found:
        if not context._jsc.sc().getCheckpointDir().isDefined():
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="plinth-checkpoints-"))
        found = context._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/plinth/{tag}-{uuid.uuid4().hex}"


def staged(df: DataFrame, tag: str, group_rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: lineage ends there, so the loss of an
    executor afterwards costs no recomputation, and no later stage runs the plan above a second time.

    ``group_rows``, for rows of megabytes: so many make a row group. Parquet looks at sizes every hundred rows only, and a task
    holds a group whole when it writes and when it reads."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    writer = df.write.option("parquet.block.row.count.limit", group_rows) if group_rows else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the files of staged frames that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for frame in frames:
        for parent in {name.rpartition("/")[0] for name in frame.inputFiles()}:
            if "/plinth/" in parent:
                path = hadoop(parent)
                path.getFileSystem(conf).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a context, so that their Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_plinth_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="plinth-code-")) / "plinth_code.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, f"plinth/{source.relative_to(root)}")
    context.addPyFile(str(archive))
    context._plinth_shipped = True


def spare(df: DataFrame | list[str], name: str) -> str:
    """``name``, or the first of name_1, name_2, ... that no column (of a frame, or of a list) has; case doesn't tell names
    apart."""
    taken = {c.lower() for c in (df.columns if isinstance(df, DataFrame) else df)}
    return next(x for x in (name, *(f"{name}_{i}" for i in range(1, len(taken) + 2))) if x.lower() not in taken)


#: Bytes a core of a table that is worth dealing out.
SMALL = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """For work that is heavy on each row: a small table of fewer files than cores is dealt out over all of them, as a file may
    be one row group, hence one task. Any other stays as it is read, without a shuffle."""
    spark = df.sparkSession
    cores, files = spark.sparkContext.defaultParallelism, df.inputFiles()
    if len(files) >= cores:
        return df
    path, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    size = sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in map(path, files))
    return df.repartition(cores) if size <= cores * SMALL else df
