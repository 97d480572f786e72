from types import SimpleNamespace

import pytest

from plinth import session
from plinth.session import shared_dir, spare


def test_only_small_tables_are_dealt_out(spark, tmp_path, monkeypatch):
    spark.range(1000).repartition(1).write.parquet(str(tmp_path / "one"))
    spark.range(1000).repartition(16).write.parquet(str(tmp_path / "many"))
    parts = lambda name: session.spread(spark.read.parquet(str(tmp_path / name))).rdd.getNumPartitions()
    assert parts("one") == spark.sparkContext.defaultParallelism
    many = spark.read.parquet(str(tmp_path / "many"))
    assert session.spread(many) is many
    monkeypatch.setattr(session, "SMALL", 1)
    assert parts("one") == 1


def test_staged_tables_are_written_where_the_cluster_says(spark):
    df = session.staged(spark.range(5).toDF("x"), "t")
    place = "/" + session.shared_dir(spark).removeprefix("file:").lstrip("/")
    assert df.inputFiles() and all(place + "/plinth/t-" in f for f in df.inputFiles())
    session.forget(spark, df)
    assert session.scratch_path(spark, "a") != session.scratch_path(spark, "a")


def test_spare_names(spark):
    df = spark.createDataFrame([(1, 2)], "A int, a_1 int")
    assert spare(df, "b") == "b" and spare(df, "a") == "a_2"


def test_a_cluster_must_name_a_shared_folder():
    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: {})
        _jsc = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False)))

    session = SimpleNamespace(sparkContext=Context(), conf=SimpleNamespace(get=lambda *_: None))
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(session)
