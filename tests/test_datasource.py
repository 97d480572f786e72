"""Drawings through spark.read and spark.readStream."""

import os

import pytest

from plinth.session import ship
from plinth.sources import datasource as D, dxf
from tests.test_dxf import TEXT, drawing, tags


@pytest.fixture
def folder(spark, tmp_path):
    ship(spark)
    spark.dataSource.register(D.DxfSource)
    (tmp_path / "deep").mkdir()
    for i, name in enumerate(["a.dxf", "deep/b.DXF", "c.dxf"]):
        (tmp_path / name).write_bytes(drawing(TEXT * (i + 1) + tags((0, "CIRCLE"), (8, "0"), (10, i), (20, 0), (40, 1))))
        os.utime(tmp_path / name, (1000 + i, 1000 + i))
    (tmp_path / "note.txt").write_text("no drawing")
    return tmp_path


def test_reads_like_the_scan(spark, folder):
    own = spark.read.format("dxf").load(str(folder))
    files = spark.createDataFrame([(str(p), p.read_bytes()) for p in folder.rglob("*") if p.suffix.lower() == ".dxf"], "path string, content binary")
    want = dxf.scan(files)
    assert own.schema == want.schema
    name = lambda r: (r.path.rpartition("/")[2], r.row_kind, r.seq, r.entity_type, r.layer, r.cx, str(r.points))
    assert sorted(map(name, own.collect()), key=str) == sorted(map(name, want.collect()), key=str)
    assert spark.read.format("dxf").load(str(folder / "c.dxf")).filter("row_kind = 'entity'").count() == 4
    circles = spark.read.format("dxf").option("row_kinds", "entity").option("partition_bytes", "1").load(str(folder))
    assert circles.rdd.getNumPartitions() == 3 and {r.row_kind for r in circles.collect()} == {"entity"} and circles.filter("entity_type = 'CIRCLE'").agg({"cx": "sum"}).first()[0] == pytest.approx(3.0)
    assert spark.read.format("dxf").load(str(folder / "none")).count() == 0


def test_streams_take_files_once(spark, folder, tmp_path_factory):
    out, state = (str(tmp_path_factory.mktemp(n)) for n in ("out", "state"))

    def run():
        stream = spark.readStream.format("dxf").option("row_kinds", "entity").load(str(folder))
        stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
        return spark.read.schema(stream.schema).parquet(out).count()

    assert run() == 2 + 3 + 4
    assert run() == 9  # nothing is new
    (folder / "d.dxf").write_bytes(drawing(TEXT))
    assert run() == 10


def test_batches_have_bounds():
    files = [(i, f"f{i}", n) for i, n in enumerate([5, 5, 20, 1, 1])]
    assert [p.paths for p in D.dealt(files, 10)] == [("f0", "f1"), ("f2",), ("f3", "f4")] and D.dealt([], 10) == []
    with pytest.raises(ValueError, match="path"):
        D._Reader({})
