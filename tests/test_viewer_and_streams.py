import pytest
from pyspark.sql import functions as F

from plinth.operators import viewer
from plinth.streaming import events as E, ingest
from tests.test_dxf import TEXT, drawing

COLUMNS = "commit_id long, id long, entity_type string, layer string, color int, color_raw int, true_color int, lineweight int, text string, text_align_x double, text_align_y double, height double, char_height double, cx double, cy double, points array<struct<x:double,y:double>>, minx double, miny double, maxx double, maxy double"


def test_pens_and_preview(spark):
    line = [{"x": 0.0, "y": 0.0}, {"x": 5.0, "y": 5.0}]
    rows = [
        (1, 1, "LINE", "x$WALL", 256, 256, None, 45, None, None, None, None, None, 2.5, 2.5, line, 0.0, 0.0, 5.0, 5.0),
        (1, 2, "LINE", "WALL", 256, 256, 16744512, -1, None, None, None, None, None, 2.5, 2.5, line, 0.0, 0.0, 5.0, 5.0),
        (1, 3, "TEXT", None, 3, 3, None, None, "t" * 600, 9.0, 9.0, 10.0, None, 1.0, 1.0, line[:1], 1.0, 1.0, 1.0, 1.0),
        (1, 4, "POINT", "other", None, None, None, None, None, None, None, None, None, 7.0, 7.0, line[:1], float("nan"), 0.0, 0.0, 0.0),
    ]
    entities = spark.createDataFrame(rows, COLUMNS)
    layers = spark.createDataFrame([(1, "Wall", "1"), (1, "none", "")], "commit_id long, layer string, color string")
    got = viewer.preview(entities, layers)
    pens = {r.id: r.pen for r in got["labels"].select("id", "pen").union(got["vectors"].select("id", "pen")).collect()}
    assert pens == {1: 1, 2: 16744512, 3: 3, 4: 7}
    label = got["labels"].first()
    assert (len(label.text), label.x, label.minx) == (500, 9.0, 3.0)
    assert {r.id: (r.kind, r.width) for r in got["vectors"].collect()} == {1: ("line", pytest.approx(1.55)), 2: ("line", None), 4: ("dot", None)}
    assert got["bounds"].first()[1:] == (0.0, 0.0, 15.0, 15.0)
    assert viewer.preview(entities, layers, 2)["vectors"].count() == 2


def test_stream_agrees_with_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 {i // 6 % 24:02}:{i * 7 % 60:02}:00", i % 3, "click" if i % 2 else "view", float(i)) for i in range(200)]
    batch = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    batch.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    run = E.tumbling(stream, "1 hour").writeStream.format("memory").queryName("hours").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.table("hours")) == key(E.tumbling(batch, "1 hour"))
    assert E.once(batch.union(batch)).count() == 200
    assert E.sliding(batch, "2 hours", "1 hour").agg(F.sum("n")).first()[0] == 400
    assert E.sessions(batch, "30 minutes").agg(F.sum("n")).first()[0] == 200


def test_ingest(spark, tmp_path):
    folder, target = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    (folder / "a.dxf").write_bytes(drawing(TEXT))
    for expected in (1, 2):
        ingest.ingest(spark, str(folder), str(target), str(tmp_path / "check")).awaitTermination()
        status = spark.read.parquet(str(target / "status"))
        assert status.filter("status = 'READY' and entities = 1").count() == expected
        (folder / "b.dxf").write_bytes(drawing(TEXT))
    assert spark.read.parquet(str(target / "entities")).count() == 2


def test_statuses():
    assert ingest.next_status("PENDING", "start") == "PROCESSING"
    assert ingest.next_status("READY", "start") == "READY"
    assert ingest.next_status("PROCESSING", "fail") == "FAILED"
