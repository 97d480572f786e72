"""Joins by place: how windows meet shapes."""

from plinth.operators import spatial
from plinth.operators.spatial import window_join


def test_windows_of_drawings_are_not_broadcast(spark):
    """A window is a row for each cell and level, which the planner doesn't count: broadcast, they filled the driver."""
    windows = spark.range(3).selectExpr("id as commit_id", "id as window_id", "0D as x0", "50D as x1", "0D as y0", "50D as y1")
    shapes = spark.range(30).selectExpr("id % 3 as commit_id", "id", "1D * id as minx", "id + 1D as maxx", "10D as miny", "20D as maxy")
    met = window_join(windows, shapes, 10.0, ["commit_id"])
    assert "BroadcastExchange" not in met._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.window_id, r.id) for r in met.collect()) == [(i % 3, i) for k in range(3) for i in range(k, 30, 3)]


def test_points_of_inserted_blocks_are_placed_once(spark):
    """F8: a filter on extents, as any window join has, must not place all points again for each of its sides."""
    shape = [("LINE", "0", False, [(0.0, 0.0), (3.0, 4.0)]), ("HATCH", "0", False, [(1.0, 1.0)])]
    blocks = spark.createDataFrame([(1, 5, "b", 0.0, 0.0, shape)], "commit_id int, id int, name string, base_x double, base_y double, members array<struct<entity_type:string,layer:string,from_dimension:boolean,points:array<struct<x:double,y:double>>>>")
    inserts = spark.createDataFrame([(1, i, 5, None, 10.0 * i, 0.0, 90.0, 2.0, 1.0) for i in range(4)], "commit_id int, id int, block_def_id int, block_name string, insert_x double, insert_y double, rotation double, scale_x double, scale_y double")
    windows = spark.createDataFrame([(1, 5.0, 15.0, -1.0, 20.0)], "window_id int, x0 double, x1 double, y0 double, y1 double")
    got = spatial.window_join(windows, spatial.block_shapes(inserts, blocks), 20.0)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("transform(") == 1
    rows = {r.entity_type: r for r in got.collect()}
    assert sorted(rows) == ["HATCH", "LINE"] and {r.insert_id for r in rows.values()} == {1}
    assert [round(rows["LINE"][c], 6) for c in ("minx", "miny", "maxx", "maxy")] == [6.0, 0.0, 10.0, 6.0] and len(rows["LINE"].points) == 2


def test_the_few_blocks_of_block_shapes_are_broadcast(spark):
    """F8: joined by shuffles, all inserts went to as many tasks as there are blocks."""
    from plinth.plans.registry import QUERIES

    plan = QUERIES["block_shapes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 3
