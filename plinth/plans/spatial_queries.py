"""Queries of joins by place and of plane geometry."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from plinth.functions import geometry as G
from plinth.operators import clusters as C, sections, spatial as P
from plinth.plans import views as V
from plinth.plans.catalog import query
from plinth.session import table


@query(f"WITH s AS ({V.SHAPES}), w AS ({V.WINDOWS}) SELECT window_id, entity_type, count(*) AS n FROM s JOIN w ON minx <= x1 AND maxx >= x0 AND miny <= y1 AND maxy >= y0 GROUP BY 1, 2")
def bbox_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.window_join(V.windows(spark, sf_dir), V.shapes(spark, sf_dir), 1000.0).groupBy("window_id", "entity_type").agg(F.count("*").alias("n"))


@query(f"""
WITH d AS ({V.POINTS}), s AS (SELECT commit_id, id, x FROM d WHERE entity_type <> 'click'), t AS (SELECT commit_id, x AS tx, max(id) AS template FROM d WHERE entity_type = 'click' GROUP BY 1, 2)
SELECT commit_id, id, x, tx, template FROM s JOIN t USING (commit_id) QUALIFY row_number() OVER (PARTITION BY commit_id, id ORDER BY abs(x - tx), tx) = 1
""")
def nearest_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.points(spark, sf_dir)
    left = d.filter("entity_type <> 'click'").select("commit_id", "id", "x")
    right = d.filter("entity_type = 'click'").groupBy("commit_id", F.col("x").alias("tx")).agg(F.max("id").alias("template"))
    return P.nearest(left, right, "commit_id", "x", "tx", ["template"]).filter("template is not null")


@query(f"""
WITH d AS ({V.POINTS}), v AS (SELECT DISTINCT commit_id, x FROM d)
SELECT commit_id, x, round(coalesce((x + lag(x) OVER w) / 2, -1e9), 6) AS low, round(coalesce((x + lead(x) OVER w) / 2, 1e9), 6) AS high FROM v WINDOW w AS (PARTITION BY commit_id ORDER BY x)
""")
def interval_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = V.points(spark, sf_dir).select("commit_id", "x").distinct()
    out = P.midpoint_intervals(values, ["commit_id"], "x")
    clamp = lambda c: F.round(F.greatest(F.least(F.col(c), F.lit(1e9)), F.lit(-1e9)), 6)
    return out.select("commit_id", "x", clamp("low").alias("low"), clamp("high").alias("high"))


@query(f"""
WITH d AS ({V.POINTS}), v AS (SELECT DISTINCT commit_id, x FROM d)
SELECT commit_id, x, round(least((x - lag(x) OVER w) / 2, (lead(x) OVER w - x) / 2), 6) AS half_width FROM v WINDOW w AS (PARTITION BY commit_id ORDER BY x)
""")
def half_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = V.points(spark, sf_dir).select("commit_id", "x").distinct()
    return P.half_widths(values, ["commit_id"], "x").withColumn("half_width", F.round("half_width", 6))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, round(l_extendedprice + CASE WHEN l_linenumber = 1 THEN dx ELSE dx * cos(radians(l_linenumber * 15 - 15)) - dy * sin(radians(l_linenumber * 15 - 15)) END, 3) + 0.0 AS x,
    round(l_discount + CASE WHEN l_linenumber = 1 THEN dy ELSE dx * sin(radians(l_linenumber * 15 - 15)) + dy * cos(radians(l_linenumber * 15 - 15)) END, 3) + 0.0 AS y
FROM (SELECT *, (l_quantity - 3) * 2.0 AS dx, (l_tax * 100 - 1) * 0.5 AS dy FROM lineitem)
""")
def affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = (F.col("l_linenumber") * 15 - 15).cast("double")
    p = G.to_world(F.col("l_quantity"), F.col("l_tax") * 100, (F.lit(3), F.lit(1)), (F.col("l_extendedprice"), F.col("l_discount")), (F.lit(2.0), F.lit(0.5)), turn)
    out = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", p.alias("p"))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", (F.round("p.x", 3) + 0.0).alias("x"), (F.round("p.y", 3) + 0.0).alias("y"))


@query(f"""
WITH d AS ({V.POINTS}), o AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny, count(*) OVER (PARTITION BY commit_id) AS n FROM d WINDOW w AS (PARTITION BY commit_id ORDER BY id))
SELECT commit_id, round(CASE WHEN any_value(n) < 3 THEN 0.0 ELSE sum(x * ny - nx * y) / 2 END, 4) + 0.0 AS area FROM o GROUP BY 1
""")
def shoelace(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = F.transform(F.array_sort(F.collect_list(F.struct("id", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return V.points(spark, sf_dir).groupBy("commit_id").agg((F.round(G.signed_area(ring), 4) + 0.0).alias("area"))


@query("""
WITH d AS (SELECT p_partkey, p_size AS r, CAST(p_partkey % 360 AS DOUBLE) AS sa, CASE WHEN p_size * 30 % 360 <= p_partkey % 360 THEN p_size * 30 % 360 - p_partkey % 360 + 360 ELSE p_size * 30 % 360 - p_partkey % 360 END AS span FROM part),
n AS (SELECT *, least(greatest(CAST(ceil(span / 12.0) AS INT), 8), 256) AS n FROM d)
SELECT p_partkey, CAST(n + 1 AS INT) AS points, round(r * cos(radians(sa + span)), 4) + 0.0 AS last_x, round(r * sin(radians(sa + span)), 4) + 0.0 AS last_y FROM n
""")
def arc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    arc = G.arc_points(F.lit(0.0), F.lit(0.0), F.col("p_size").cast("double"), (F.col("p_partkey") % 360).cast("double"), (F.col("p_size") * 30).cast("double"))
    out = table(spark, sf_dir, "part").select("p_partkey", arc.alias("a"))
    last = F.element_at("a", -1)
    return out.select("p_partkey", F.size("a").alias("points"), (F.round(last["x"], 4) + 0.0).alias("last_x"), (F.round(last["y"], 4) + 0.0).alias("last_y"))


@query(f"""
WITH RECURSIVE d AS ({V.POINTS}), e AS (SELECT DISTINCT p.commit_id, p.id AS a, q.id AS b FROM d p JOIN d q ON p.commit_id = q.commit_id AND (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= 225),
r AS (SELECT commit_id, a, b FROM e UNION SELECT r.commit_id, r.a, e.b FROM r JOIN e ON r.commit_id = e.commit_id AND r.b = e.a)
SELECT commit_id, a AS id, min(b) AS component FROM r GROUP BY 1, 2
""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.components(V.points(spark, sf_dir), 15.0)


@query(f"""
WITH d AS ({V.POINTS}), ux AS (SELECT DISTINCT commit_id, round_even(x, 4) AS v FROM d), uy AS (SELECT DISTINCT commit_id, round_even(y, 4) AS v FROM d),
gx AS (SELECT commit_id, median(g) AS m FROM (SELECT commit_id, v - lag(v) OVER (PARTITION BY commit_id ORDER BY v) AS g FROM ux) GROUP BY 1), gy AS (SELECT commit_id, median(g) AS m FROM (SELECT commit_id, v - lag(v) OVER (PARTITION BY commit_id ORDER BY v) AS g FROM uy) GROUP BY 1),
s AS (SELECT commit_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, count(*) AS n FROM d GROUP BY 1),
t AS (SELECT s.*, CASE WHEN gx.m IS NULL THEN greatest((x1 - x0) * 0.055, 3.0) ELSE greatest(gx.m * 0.42, (x1 - x0) * 0.022, 3.0) END AS tx, CASE WHEN gy.m IS NULL THEN greatest((y1 - y0) * 0.055, 3.0) ELSE greatest(gy.m * 0.42, (y1 - y0) * 0.022, 3.0) END AS ty FROM s JOIN gx USING (commit_id) JOIN gy USING (commit_id)),
f AS (SELECT d.commit_id, y >= y1 - ty AS t, y <= y0 + ty AS b, x <= x0 + tx AS l, x >= x1 - tx AS r FROM d JOIN t USING (commit_id)),
c AS (SELECT commit_id, count(*) AS total, count(*) FILTER (t) AS top, count(*) FILTER (b) AS bottom, count(*) FILTER (l AND NOT t AND NOT b) AS left_side, count(*) FILTER (r AND NOT t AND NOT b) AS right_side FROM f GROUP BY 1)
SELECT commit_id, total, CASE WHEN total >= 4 THEN top END AS top, CASE WHEN total >= 4 THEN bottom END AS bottom, CASE WHEN total >= 4 THEN left_side END AS left_side, CASE WHEN total >= 4 THEN right_side END AS right_side,
    CASE WHEN total >= 4 AND top = bottom THEN top END AS top_bot, CASE WHEN total >= 4 AND left_side = right_side THEN left_side END AS left_right, CASE WHEN total >= 4 THEN top + bottom + left_side + right_side END AS geom_main_total FROM c
""")
def bar_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.bar_census(V.points(spark, sf_dir), ["commit_id"])


@query(f"""
WITH w AS ({V.WINDOWS}) SELECT a.window_id AS a, b.window_id AS b, greatest(a.x0, b.x0 - 2000) AS minx, least(a.x1, b.x1 - 2000) AS maxx, greatest(a.y0, b.y0) AS miny, least(a.y1, b.y1) AS maxy
FROM w a JOIN w b ON b.window_id = a.window_id + 1 WHERE greatest(a.x0, b.x0 - 2000) < least(a.x1, b.x1 - 2000) AND greatest(a.y0, b.y0) < least(a.y1, b.y1)
""")
def box_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = V.windows(spark, sf_dir)
    pairs = w.alias("p").join(w.alias("q"), F.col("q.window_id") == F.col("p.window_id") + 1)
    box = P.common_box([F.col("p.x0"), F.col("p.y0"), F.col("p.x1"), F.col("p.y1")], [F.col("q.x0") - 2000, F.col("q.y0"), F.col("q.x1") - 2000, F.col("q.y1")])
    return pairs.select(F.col("p.window_id").alias("a"), F.col("q.window_id").alias("b"), box.alias("box")).filter("box is not null").select("a", "b", "box.minx", "box.maxx", "box.miny", "box.maxy")


@query(f"""
WITH s AS (SELECT * FROM ({V.SHAPES}) WHERE entity_type = 'LWPOLYLINE'), w AS ({V.WINDOWS}) SELECT window_id, round(max((maxx - minx) * (maxy - miny)), 4) AS area, count(*) AS n
FROM s JOIN w ON minx >= x0 AND maxx <= x1 AND miny >= y0 AND maxy <= y1 WHERE maxx - minx >= 8 AND maxy - miny >= 8 AND (maxx - minx) / (maxy - miny) BETWEEN 0.05 AND 22 GROUP BY 1
""")
def outline_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    corner = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    ring = F.array(corner("minx", "miny"), corner("maxx", "miny"), corner("maxx", "maxy"), corner("minx", "maxy"), corner("minx", "miny"))
    shapes = V.shapes(spark, sf_dir).filter("entity_type = 'LWPOLYLINE'").withColumn("box", G.as_rectangle(ring)).filter("box is not null")
    inside = P.window_join(V.windows(spark, sf_dir), shapes, 1000.0).filter("minx >= x0 and maxx <= x1 and miny >= y0 and maxy <= y1")
    area = (F.col("box.maxx") - F.col("box.minx")) * (F.col("box.maxy") - F.col("box.miny"))
    return inside.groupBy("window_id").agg(F.round(F.max(area), 4).alias("area"), F.count("*").alias("n"))


@query(f"""
WITH d AS ({V.POINTS}) SELECT commit_id, count(DISTINCT (CAST(floor(x / 5) AS BIGINT), CAST(floor(y / 5) AS BIGINT))) AS cells FROM d GROUP BY 1
""")
def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = lambda c: F.floor(F.col(c) / 5).cast("long")
    return V.points(spark, sf_dir).groupBy("commit_id").agg(F.countDistinct(cell("x"), cell("y")).alias("cells"))


@query()
def section_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    corner = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    shapes = V.shapes(spark, sf_dir).withColumn("points", F.array(corner("minx", "miny"), corner("maxx", "maxy")))
    return sections.analyzed(V.windows(spark, sf_dir), shapes, 1000.0)


BLOCKS = "(VALUES (0, 'b0', 0.0, 0.0, 'LINE', 0.0, 0.0, 100.0, 40.0), (1, 'b1', 5.0, 5.0, 'CIRCLE', 10.0, 10.0, 30.0, 30.0), (1, 'b1', 5.0, 5.0, 'LINE', 0.0, 0.0, 50.0, 0.0), (2, 'b2', 0.0, 0.0, 'HATCH', -20.0, -20.0, 20.0, 20.0)) b(def_id, name, bx, by_, kind, px, py, qx, qy)"


@query(f"""
WITH i AS (SELECT l_extendedprice AS ix, l_discount * 1000 AS iy, radians((l_linenumber - 1) * 15.0) AS a, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey % 3 END AS block_def_id, 'b' || (l_suppkey % 4) AS name FROM lineitem),
p AS (SELECT kind, ix, iy, a, unnest([0, 1]) AS k, (px - bx) * 2.0 AS px, (py - by_) * 0.5 AS py, (qx - bx) * 2.0 AS qx, (qy - by_) * 0.5 AS qy, row_number() OVER () AS r FROM i JOIN {BLOCKS} ON b.def_id = i.block_def_id OR (i.block_def_id IS NULL AND b.name = i.name)),
m AS (SELECT kind, r, ix + CASE WHEN k = 0 THEN px ELSE qx END * cos(a) - CASE WHEN k = 0 THEN py ELSE qy END * sin(a) AS x, iy + CASE WHEN k = 0 THEN px ELSE qx END * sin(a) + CASE WHEN k = 0 THEN py ELSE qy END * cos(a) AS y FROM p),
s AS (SELECT kind, r, min(x) AS minx, max(x) AS maxx, min(y) AS miny, max(y) AS maxy FROM m GROUP BY 1, 2), w AS ({V.WINDOWS})
SELECT window_id, kind AS entity_type, count(*) AS n FROM s JOIN w ON minx <= x1 AND maxx >= x0 AND miny <= y1 AND maxy >= y0 GROUP BY 1, 2
""")
def block_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, p, s = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    inserts = table(spark, sf_dir, "lineitem").select(
        F.lit(1).alias("commit_id"), (F.col("l_orderkey") * 10 + n).alias("id"), F.when(n % 2 == 0, (p % 3).cast("int")).alias("block_def_id"), F.concat(F.lit(" b"), (s % 4).cast("string")).alias("block_name"),
        F.col("l_extendedprice").alias("insert_x"), (F.col("l_discount") * 1000).alias("insert_y"), ((n - 1) * 15).cast("double").alias("rotation"), F.lit(2.0).alias("scale_x"), F.lit(0.5).alias("scale_y"),
    )
    member = lambda kind, *xy: (kind, "0", False, [(float(x), float(y)) for x, y in xy])
    rows = [
        (1, 0, "b0", 0.0, 0.0, [member("LINE", (0, 0), (100, 40)), ("TEXT", "0", False, [(0.0, 0.0)])]), (1, 1, "b1", 5.0, 5.0, [member("circle", (10, 10), (30, 30)), member(" ", (0, 0), (50, 0)), ("LINE", "0", True, [(0.0, 0.0)])]),
        (1, 2, "b2", 0.0, 0.0, [member("HATCH", (-20, -20), (20, 20)), member("LINE")]), (1, 3, "b9", 0.0, 0.0, None), (1, 7, "b0", 9.0, 9.0, [member("ARC", (0, 0))]),
    ]
    names = ("commit_id", "id", "name", "base_x", "base_y", "members")
    shaped = lambda m: dict(zip(("entity_type", "layer", "from_dimension"), m)) | {"points": [dict(zip("xy", at)) for at in m[3]]}
    blocks = pa.Table.from_pylist([dict(zip(names, (*row[:5], row[5] and [shaped(m) for m in row[5]]))) for row in rows])
    # Of an Arrow table the planner knows the size, so the few blocks are broadcast, and inserts stay where they are.
    definitions = spark.createDataFrame(blocks, "commit_id int, id int, name string, base_x double, base_y double, members array<struct<entity_type:string,layer:string,from_dimension:boolean,points:array<struct<x:double,y:double>>>>")
    shapes = P.block_shapes(inserts, definitions)
    return P.window_join(V.windows(spark, sf_dir), shapes, 200.0).groupBy("window_id", "entity_type").agg(F.count("*").alias("n"))


@query(f"""
WITH d AS ({V.POINTS}), t AS (SELECT id, x * 500 AS x, y, CAST(id % 6000 AS VARCHAR) AS text FROM d), w AS ({V.WINDOWS})
SELECT window_id, id, x, y, CAST(text AS INT) AS mm FROM t JOIN w ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 WHERE length(text) BETWEEN 2 AND 4 AND CAST(text AS INT) BETWEEN 100 AND 4000
""")
def dimension_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit(" "), (F.col("id") % 6000).cast("string"), F.lit("\nnote 7"))
    return P.dimension_numbers(V.points(spark, sf_dir).withColumn("x", F.col("x") * 500).withColumn("text", text), V.windows(spark, sf_dir), 500.0)
