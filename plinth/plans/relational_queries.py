"""Queries of the relational core: scans, counts, listings, joins, sets and settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plinth.operators import relational as R, sketches as K
from plinth.plans import views as V
from plinth.plans.catalog import query
from plinth.session import table


@query("""
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(avg(l_discount), 9) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY 1, 2
""")
def q_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.avg("l_discount"), 9).alias("avg_disc"), F.count("*").alias("count_order"))


@query(f"WITH d AS ({V.TEXTS}) SELECT commit_id, entity_type, count(*) AS n, count(x) AS with_place FROM d GROUP BY 1, 2")
def diag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.diagnostics(V.texts(spark, sf_dir))


@query(f"WITH d AS ({V.TEXTS}) SELECT commit_id, coalesce(nullif(layer, 'R'), '0') AS layer, count(*) AS n FROM d GROUP BY 1, 2")
def layers_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.layers_index(V.texts(spark, sf_dir).withColumn("layer", F.nullif(F.col("layer"), F.lit("R"))))


@query("SELECT p_brand AS block_name, count(*) AS n FROM part GROUP BY 1")
def blocks_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("block_name")).agg(F.count("*").alias("n"))


@query(f"WITH d AS ({V.SHAPES}) SELECT commit_id, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy FROM d GROUP BY 1")
def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bounds(V.shapes(spark, sf_dir))


@query(f"""
WITH d AS ({V.TEXTS}) SELECT commit_id, id, layer, text, x, y, entity_type FROM d
WHERE x BETWEEN 2000 AND 30000 AND y BETWEEN -3000 AND -500 AND regexp_full_match(upper(layer), 'A|N')
""")
def text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.text_items(V.texts(spark, sf_dir), R.Selection(box=(30000, -500, 2000, -3000), include_layers=["a|n", "x.*"], exclude_layers=["r"]))
    return found.select("commit_id", "id", "layer", "text", "x", "y", "entity_type")


@query(f"""
WITH d AS ({V.POINTS}) SELECT id, entity_type, x, y FROM d WHERE sqrt((x - 50) * (x - 50) + (y - 40) * (y - 40)) <= 30 ORDER BY id LIMIT 50
""")
def near_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.near(V.points(spark, sf_dir), 50.0, 40.0, 30.0).select("id", "entity_type", "x", "y")


@query(f"WITH d AS ({V.POINTS}) SELECT commit_id, arg_min(x, id) AS x, arg_min(y, id) AS y FROM d GROUP BY 1")
def first_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_place(V.points(spark, sf_dir))


@query("SELECT o_orderkey AS commit_id, c_custkey AS project_id, c_name AS project, o_orderstatus AS status FROM orders JOIN customer ON o_custkey = c_custkey")
def commit_project_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(F.col("o_orderkey").alias("commit_id"), F.col("c_custkey").alias("project_id"), F.col("c_name").alias("project"), F.col("o_orderstatus").alias("status"))


@query("""
SELECT c_custkey AS file_id, c_name AS name, n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY 1) ON o_custkey = c_custkey
""")
def commit_file_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "orders").filter("o_totalprice > 200000").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("file_id"), F.col("c_name").alias("name"), "n")


@query("SELECT c_custkey AS project_id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def semi_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    return table(spark, sf_dir, "customer").join(pending, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(F.col("c_custkey").alias("project_id"))


@query("SELECT c_custkey AS project_id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("project_id"))


@query("""
SELECT o_orderkey AS commit_id, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') THEN NULL ELSE o_custkey END AS parent_commit_id
FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50)
""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit_id"), F.col("o_custkey").alias("parent_commit_id"))
    gone = table(spark, sf_dir, "lineitem").filter("l_quantity >= 50").select("l_orderkey")
    left = R.without({"commits": commits}, gone, {"commits": "commit_id"})["commits"]
    return R.orphaned(left, table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey"))


@query("""
WITH inserts AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_partkey END AS block_def_id, 'name' || CAST(l_suppkey % 20 AS VARCHAR) AS block_name FROM lineitem),
names AS (SELECT 'name' || CAST(p_partkey % 30 AS VARCHAR) AS name, arg_min(p_size, p_partkey) AS base FROM part GROUP BY 1)
SELECT id, block_def_id, block_name, coalesce(p_size, base) AS p_size FROM inserts LEFT JOIN part ON block_def_id = p_partkey LEFT JOIN names ON block_name = name
""")
def block_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    inserts = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + n).alias("id"), F.when(n != 1, F.col("l_partkey")).alias("block_def_id"), F.concat(F.lit("name"), (F.col("l_suppkey") % 20).cast("string")).alias("block_name"))
    defs = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("name"), (F.col("p_partkey") % 30).cast("string")).alias("name"), "p_size")
    return R.looked_up(inserts, defs, ("block_def_id", "p_partkey"), ("block_name", "name"), "p_size")


@query("SELECT o_orderkey AS id, o_custkey AS project_id, o_orderdate AS created_at FROM orders ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey DESC LIMIT 100")
def latest_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = table(spark, sf_dir, "orders").orderBy(F.col("o_orderdate").desc_nulls_first(), F.col("o_orderkey").desc()).limit(100)
    return newest.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project_id"), F.col("o_orderdate").alias("created_at"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("n", F.row_number().over(w)).filter("n <= 3").select("o_custkey", "o_orderkey", "o_totalprice")


@query("""
WITH d AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax) AS n FROM lineitem)
SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber, l_extendedprice FROM d WHERE n > 1
""")
def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_shipdate", "l_discount", "l_tax"]
    return R.duplicates(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_partkey"], order).select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("""
SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT n_name FROM nation WHERE n_regionkey = 1
""")
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.select(F.col("n_name").alias("name")).unionByName(region.select(F.col("r_name").alias("name"))).unionByName(nation.filter("n_regionkey = 1").select(F.col("n_name").alias("name")))


@query("""
SELECT 'both' AS side, k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)
UNION ALL SELECT 'left', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)
UNION ALL SELECT 'any', k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)
""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    c, s = customer.select(F.col("c_nationkey").alias("k")), supplier.select(F.col("s_nationkey").alias("k"), "s_acctbal")
    rich = s.filter("s_acctbal > 9000").select("k")
    tag = lambda df, side: df.select(F.lit(side).alias("side"), "k")
    return tag(customer.filter("c_acctbal > 0").select(F.col("c_nationkey").alias("k")).intersect(rich), "both").union(tag(c.subtract(rich), "left")).union(tag(c.union(s.select("k")).distinct(), "any"))


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, grouping(l_returnflag) * 2 + grouping(l_linestatus) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)
""")
def cube_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("suppliers"), F.grouping_id().alias("level"))


@query("SELECT o_orderstatus, o_orderpriority, sum(o_totalprice) AS total, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("n"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) * 2 AS twice FROM events")
def json_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), (k.cast("bigint") * 2).alias("twice"))


@query("""
SELECT event_id, event_type AS tag, CASE WHEN event_id % 2 = 0 THEN 'new' ELSE 'old' END AS status, CASE WHEN event_id % 2 = 0 THEN 'n' END AS note, 'b' AS deep_b, 'a' || CAST(event_id % 2 AS VARCHAR) AS deep_a FROM events
""")
def json_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("event_id") % 2 == 0
    old = F.create_map(F.lit("tag"), "event_type", F.lit("status"), F.lit("old"), F.lit("sub_tags"), F.lit('{"a": "a1", "b": "b"}'))
    new = F.when(even, F.create_map(F.lit("status"), F.lit("new"), F.lit("note"), F.lit("n"), F.lit("sub_tags"), F.lit('{"a": "a0"}'))).otherwise(F.create_map().cast("map<string,string>"))
    out = table(spark, sf_dir, "events").select("event_id", R.merged_settings(old, new).alias("m"))
    deep = F.from_json("m.sub_tags", "map<string,string>")
    return out.select("event_id", "m.tag", "m.status", F.try_element_at("m", F.lit("note")).alias("note"), deep["b"].alias("deep_b"), deep["a"].alias("deep_a"))


@query(f"""
WITH d AS ({V.TEXTS}), e AS (SELECT layer, count(*) AS n, count(DISTINCT text) AS texts FROM d GROUP BY 1)
SELECT layer, n, texts, true AS distinct_holds, true AS median_holds FROM e
""")
def sketch_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of each drawing's layers, merged by layer, beside exact counts: whether both are within their bounds."""
    items = V.texts(spark, sf_dir)
    whole = K.merged(K.sketched(items, ["commit_id", "layer"], "text", "y"), ["layer"]).select("layer", "n", K.distinct_count().alias("about"), K.quantile(0.5).alias("median"))
    exact = items.join(F.broadcast(whole.select("layer", "median")), "layer").groupBy("layer").agg(F.countDistinct("text").alias("texts"), F.avg((F.col("y") < F.col("median")).cast("int")).alias("below"), F.avg((F.col("y") <= F.col("median")).cast("int")).alias("upto"))
    held = whole.join(exact, "layer")
    return held.select("layer", "n", "texts", (F.abs(F.col("about") - F.col("texts")) <= 0.05 * F.col("texts")).alias("distinct_holds"), ((F.col("below") <= 0.53) & (F.col("upto") >= 0.47)).alias("median_holds"))
