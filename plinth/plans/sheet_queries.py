"""Queries of sheets: members' marks and strips, blocks of rows, extraction and its summary, previews, users and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plinth.operators import extraction as X, labels as L, marks as K, records as RC, viewer
from plinth.operators.relational import first_n
from plinth.plans import views as V
from plinth.plans.catalog import query
from plinth.plans.cluster_queries import LEADERS
from plinth.plans.reading_queries import TITLES, titles
from plinth.session import table
from plinth.sources import store

#: Texts at events' places: three in four name a member, the others are sizes; blanks stand before some.
MARKS = f"SELECT commit_id, id, x, y, CASE WHEN id % 4 = 0 THEN CAST(id % 900 + 100 AS VARCHAR) ELSE repeat(' ', CAST(id % 2 AS INT)) || upper(substring(entity_type, 1, 1)) || CAST(id % 40 AS VARCHAR) END AS text FROM ({V.POINTS})"


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    text = F.when(i % 4 == 0, (i % 900 + 100).cast("string")).otherwise(F.concat(F.expr("repeat(' ', cast(id % 2 as int))"), F.upper(F.substring("entity_type", 1, 1)), (i % 40).cast("string")))
    return V.points(spark, sf_dir).select("commit_id", "id", "x", "y", text.alias("text"))


@query(f"""
WITH RECURSIVE d AS ({MARKS}), o AS (SELECT *, row_number() OVER (PARTITION BY commit_id ORDER BY y, x, id) AS rn FROM d),
r AS (SELECT commit_id, rn, y AS y0, 0 AS g FROM o WHERE rn = 1 UNION ALL SELECT o.commit_id, o.rn, CASE WHEN o.y - r.y0 > 2.5 THEN o.y ELSE r.y0 END, CASE WHEN o.y - r.y0 > 2.5 THEN r.g + 1 ELSE r.g END FROM r JOIN o ON o.commit_id = r.commit_id AND o.rn = r.rn + 1),
c AS (SELECT o.*, g, CASE WHEN o.x - lag(o.x) OVER w > 30 THEN 1 ELSE 0 END AS n FROM o JOIN r USING (commit_id, rn) WINDOW w AS (PARTITION BY commit_id, g ORDER BY o.x, id)),
s AS (SELECT *, sum(n) OVER (PARTITION BY commit_id, g ORDER BY x, id ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT commit_id, round(avg(x), 6) AS x, median(y) AS y, arg_max(trim(text), (length(trim(text)), trim(text))) AS text FROM s GROUP BY commit_id, g, run
""")
def mark_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.mark_clusters(marks(spark, sf_dir), 2.5, 30.0).withColumn("x", F.round("x", 6))


@query(f"""
WITH RECURSIVE d AS ({MARKS}), e AS (SELECT DISTINCT p.commit_id, p.id AS a, q.id AS b FROM d p JOIN d q ON p.commit_id = q.commit_id AND (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= 100),
r AS (SELECT commit_id, a, b FROM e UNION SELECT r.commit_id, r.a, e.b FROM r JOIN e ON r.commit_id = e.commit_id AND r.b = e.a), c AS (SELECT a AS id, min(b) AS component FROM r GROUP BY 1)
SELECT commit_id, component, round(avg(x), 6) AS x, round(avg(y), 6) AS y, arg_max(trim(text), (length(trim(text)), trim(text))) AS text FROM d JOIN c USING (id) GROUP BY 1, 2
""")
def mark_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.merged_marks(marks(spark, sf_dir), 10.0).withColumn("x", F.round("x", 6)).withColumn("y", F.round("y", 6))


STRIPS = "SELECT DISTINCT user_id AS commit_id, CAST(event_id % 5 AS INT) AS strip, (event_id % 5) * 25.0e0 AS x_center FROM events"


def strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 5
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("commit_id"), k.cast("int").alias("strip"), (k * F.lit(25.0)).alias("x_center")).distinct()


@query(f"""
WITH d AS ({MARKS}), s AS ({STRIPS}), m AS (SELECT commit_id, strip, x_center, x AS mark_x, abs(y - 50) AS mark_dy, trim(text) AS mark FROM s JOIN d USING (commit_id) WHERE id % 4 <> 0 AND x BETWEEN 10 AND 90 AND abs(y - 50) <= 20)
SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY commit_id, strip ORDER BY abs(mark_x - x_center), mark_dy, mark_x, mark) = 1
""")
def nearest_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = strips(spark, sf_dir)
    sheets = own.select("commit_id").distinct().select("commit_id", F.lit(50.0).alias("y_name"), F.lit(10.0).alias("x_lo"), F.lit(90.0).alias("x_hi"), F.lit(20.0).alias("band"))
    return K.nearest_marks(own, marks(spark, sf_dir), sheets).select("commit_id", "strip", "x_center", "mark_x", "mark_dy", "mark")


@query(f"""
WITH d AS (SELECT *, CAST(id % 5 AS INT) AS strip FROM ({MARKS})), s AS (SELECT *, 60.0 AS cutoff, 'P' || (strip * 3) AS mark FROM ({STRIPS}))
SELECT s.commit_id, s.strip, max(y) AS next_y FROM s JOIN d ON s.commit_id = d.commit_id AND s.strip = d.strip
WHERE id % 4 <> 0 AND abs(x - x_center) <= 40 AND y < 40 AND lower(trim(text)) <> lower(mark) AND NOT (starts_with(lower(trim(text)), lower(mark)) AND length(trim(text)) <= length(mark) + 8) GROUP BY 1, 2
""")
def next_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = strips(spark, sf_dir).withColumn("cutoff", F.lit(60.0)).withColumn("mark", F.concat(F.lit("P"), (F.col("strip") * 3).cast("string")))
    return K.next_member_y(own, marks(spark, sf_dir).withColumn("strip", (F.col("id") % 5).cast("int")), 40.0, 20.0)


LABELLED = f"SELECT commit_id, id, x, y, id // 40 AS block, CASE id % 7 WHEN 0 THEN 'CENTER' WHEN 3 THEN 'END (INT.)' ELSE 'TOP BAR' END AS label, CASE WHEN id % 11 = 0 THEN 'name' ELSE 'bars' END AS kind FROM ({V.POINTS})"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    label = F.when(i % 7 == 0, "CENTER").when(i % 7 == 3, "END (INT.)").otherwise("TOP BAR")
    return V.points(spark, sf_dir).select("commit_id", "id", "x", "y", F.expr("id div 40").alias("block"), label.alias("label"), F.when(i % 11 == 0, "name").otherwise("bars").alias("kind"))


@query(f"""
WITH d AS ({LABELLED}), z AS (SELECT *, CASE WHEN label <> 'TOP BAR' THEN 1 ELSE 0 END AS zone FROM d),
n AS (SELECT *, sum(zone) OVER (PARTITION BY commit_id, block) AS zones, sum(zone) OVER (PARTITION BY commit_id, block ORDER BY id ROWS UNBOUNDED PRECEDING) AS before, row_number() OVER (PARTITION BY commit_id, block ORDER BY id) AS rn FROM z),
p AS (SELECT commit_id, block, id, unnest(CASE WHEN rn = 1 AND zones >= 2 THEN range(CAST(zones AS BIGINT)) WHEN zones >= 2 THEN [CAST(greatest(before - 1, 0) AS BIGINT)] ELSE [0] END) AS piece FROM n)
SELECT commit_id, block, id, CAST(piece AS INT) AS piece FROM p
""")
def zone_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.zone_spans(labelled(spark, sf_dir).withColumnRenamed("id", "position")).select("commit_id", "block", F.col("position").alias("id"), "piece")


@query(f"WITH d AS ({LABELLED}) SELECT commit_id, max(y) FILTER (kind = 'name') AS name_y, median(y) FILTER (label <> 'TOP BAR') AS zone_y FROM d GROUP BY 1")
def template_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.template_places(labelled(spark, sf_dir).select("commit_id", "y", "label", "kind"))


@query(f"""
WITH d AS (SELECT *, CAST(id % 50 AS INT) AS strip FROM ({V.POINTS})), f AS (SELECT *, max(CASE WHEN x > 54 THEN 1 ELSE 0 END) OVER (PARTITION BY commit_id, strip) AS present FROM d)
SELECT commit_id, strip, id FROM f WHERE x > 54 OR present = 0
""")
def left_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.trimmed_left(V.points(spark, sf_dir).withColumn("strip", (F.col("id") % 50).cast("int")), 40.0, 4.0).select("commit_id", "strip", "id")


BOX = (2000.0, -3000.0, 9000.0, -500.0)
#: Texts by part and quantity alone, so that rows repeat.
PLAIN = f"SELECT commit_id, id, x, y, layer, entity_type, CAST(CAST(-y AS INT) // 100 AS VARCHAR) || '-D' || CAST(id % 3 AS VARCHAR) AS text FROM ({V.TEXTS})"
PLAIN_ROWS = LEADERS.replace(f"d AS ({V.TEXTS})", f"d AS (SELECT * FROM ({PLAIN}) WHERE x BETWEEN 2000 AND 9000 AND y BETWEEN -3000 AND -500)")


def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat((F.expr("cast(-y as int) div 100")).cast("string"), F.lit("-D"), (F.col("id") % 3).cast("string"))
    return V.texts(spark, sf_dir).withColumn("text", text)


@query(f"""
WITH {PLAIN_ROWS}, c AS (SELECT commit_id, row_index, string_agg(text, ' ' ORDER BY x, id, text) AS cells FROM rows_ GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY commit_id, substring(cells, 1, 200) ORDER BY row_index) > 1 AS again FROM c),
s AS (SELECT commit_id, count(*) AS row_count, coalesce(string_agg(CAST(row_index AS VARCHAR), ',' ORDER BY row_index) FILTER (again), '') AS duplicates FROM n GROUP BY 1), t AS (SELECT commit_id, count(*) AS n FROM d GROUP BY 1)
SELECT commit_id, 'wall' AS category, coalesce(n, 0) AS text_entity_count, coalesce(row_count, 0) AS row_count, coalesce(duplicates, '') AS duplicates, CAST(1 AS INT) AS boxes, CASE WHEN n IS NULL THEN 'no text in the selection' END AS warning
FROM (SELECT DISTINCT l_suppkey AS commit_id FROM lineitem) LEFT JOIN t USING (commit_id) LEFT JOIN s USING (commit_id)
""")
def extraction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, summary = X.extract(plain(spark, sf_dir), "wall", {"selection_bbox": [9000, -500, 2000, -3000]})
    return summary.select("commit_id", "category", "text_entity_count", "row_count", F.array_join(F.transform("duplicate_row_indices", lambda i: i.cast("string")), ",").alias("duplicates"), "boxes", "warning")


@query(f"""
WITH {PLAIN_ROWS}, c AS (SELECT commit_id, row_index, string_agg(text, '|' ORDER BY x, id, text) AS cells, count(*) AS n, CAST(arg_max(regexp_extract(text, 'D(\\d+)', 1), (x, id, text)) AS INT) AS rebar_d FROM rows_ GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT commit_id, row_index AS row, cells, rebar_d, 'inline' AS variant, 'T1' AS building, row_number() OVER (PARTITION BY commit_id, cells ORDER BY row_index) > 1 AS is_duplicate FROM c
""")
def extraction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = X.extract(plain(spark, sf_dir), "slab", {"selection_bboxes": [[2000, -3000, 9000, -500], "x", [1, 2]], "min_row_texts": "2", "slab_layout": "inline", "building_tag": "T1"})
    return rows.select("commit_id", "row", F.array_join("cells", "|").alias("cells"), "rebar_d", F.col("xy_variant").alias("variant"), "building", "is_duplicate")


@query("""
WITH s AS (SELECT o_custkey AS commit_id, count(*) AS row_count FROM orders GROUP BY 1), h AS (SELECT n_nationkey AS id, n_regionkey AS commit_id, 'slab' AS category, '0.9' AS rules_version, CAST(n_nationkey * 10 AS BIGINT) AS row_count FROM nation)
SELECT id, commit_id, category, rules_version, row_count FROM h UNION ALL SELECT 24 + row_number() OVER (ORDER BY commit_id), commit_id, 'wall', '1.0', row_count FROM s
""")
def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.to_timestamp(F.lit("2020-01-01 00:00:00"))
    n = F.col("n_nationkey")
    history = table(spark, sf_dir, "nation").select(n.cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("commit_id"), F.lit("slab").alias("category"), F.lit("0.9").alias("rules_version"), (n * 10).cast("long").alias("row_count"), at.alias("created_at"))
    summary = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("commit_id")).agg(F.count("*").alias("row_count")).withColumn("category", F.lit("wall"))
    return X.appended_run(history, summary, X.ExtractionConfig(), at).drop("created_at")


@query(f"SELECT commit_id, id FROM ({V.SHAPES}) QUALIFY row_number() OVER (PARTITION BY commit_id ORDER BY id, minx) <= 7")
def preview_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_n(V.shapes(spark, sf_dir), ["commit_id"], [F.col("id"), F.col("minx")], 7).select("commit_id", "id")


@query(f"""
WITH e AS (SELECT commit_id, id, color, CASE layer WHEN 'A' THEN ' ' WHEN 'N' THEN 'x$Wall A' ELSE layer END AS layer FROM ({V.SHAPES})), l AS (SELECT s_suppkey AS commit_id, layer, pen FROM supplier, (VALUES ('0', 11), ('WALLA', 12), ('y|walla', 13)) v(layer, pen))
SELECT e.commit_id, id, CAST(CASE WHEN color = 7 THEN coalesce(CASE WHEN trim(e.layer) = '' THEN 11 WHEN e.layer = 'x$Wall A' THEN 12 END, 7) ELSE color END AS BIGINT) AS pen FROM e
""")
def layer_pens(spark: SparkSession, sf_dir: str) -> DataFrame:
    layer = F.when(F.col("layer") == "A", " ").when(F.col("layer") == "N", "x$Wall A").otherwise(F.col("layer"))
    none = F.lit(None).cast("int")
    entities = V.shapes(spark, sf_dir).withColumn("layer", layer).withColumn("color_raw", none).withColumn("true_color", none).withColumn("color", F.when(F.col("color") == 7, 256).otherwise(F.col("color")))
    pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("layer"), F.lit(b).alias("color")) for a, b in (("0", "11"), ("WALLA", "12"), ("y|walla", "#00000d")))))
    layers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("commit_id"), pairs.alias("p")).select("commit_id", "p.layer", "p.color")
    return viewer.with_pens(entities, layers).select("commit_id", "id", "pen")


@query(f"""
SELECT commit_id, id, substring(text, 1, 500) AS text, x, y, CASE WHEN id % 3 = 0 THEN NULL ELSE CAST(id % 3 * 4 AS DOUBLE) END AS height, x - CASE WHEN id % 3 = 0 THEN 2.0 ELSE greatest(2.0, (id % 3) * 4 * 0.6) END AS minx, y + CASE WHEN id % 3 = 0 THEN 2.0 ELSE greatest(2.0, (id % 3) * 4 * 0.6) END AS maxy FROM ({V.TEXTS})
""")
def preview_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("double")
    height = (F.col("id") % 3 * 4).cast("double")
    own = V.texts(spark, sf_dir).withColumn("pen", F.lit(7)).withColumn("text_align_x", F.when(F.col("id") % 2 == 0, F.col("x"))).withColumn("text_align_y", none).withColumn("cx", F.col("x")).withColumn("cy", F.col("y")).withColumn("height", height).withColumn("char_height", none)
    return viewer.labels(own).select("commit_id", "id", "text", "x", "y", "height", "minx", "maxy")


@query("""
SELECT o_orderkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE o_custkey END AS author FROM orders JOIN customer ON o_custkey = c_custkey
""")
def user_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    tables = {"users": customers.select(F.col("c_custkey").alias("id")), "commits": table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("author"))}
    return RC.user_removed(tables, customers.filter("c_mktsegment = 'BUILDING'").select("c_custkey"), {"commits": "author"})["commits"]


@query("""
SELECT l_orderkey AS commit_id, category, CASE WHEN o_orderkey IS NULL THEN 'unknown commit' WHEN o_orderstatus <> 'F' THEN 'not ready' WHEN category = 'roof' THEN 'unknown category' END AS refused
FROM (SELECT CASE WHEN l_linenumber = 7 THEN -l_orderkey ELSE l_orderkey END AS l_orderkey, CASE l_linenumber % 3 WHEN 0 THEN 'roof' WHEN 1 THEN 'wall' ELSE 'beam' END AS category FROM lineitem) LEFT JOIN orders ON o_orderkey = l_orderkey
""")
def extraction_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, o = F.col("l_linenumber"), F.col("l_orderkey")
    requests = table(spark, sf_dir, "lineitem").select(F.when(n == 7, -o).otherwise(o).alias("commit_id"), F.when(n % 3 == 0, "roof").when(n % 3 == 1, "wall").otherwise("beam").alias("category"))
    commits = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "READY").otherwise("PENDING").alias("status"))
    return RC.extractable(commits, requests).select("commit_id", "category", "refused")


@query("""
WITH s AS (SELECT event_id AS id, user_id AS project_id, ts AS started_at, CASE WHEN event_id % 3 = 0 THEN ts END AS ended_at, 'n' || event_id AS notes FROM events)
SELECT id, project_id, CASE WHEN ended_at IS NULL AND id % 5 = 0 THEN notes || chr(10) || 'closed' ELSE notes END AS notes, ended_at IS NOT NULL OR id % 5 = 0 AS is_over FROM s
""")
def session_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    sessions = table(spark, sf_dir, "events").select(i.alias("id"), F.col("user_id").alias("project_id"), F.col("ts").alias("started_at"), F.when(i % 3 == 0, F.col("ts")).alias("ended_at"), F.concat(F.lit("n"), i.cast("string")).alias("notes"))
    ends = table(spark, sf_dir, "events").filter(i % 5 == 0).select(i.alias("id"), F.col("ts").alias("ended_at"), F.lit("closed").alias("notes"))
    return RC.sessions_ended(sessions, ends).select("id", "project_id", "notes", F.col("ended_at").isNotNull().alias("is_over"))


@query("""
SELECT event_id AS id, ts AS started_at FROM events WHERE user_id = 3 AND event_id % 3 <> 0 ORDER BY ts DESC, event_id DESC
""")
def project_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    sessions = table(spark, sf_dir, "events").select(i.alias("id"), F.col("user_id").alias("project_id"), F.col("ts").alias("started_at"), F.when(i % 3 == 0, F.col("ts")).alias("ended_at"))
    return RC.listed_sessions(sessions, 3, active_only=True).select("id", "started_at")


PLACED = f"SELECT l_suppkey AS commit_id, CASE WHEN k IN (2, 11, 12, 14, 17, 19) THEN 100.0 + l_orderkey % 300 ELSE CAST(l_orderkey % 30000 AS DOUBLE) END AS x, k FROM ({TITLES}) WHERE k NOT IN (2, 11, 12, 14, 17, 19) OR l_suppkey % 3 > 0"


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, left = F.col("l_orderkey"), F.col("k").isin(2, 11, 12, 14, 17, 19)
    x = F.when(left, (o % 300 + 100).cast("double")).otherwise((o % 30000).cast("double"))
    return titles(spark, sf_dir).filter(~left | (F.col("l_suppkey") % 3 > 0)).select(F.col("l_suppkey").alias("commit_id"), x.alias("x"), "text")


def _splits(df: DataFrame) -> DataFrame:
    c = F.col("commit_id")
    return df.select("commit_id").distinct().select("commit_id", (c % 5 * 4000 + 500).cast("double").alias("boundary"), F.when(c % 2 == 0, "left_ratio").otherwise("x_gap").alias("mode"))


@query(f"""
WITH d AS ({PLACED}), s AS (SELECT DISTINCT commit_id, CAST(commit_id % 5 * 4000 + 500 AS DOUBLE) AS b, CASE WHEN commit_id % 2 = 0 THEN 'left_ratio' ELSE 'x_gap' END AS m FROM d),
g AS (SELECT commit_id, any_value(b) AS b, any_value(m) AS m, count(*) AS n, min(x) AS x0, max(x) AS x1, list(x ORDER BY x) FILTER (x <= b AND k IN (2, 11, 12, 14, 17, 19)) AS t, median(x) FILTER (x <= b AND k IN (2, 3, 6, 7, 8, 9, 11, 12, 13, 14, 16, 17, 18, 19)) AS med, count(*) FILTER (x <= b AND k IN (2, 3, 6, 7, 8, 9, 11, 12, 13, 14, 16, 17, 18, 19)) AS shorts FROM d JOIN s USING (commit_id) GROUP BY 1),
e AS (SELECT *, CASE WHEN len(t) >= 5 THEN t[CAST(round_even(0.1 * (len(t) - 1), 0) AS INT) + 1] ELSE t[1] END AS lo, CASE WHEN len(t) >= 5 THEN t[CAST(round_even(0.9 * (len(t) - 1), 0) AS INT) + 1] ELSE t[len(t)] END AS hi, x1 - x0 AS span FROM g),
c AS (SELECT *, CASE WHEN span >= 250 AND len(t) >= 1 AND hi - lo <= least(span * 0.45, greatest(b - x0, span * 0.02, 400) * 1.05, 12000) THEN hi + greatest(70, least(span * 0.024, 560)) END AS one, CASE WHEN shorts >= 5 THEN med + greatest(85, least(span * 0.028, 520)) END AS two FROM e),
n AS (SELECT c.commit_id, any_value(c.n) AS n, any_value(b) AS b, any_value(m) AS m, any_value(CASE WHEN one < b - 0.5 THEN one END) AS one, any_value(CASE WHEN two < b - 0.5 THEN two END) AS two, count(*) FILTER (x <= one AND one < b - 0.5) AS l1, count(*) FILTER (x <= two AND two < b - 0.5) AS l2 FROM c JOIN d USING (commit_id) GROUP BY 1),
f AS (SELECT *, one IS NOT NULL AND l1 >= 1 AND n - l1 >= greatest(4, n // 24) AS a, two IS NOT NULL AND l2 >= 1 AND n - l2 >= greatest(4, n // 24) AND m = 'left_ratio' AS z FROM n)
SELECT commit_id, round(CASE WHEN a THEN one WHEN z THEN two ELSE b END, 6) AS boundary, CASE WHEN a THEN m || '|hdr_cluster' WHEN z THEN m || '|hdr_med_fallback' ELSE m END AS mode FROM f
""")
def tight_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _placed(spark, sf_dir)
    return L.tight_boundaries(own, _splits(own)).withColumn("boundary", F.round("boundary", 6))


@query(f"""
WITH d AS ({PLACED}), g AS (SELECT commit_id, CAST(commit_id % 5 * 4000 + 500 AS DOUBLE) AS b, count(*) AS n, min(x) AS x0, max(x) AS x1, count(*) FILTER (x <= commit_id % 5 * 4000 + 500) AS m, min(x) FILTER (x <= commit_id % 5 * 4000 + 500) AS l0, max(x) FILTER (x <= commit_id % 5 * 4000 + 500) AS l1 FROM d GROUP BY 1)
SELECT commit_id, n >= 10 AND m > 0 AND x1 - x0 >= 400 AND (l1 - l0 > (x1 - x0) * 0.3 OR l1 > x0 + (x1 - x0) * 0.33 OR (b - x0) / (x1 - x0) > 0.36 OR m > n * 0.45) AS is_bad FROM g
""")
def bad_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _placed(spark, sf_dir)
    return L.bad_splits(own, _splits(own))


@query("""
WITH t AS (SELECT c_custkey AS id, c_name AS email FROM customer), r AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'Customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') WHEN s_suppkey % 3 = 0 THEN 'same' ELSE s_name END AS email FROM supplier),
f AS (SELECT *, row_number() OVER (PARTITION BY email ORDER BY id) AS n FROM r), ok AS (SELECT * FROM f WHERE n = 1 AND email NOT IN (SELECT email FROM t))
SELECT id, email FROM t UNION ALL SELECT (SELECT max(id) FROM t) + row_number() OVER (ORDER BY id), email FROM ok
""")
def users_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("email"))
    email = F.when(s % 2 == 0, F.concat(F.lit("Customer#"), F.lpad(s.cast("string"), 9, "0"))).when(s % 3 == 0, "same").otherwise(F.col("s_name"))
    added, _ = RC.added(users, table(spark, sf_dir, "supplier").select(s.alias("id"), email.alias("email")), "email")
    return added


@query("""
SELECT 'f' || l_suppkey AS path, kind, count(*) AS n FROM (SELECT l_suppkey, CASE WHEN l_linenumber IN (1, 2) THEN 'TEXT' WHEN l_linenumber = 3 THEN 'LINE' WHEN l_linenumber = 4 AND l_partkey % 2 = 0 THEN 'BLOCK' END AS kind FROM lineitem) WHERE kind IS NOT NULL GROUP BY 1, 2
""")
def scan_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    kind = F.when(n <= 3, "entity").when(n == 4, "block").otherwise("insert")
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("f"), F.col("l_suppkey").cast("string")).alias("path"), kind.alias("row_kind"), F.when(n <= 2, "TEXT").otherwise("LINE").alias("entity_type"), F.when(p % 2 == 0, "B1").otherwise("*U1").alias("block_name"))
    return store.statistics(rows)


@query("""
SELECT l_suppkey AS commit_id, CAST(l_partkey % 40 AS BIGINT) AS insert_id, 'T' || l_linenumber AS tag, CAST(l_orderkey AS VARCHAR) AS value FROM lineitem WHERE l_linenumber > 2 AND (l_suppkey, l_partkey % 40) IN (SELECT l_suppkey, l_partkey % 40 FROM lineitem WHERE l_linenumber = 1)
""")
def insert_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, key = F.col("l_linenumber"), (F.col("l_partkey") % 40).cast("long")
    kind = F.when(n == 1, "insert").when(n == 2, "entity").otherwise("attribute")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("c"), kind.alias("row_kind"), key.alias("insert_key"), F.concat(F.lit("T"), n.cast("string")).alias("tag"), F.col("l_orderkey").cast("string").alias("value"))
    inserts = rows.filter("row_kind = 'insert'").select(F.col("c").alias("commit_id"), F.col("insert_key").alias("id"))
    return store.attributes_of(rows, inserts, F.col("c"))
