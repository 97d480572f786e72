"""Queries of the one-dimensional clusterings and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plinth.functions import numbers as N
from plinth.operators import beams, clusters as C, columns, layout, schedules
from plinth.plans import views as V
from plinth.plans.catalog import query
from plinth.session import table

LEADERS = f"""
RECURSIVE d AS ({V.TEXTS}), o AS (SELECT *, row_number() OVER (PARTITION BY commit_id ORDER BY -y, x, id, text) AS rn FROM d),
r AS (SELECT commit_id, rn, y AS y0, 0 AS g FROM o WHERE rn = 1
    UNION ALL SELECT o.commit_id, o.rn, CASE WHEN abs(o.y - r.y0) > 2.5 THEN o.y ELSE r.y0 END, CASE WHEN abs(o.y - r.y0) > 2.5 THEN r.g + 1 ELSE r.g END FROM r JOIN o ON o.commit_id = r.commit_id AND o.rn = r.rn + 1),
rows_ AS (SELECT o.*, CAST(r.g AS INT) AS row_index FROM o JOIN r USING (commit_id, rn))
"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.leader_rows(V.texts(spark, sf_dir), "commit_id", -F.col("y"), [F.col("x"), F.col("id"), F.col("text")], 2.5)


@query(f"WITH {LEADERS} SELECT commit_id, id, x, y, text, row_index FROM rows_")
def leader_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("commit_id", "id", "x", "y", "text", "row_index")


@query(f"""
WITH {LEADERS} SELECT commit_id, row_index, string_agg(CAST(id AS VARCHAR), ',' ORDER BY x, id, text) AS ids, string_agg(text, '|' ORDER BY x, id, text) AS cells, round_even(avg(y), 4) AS y_mean, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy,
    count(*) AS non_empty_text_count, false AS empty_only FROM rows_ GROUP BY 1, 2
""")
def row_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.row_summaries(_rows(spark, sf_dir))
    return out.withColumn("ids", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")).withColumn("cells", F.array_join("cells", "|"))


CHAIN = f"""
WITH d AS ({V.TEXTS}), g AS (SELECT *, x - lag(x) OVER w AS gap FROM d WINDOW w AS (PARTITION BY commit_id ORDER BY x, id, text, y)),
s AS (SELECT *, CAST(sum(CASE WHEN gap > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY commit_id ORDER BY x, id, text, y ROWS UNBOUNDED PRECEDING) AS INT) AS strip FROM g)
"""


@query(f"{CHAIN} SELECT commit_id, strip, count(*) AS n, min(x) AS lo, max(x) AS hi FROM s GROUP BY 1, 2")
def x_gap_strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    strips = C.chains(V.texts(spark, sf_dir), ["commit_id"], F.col("x"), [F.col("id"), F.col("text"), F.col("y")], 60.0, "strip")
    return strips.groupBy("commit_id", "strip").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))


@query(f"""
WITH d AS ({V.TEXTS}), g AS (SELECT *, -y - lag(-y) OVER w AS gap FROM d WINDOW w AS (PARTITION BY commit_id ORDER BY -y, x, id, text)),
s AS (SELECT *, CAST(sum(CASE WHEN gap > 4 THEN 1 ELSE 0 END) OVER (PARTITION BY commit_id ORDER BY -y, x, id, text ROWS UNBOUNDED PRECEDING) AS INT) AS band FROM g)
SELECT commit_id, band, count(*) AS n, max(y) AS top, string_agg(text, ' ' ORDER BY x, id, text) AS text FROM s GROUP BY 1, 2
""")
def y_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = C.chains(V.texts(spark, sf_dir), ["commit_id"], -F.col("y"), [F.col("x"), F.col("id"), F.col("text")], 4.0, "band")
    items = F.transform(F.array_sort(F.collect_list(F.struct("x", "id", "text"))), lambda i: i["text"])
    return bands.groupBy("commit_id", "band").agg(F.count("*").alias("n"), F.max("y").alias("top"), F.array_join(items, " ").alias("text"))


EVENT = "PARTITION BY commit_id ORDER BY id"


@query(f"WITH d AS ({V.POINTS}) SELECT commit_id, id, CAST(sum(CASE WHEN entity_type = 'click' THEN 1 ELSE 0 END) OVER ({EVENT} ROWS UNBOUNDED PRECEDING) AS INT) AS segment FROM d")
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.segments(V.points(spark, sf_dir), ["commit_id"], [F.col("id")], F.col("entity_type") == "click", "segment").select("commit_id", "id", "segment")


@query(f"""
WITH d AS ({V.POINTS}), m AS (SELECT *, CASE WHEN id % 3 = 0 THEN entity_type END AS mark FROM d) SELECT commit_id, id, last_value(mark IGNORE NULLS) OVER ({EVENT} ROWS UNBOUNDED PRECEDING) AS mark FROM m
""")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = V.points(spark, sf_dir).withColumn("some", F.when(F.col("id") % 3 == 0, F.col("entity_type")))
    return C.carried(marked, ["commit_id"], [F.col("id")], "some", "mark").select("commit_id", "id", "mark")


@query(f"""
WITH d AS ({V.POINTS}), m AS (SELECT *, CASE WHEN entity_type IS DISTINCT FROM lag(entity_type) OVER ({EVENT}) OR row_number() OVER ({EVENT}) = 1 THEN 1 ELSE 0 END AS c FROM d)
SELECT commit_id, id, CAST(sum(c) OVER ({EVENT} ROWS UNBOUNDED PRECEDING) AS INT) AS run FROM m
""")
def mark_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.runs(V.points(spark, sf_dir), ["commit_id"], [F.col("id")], "entity_type", "run").select("commit_id", "id", "run")


@query(f"""
WITH d AS ({V.POINTS}), l AS (SELECT commit_id, list(x ORDER BY x) AS v FROM d GROUP BY 1)
SELECT commit_id, list_median(v) AS median, v[len(v) // 2 + 1] AS upper_median, v[CAST(round_even(0.9 * (len(v) - 1), 0) AS INT) + 1] AS p90, v[len(v) * 3 // 4 + 1] AS upper_quartile FROM l
""".replace("list_median(v)", "list_aggregate(v, 'median')"))
def medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = V.points(spark, sf_dir).groupBy("commit_id").agg(F.collect_list("x").alias("v"))
    v = F.col("v")
    return values.select("commit_id", N.median(v).alias("median"), N.upper_median(v).alias("upper_median"), N.nearest_rank(v, 0.9).alias("p90"), N.upper_quartile(v).alias("upper_quartile"))


@query(f"""
WITH d AS ({V.POINTS}), u AS (SELECT DISTINCT commit_id, round_even(x, 4) AS x FROM d), g AS (SELECT commit_id, x - lag(x) OVER (PARTITION BY commit_id ORDER BY x) AS gap FROM u)
SELECT commit_id, coalesce(round(median(gap), 6), 0.0) AS median_gap FROM g GROUP BY 1
""")
def median_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.points(spark, sf_dir).groupBy("commit_id").agg(F.round(N.median_gap(F.collect_list("x")), 6).alias("median_gap"))


@query(f"""
WITH RECURSIVE d AS ({V.POINTS}), o AS (SELECT commit_id, x, row_number() OVER (PARTITION BY commit_id ORDER BY x, id) AS rn FROM d),
r AS (SELECT commit_id, rn, x AS f, 1 AS n FROM o WHERE rn = 1 UNION ALL SELECT o.commit_id, o.rn, CASE WHEN x - f > 10 THEN x ELSE f END, CASE WHEN x - f > 10 THEN n + 1 ELSE n END FROM r JOIN o ON o.commit_id = r.commit_id AND o.rn = r.rn + 1)
SELECT commit_id, CAST(max(n) AS INT) AS levels FROM r GROUP BY 1
""")
def level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.points(spark, sf_dir).groupBy("commit_id").agg(N.level_count(F.collect_list("x"), 10.0).alias("levels"))


HEADER = r"(부호|형태|단면|주근|대근|스트럽|스터럽|간격|비고|도\s*[\d@×x]|\bH\b|\s[x×]\s)"
#: Each drawing's texts, of which those of line number 7 are a header's.
TITLED = LEADERS.replace(f"d AS ({V.TEXTS})", f"d AS (SELECT * REPLACE (CASE WHEN id % 10 = 7 THEN '주근 ' || text ELSE text END AS text) FROM ({V.TEXTS}))")


@query(f"""
WITH {TITLED} SELECT commit_id, row_index, string_agg(text, '|' ORDER BY x, id, text) AS cells, CAST(arg_max(regexp_extract(text, 'D(\\d+)', 1), (x, id, text)) AS INT) AS rebar_d, CAST(arg_max(regexp_extract(text, '@(\\d+)', 1), (x, id, text)) AS INT) AS spacing,
    CASE WHEN count(*) >= 2 AND regexp_matches(string_agg(text, ' ' ORDER BY x, id, text), '{HEADER}', 'i') THEN 'header_like' WHEN count(*) = 1 AND NOT regexp_matches(any_value(text), '\\d{{4,}}') AND length(any_value(text)) <= 48 THEN 'section_like' ELSE 'data' END AS role FROM rows_ GROUP BY 1, 2
""")
def wall_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    titled = F.when(F.col("id") % 10 == 7, F.concat(F.lit("주근 "), "text")).otherwise(F.col("text"))
    return schedules.row_table(V.texts(spark, sf_dir).withColumn("text", titled), "wall").select("commit_id", "row_index", F.array_join("cells", "|").alias("cells"), "rebar_d", "spacing", "role")


KIND_OF = {1: "부호", 2: "주근", 3: "형태", 4: "대근(중앙)"}


@query("""
WITH r AS (SELECT l_suppkey, l_linenumber AS k, 'C' || CAST(l_partkey AS VARCHAR) AS c, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_partkey, l_orderkey, l_extendedprice) - 1 AS j FROM lineitem)
SELECT l_suppkey AS commit_id, CAST(j AS INT) AS "column", max(c) FILTER (k = 1) AS mark, coalesce(max(c) FILTER (k = 2), '') AS bars, coalesce(max(c) FILTER (k = 3), '') AS shape, coalesce(max(c) FILTER (k = 4), '') AS hoop
FROM r GROUP BY 1, 2 HAVING max(c) FILTER (k = 1) IS NOT NULL
""")
def column_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_linenumber")
    own = table(spark, sf_dir, "lineitem")
    order = F.struct("l_partkey", "l_orderkey", "l_extendedprice")
    rows = own.groupBy("l_suppkey", k.alias("k")).agg(F.array_sort(F.collect_list(order)).alias("parts"))
    label = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in KIND_OF.items() for x in kv)), F.col("k")), F.lit("etc."))
    cells = F.concat(F.array(label), F.transform("parts", lambda p: F.concat(F.lit("C"), p["l_partkey"].cast("string"))))
    out = schedules.column_pivot(rows.select(F.col("l_suppkey").alias("commit_id"), (-F.col("k")).cast("double").alias("y_mean"), cells.alias("cells")))
    return out.select("commit_id", "column", "mark", F.col("주근").alias("bars"), F.col("형태").alias("shape"), F.col("대근_중앙").alias("hoop"))


@query()
def beam_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return beams.beam_schedule(V.texts(spark, sf_dir))


@query()
def column_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.column_schedule(V.texts(spark, sf_dir))


@query()
def member_strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.strip_table(V.texts(spark, sf_dir))
