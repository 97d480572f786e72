"""Queries of the readings of drawing texts, and of pens and colours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plinth.functions import colors, fingerprints, signals as S
from plinth.plans import views as V
from plinth.plans.catalog import query
from plinth.session import spread, table


@query(f"""
WITH d AS ({V.TEXTS}) SELECT id, commit_id, x, text, CAST(nullif(regexp_extract(text, '(\\d+)\\s*-\\s*D\\s*(\\d+)', 1), '') AS INT) AS main_bar_bars,
    CAST(nullif(regexp_extract(text, 'D\\s*(\\d+)', 1), '') AS INT) AS rebar_d, CAST(nullif(regexp_extract(text, '@\\s*(\\d+)', 1), '') AS INT) AS spacing,
    CAST(nullif(regexp_extract(text, '(\\d+)\\s*[xX]\\s*(\\d+)', 1), '') AS INT) AS width, CAST(nullif(regexp_extract(text, '(\\d+)\\s*[xX]\\s*(\\d+)', 2), '') AS INT) AS depth FROM d
""")
def text_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.with_signals(spread(V.texts(spark, sf_dir)), "text", "s")
    return out.select("id", "commit_id", "x", "text", "s.main_bar_bars", "s.rebar_d", "s.spacing", F.col("s.size_mm")[0].alias("width"), F.col("s.size_mm")[1].alias("depth"))


NAMES = """
SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 7
    WHEN 0 THEN '-' || CAST(l_partkey % 9 AS VARCHAR) || ' ~ -' || CAST(l_suppkey % 9 AS VARCHAR) || 'C' || CAST(l_partkey % 50 AS VARCHAR) || 'A'
    WHEN 1 THEN '-' || CAST(l_partkey % 9 AS VARCHAR) || ' - -' || CAST(l_suppkey % 9 AS VARCHAR) || ' C' || CAST(l_partkey % 50 AS VARCHAR)
    WHEN 2 THEN '~ -' || CAST(l_partkey % 9 AS VARCHAR) || 'C2' WHEN 3 THEN '-' || CAST(l_partkey % 9 AS VARCHAR) || ' C1' WHEN 4 THEN CAST(l_partkey % 9 AS VARCHAR) || 'C' || CAST(l_suppkey % 9 AS VARCHAR)
    WHEN 5 THEN '-' || CAST(l_partkey % 9 AS VARCHAR) || 'C~-2C1' ELSE 'C' || CAST(l_partkey AS VARCHAR) END AS name
FROM lineitem
"""


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, p, s = F.col("l_linenumber") % 7, F.col("l_partkey"), F.col("l_suppkey")
    t = lambda c: c.cast("string")
    name = (
        F.when(k == 0, F.concat(F.lit("-"), t(p % 9), F.lit(" ~ -"), t(s % 9), F.lit("C"), t(p % 50), F.lit("A")))
        .when(k == 1, F.concat(F.lit("-"), t(p % 9), F.lit(" - -"), t(s % 9), F.lit(" C"), t(p % 50)))
        .when(k == 2, F.concat(F.lit("~ -"), t(p % 9), F.lit("C2")))
        .when(k == 3, F.concat(F.lit("-"), t(p % 9), F.lit(" C1")))
        .when(k == 4, F.concat(t(p % 9), F.lit("C"), t(s % 9)))
        .when(k == 5, F.concat(F.lit("-"), t(p % 9), F.lit("C~-2C1")))
        .otherwise(F.concat(F.lit("C"), t(p)))
    )
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", name.alias("name"))


@query(f"""
WITH d AS ({NAMES}), m AS (SELECT *, regexp_extract(name, '^(-?\\d+) (?:~| - | -) ?(-?\\d+) ?(C.*)$', 0) AS whole FROM d)
SELECT l_orderkey, l_linenumber, l_partkey, name,
    CASE l_linenumber % 7 WHEN 0 THEN replace(regexp_extract(name, '^(-?\\d+ ~ -?\\d+)', 1), ' ', '') WHEN 1 THEN regexp_extract(name, '^(-?\\d+)', 1) || '~' || regexp_extract(name, ' - (-?\\d+)', 1)
        WHEN 2 THEN '~' || regexp_extract(name, '(-\\d+)', 1) WHEN 3 THEN regexp_extract(name, '^(-?\\d+)', 1) WHEN 4 THEN regexp_extract(name, '^(\\d+)', 1) END AS story,
    CASE WHEN l_linenumber % 7 IN (0, 1, 2, 3, 4) THEN regexp_extract(name, '(C\\d+[A-Z]?)$', 1) END AS mark
FROM m
""")
def story_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.with_member(spread(_names(spark, sf_dir)), "name", "s")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "name", "s.story", "s.mark")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_linenumber AS VARCHAR) || '/' || CAST(l_partkey % 20 + 1 AS VARCHAR) || '-D' || CAST(l_suppkey % 32 AS VARCHAR) || ' / 2-SHD22' AS bars FROM lineitem
""")
def rebar_notation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda c: c.cast("string")
    raw = F.concat(t(F.col("l_linenumber")), F.lit("-"), t(F.col("l_partkey") % 20 + 1), F.lit("-D"), t(F.col("l_suppkey") % 32), F.lit(" / 2-SHD22 "))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.two_tiers(raw).alias("bars"))


@query("""
SELECT p_partkey, upper(replace(p_type, ' ', '')) AS plain, upper(replace(p_brand, ' ', '')) AS nested, 'A$' AS cut FROM part
""")
def layer_key_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = F.concat(F.lit("xref$0$A|b/c\\"), F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", S.layer_key(F.col("p_type")).alias("plain"), S.layer_key(nested).alias("nested"), S.layer_key(F.lit(" a $")).alias("cut"))


@query("""
SELECT p_partkey, CASE WHEN p_size * 40 BETWEEN 200 AND 4000 AND p_size * 30 BETWEEN 200 AND 4000 THEN 'RG' || CAST(p_partkey AS VARCHAR) ELSE 'RG' || CAST(p_partkey AS VARCHAR) || ' (' || CAST(p_size * 40 AS VARCHAR) || 'x' || CAST(p_size * 30 AS VARCHAR) || ')' END AS mark,
    CASE WHEN p_size * 40 BETWEEN 200 AND 4000 AND p_size * 30 BETWEEN 200 AND 4000 THEN p_size * 40 END AS width, CASE WHEN p_size * 40 BETWEEN 200 AND 4000 AND p_size * 30 BETWEEN 200 AND 4000 THEN p_size * 30 END AS depth
FROM part
""")
def mark_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda c: c.cast("string")
    raw = F.concat(F.lit("RG"), t(F.col("p_partkey")), F.lit(" ("), t(F.col("p_size") * 40), F.lit("x"), t(F.col("p_size") * 30), F.lit(")"))
    return table(spark, sf_dir, "part").select("p_partkey", S.mark_and_size(raw).alias("m")).select("p_partkey", "m.mark", "m.width", "m.depth")


@query("""
SELECT p_partkey, CAST(p_size AS VARCHAR) || '-UHD19' AS rest, 'fck = ' || CAST(p_size AS VARCHAR) || 'MPa' AS strength FROM part
""")
def strength_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    rest, strength = S.without_strength(F.concat(F.lit("fck = "), size, F.lit("MPa  "), size, F.lit("-UHD19")))
    return table(spark, sf_dir, "part").select("p_partkey", rest.alias("rest"), strength.alias("strength"))


@query(f"""
WITH d AS ({V.TEXTS}) SELECT commit_id, count(*) AS n, CAST(arg_max(regexp_extract(text, 'D(\\d+)', 1), (x, id, text)) AS INT) AS rebar_d, CAST(arg_max(regexp_extract(text, '@(\\d+)', 1), (x, id, text)) AS INT) AS spacing FROM d GROUP BY 1
""")
def signal_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.with_signals(spread(V.texts(spark, sf_dir)), "text", "s")
    items = F.transform(F.sort_array(F.collect_list(F.struct("x", "id", "text", "s"))), lambda i: i["s"])
    out = rows.groupBy("commit_id").agg(F.count("*").alias("n"), S.let(items, S.merged_signals).alias("m"))
    return out.select("commit_id", "n", "m.rebar_d", "m.spacing")


LABELS = ["부 호", "MAIN BAR MAIN BAR", "형태", "대근(중앙)", "101동", "END(INT.)", "양단부", "CENTER", "x", ""]


@query("""
WITH t(k, label, kind, header, block_start, zone) AS (VALUES (0, '부 호', '부호', true, true, NULL), (1, 'MAIN BAR MAIN BAR', 'other', true, false, NULL), (2, '형태', '형태', true, false, NULL), (3, '대근(중앙)', '대근_중앙', true, false, 'cen'),
    (4, '101동', '동_헤더', false, false, NULL), (5, 'END(INT.)', 'other', false, false, 'int'), (6, '양단부', 'other', false, false, 'both'), (7, 'CENTER', 'other', false, false, 'cen'), (8, 'x', 'other', false, false, NULL), (9, '', 'unknown', false, false, NULL))
SELECT event_id, label, kind, header, block_start, zone FROM events JOIN t ON event_id % 10 = k
""")
def label_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.element_at(F.array(*map(F.lit, LABELS)), (F.col("event_id") % 10 + 1).cast("int"))
    out = table(spark, sf_dir, "events").select("event_id", label.alias("label"))
    c = F.col("label")
    return out.select("event_id", "label", S.column_label(c).alias("kind"), S.is_header(c).alias("header"), S.is_block_start(c).alias("block_start"), S.zone_label(c).alias("zone"))


@query("""
WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber WHEN 1 THEN 256 WHEN 2 THEN 0 WHEN 3 THEN NULL ELSE l_linenumber END AS color, CASE WHEN l_linenumber IN (2, 5) THEN CAST(l_suppkey % 3 AS INT) * 100000 END AS raw,
    CASE WHEN l_partkey % 10 = 0 THEN 16744512 END AS true_color, CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'N' THEN 3 END AS layer_pen FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE WHEN true_color > 255 THEN true_color WHEN raw = 256 OR color = 256 THEN coalesce(layer_pen, 7) WHEN raw >= 1 THEN raw WHEN raw = 0 AND color = 0 THEN 0 ELSE coalesce(color, 7) END AS BIGINT) AS pen FROM d
""")
def pen_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, layer = F.col("l_linenumber"), F.col("l_returnflag")
    color = F.when(n == 1, 256).when(n == 2, 0).when(n != 3, n)
    raw = F.when(n.isin(2, 5), (F.col("l_suppkey") % 3).cast("int") * 100000)
    true_color = F.when(F.col("l_partkey") % 10 == 0, 16744512)
    layer_pen = F.when(layer == "A", 1).when(layer == "N", 3)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", colors.entity_pen(color, raw, true_color, layer_pen).alias("pen"))


@query("""
SELECT event_id, CASE WHEN event_id % 300 IN (0, 256) THEN '#e0e0e0' WHEN event_id % 300 > 255 THEN '#' || lpad(lower(to_hex(event_id % 300)), 6, '0') WHEN event_id % 300 = 1 THEN '#ff0000' ELSE '#ffffff' END AS css,
    '#' || lpad(lower(to_hex(event_id * 7919 % 16777216)), 6, '0') AS packed FROM events
""")
def pen_css(spark: SparkSession, sf_dir: str) -> DataFrame:
    palette = F.create_map(F.lit(1), F.lit("#ff0000"), F.lit(7), F.lit("#ffffff"))
    return table(spark, sf_dir, "events").select("event_id", colors.pen_css(F.col("event_id") % 300, palette).alias("css"), colors.packed_css(F.col("event_id") * 7919 % 16777216).alias("packed"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, substring(sha256(concat_ws('|', 'CIRCLE', CAST(CAST(round_even(l_extendedprice, 0) AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(round_even(l_quantity * 10, 0) AS BIGINT) AS VARCHAR),
    CAST(CAST(round_even(l_quantity, 0) AS BIGINT) AS VARCHAR), l_returnflag, CAST(l_linenumber AS VARCHAR))), 1, 32) AS fingerprint FROM lineitem
""")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", fingerprints.circle(F.col("l_extendedprice"), q * 10, q, F.col("l_returnflag"), F.col("l_linenumber")).alias("fingerprint"))
