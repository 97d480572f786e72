"""Queries of readings: members' names, titles of rows, bars and depths, pens, fingerprints, shapes and their WKT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plinth.functions import colors, fingerprints as FP, geometry as G, members as M, numbers as N, patterns as P, signals as S
from plinth.operators import records as RC
from plinth.plans.catalog import query
from plinth.session import spread, table

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
COLS = ", ".join(KEYS)


def _t(c: Column) -> Column:
    return c.cast("string")


#: Texts of a sheet of beams, 20 kinds of them, with numbers from the line item: what each says is known from its kind.
TITLES = f"""
SELECT {COLS}, CAST(l_partkey % 20 AS INT) AS k, CASE l_partkey % 20
    WHEN 0 THEN l_linenumber || '-D' || (l_suppkey % 32) WHEN 1 THEN 'RG' || (l_partkey % 40) || ' (' || (l_suppkey * 37 % 9000) || 'x' || (l_orderkey % 9999) || ')'
    WHEN 2 THEN '주 근' WHEN 3 THEN 'MAIN BAR' WHEN 4 THEN 'END (INT.)' WHEN 5 THEN 'CENTER' WHEN 6 THEN 'SECTION' WHEN 7 THEN CAST(l_orderkey % 5000 AS VARCHAR)
    WHEN 8 THEN '보 일람표-' || l_linenumber WHEN 9 THEN '(1) 콘크리트' WHEN 10 THEN 'fck = ' || l_suppkey || 'MPa' WHEN 11 THEN '상부근' WHEN 12 THEN 'TOP BAR' WHEN 13 THEN 'width'
    WHEN 14 THEN '형 태' WHEN 15 THEN '-' || l_linenumber || ' C' || (l_suppkey % 9) WHEN 16 THEN 'RC' WHEN 17 THEN ' Name ' WHEN 18 THEN 'G' || l_linenumber || '-INT' ELSE '기호' END AS text
FROM lineitem
"""


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, n, p, s = (F.col(c) for c in KEYS)
    k = p % 20
    named = {2: "주 근", 3: "MAIN BAR", 4: "END (INT.)", 5: "CENTER", 6: "SECTION", 9: "(1) 콘크리트", 11: "상부근", 12: "TOP BAR", 13: "width", 14: "형 태", 16: "RC", 17: " Name ", 19: "기호"}
    made = {
        0: F.concat(_t(n), F.lit("-D"), _t(s % 32)), 1: F.concat(F.lit("RG"), _t(p % 40), F.lit(" ("), _t(s * 37 % 9000), F.lit("x"), _t(o % 9999), F.lit(")")), 7: _t(o % 5000),
        8: F.concat(F.lit("보 일람표-"), _t(n)), 10: F.concat(F.lit("fck = "), _t(s), F.lit("MPa")), 15: F.concat(F.lit("-"), _t(n), F.lit(" C"), _t(s % 9)), 18: F.concat(F.lit("G"), _t(n), F.lit("-INT")),
    }
    text = F.lit(None).cast("string")
    for i, c in (made | {i: F.lit(t) for i, t in named.items()}).items():
        text = F.when(k == i, c).otherwise(text)
    return spread(table(spark, sf_dir, "lineitem").select(*KEYS, k.cast("int").alias("k"), text.alias("text")))


@query(f"""
WITH d AS ({TITLES}) SELECT {COLS}, text, k IN (2, 3) AS main_bar, k IN (6, 14) AS section, k IN (9, 10) AS strength, k IN (4, 5) AS zone, k IN (2, 14, 19) AS loose, k IN (2, 11, 12, 14, 17) AS row_title, k IN (2, 3, 6, 11, 12, 14, 17) AS tight,
    k IN (2, 14, 19) AS anchor, k = 8 AS sheet_title, k IN (6, 14) AS section_anchor FROM d
""")
def title_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, none = F.col("text"), F.lit(None).cast("string")
    tests = {"main_bar": M.is_main_bar_title(c), "section": M.is_section_title(c), "strength": M.is_strength_title(c, none), "zone": M.is_zone_title(c), "loose": M.is_loose_title(c), "row_title": M.is_row_title(c), "tight": M.is_tight_title(c), "anchor": M.is_anchor_title(c), "sheet_title": M.is_sheet_title(c), "section_anchor": M.is_section_anchor(c, none)}
    return titles(spark, sf_dir).select(*KEYS, "text", *(x.alias(n) for n, x in tests.items()))


@query(f"""
WITH d AS ({TITLES}), s AS (SELECT *, l_suppkey * 37 % 9000 AS w, l_orderkey % 9999 AS h, 'RG' || (l_partkey % 40) AS mark FROM d)
SELECT {COLS}, text, CASE WHEN k = 0 THEN l_linenumber END AS bars, CASE WHEN k = 0 THEN CAST(l_suppkey % 32 AS INT) END AS diameter, CASE WHEN k = 1 AND w >= 10 AND h BETWEEN 180 AND 9000 THEN CAST(h AS INT) END AS depth,
    k IN (1, 2, 3, 6, 8, 9, 10, 11, 12, 14, 15, 18, 19) AS title,
    lower(replace(replace(text, ' ', ''), chr(12288), '')) AS key, upper(CASE WHEN k = 1 AND w BETWEEN 200 AND 4000 AND h BETWEEN 200 AND 4000 THEN mark ELSE trim(text) END) AS merged,
    CASE WHEN k = 7 AND length(text) BETWEEN 2 AND 4 AND CAST(text AS INT) BETWEEN 100 AND 4000 THEN CAST(text AS INT) END AS mm FROM s
""")
def member_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, none = F.col("text"), F.array().cast("array<string>")
    bars = M.main_bars(c)
    return titles(spark, sf_dir).select(
        *KEYS, "text", bars["n"].alias("bars"), bars["d"].alias("diameter"), M.depth_hint(F.lit(None).cast("int"), [c], none).alias("depth"), M.is_member_title(c).alias("title"),
        M.member_key(c).alias("key"), M.merge_key(c, F.lit("x")).alias("merged"), M.section_number(c).alias("mm"),
    )


@query(f"""
SELECT {COLS}, CASE WHEN l_linenumber = 1 THEN '3-D' || (l_suppkey % 30) WHEN l_linenumber = 2 THEN '4-UHD' || (l_partkey % 30) WHEN l_linenumber = 3 THEN '5 - SHD ' || (l_orderkey % 30) END AS bars,
    CASE WHEN l_partkey % 400 >= 180 THEN CAST(l_partkey % 400 AS INT) WHEN l_suppkey * 13 % 900 BETWEEN 180 AND 9000 THEN CAST(l_suppkey * 13 % 900 AS INT) WHEN l_orderkey % 700 BETWEEN 180 AND 9000 THEN CAST(l_orderkey % 700 AS INT) END AS depth,
    'B_K' || l_linenumber || '@' || greatest(l_suppkey % 3, 1) || CASE WHEN l_linenumber <> 4 THEN '[r' || (l_suppkey % 7) || 'c' || l_linenumber || ']' ELSE '' END AS instance,
    CASE l_linenumber WHEN 1 THEN '1' WHEN 2 THEN CAST(l_suppkey AS VARCHAR) WHEN 3 THEN NULL WHEN 4 THEN 'k' || l_suppkey ELSE '0' END AS link, l_linenumber IN (1, 2, 3) OR l_partkey % 2 = 0 AS from_table
FROM lineitem
""")
def record_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, n, p, s = (F.col(c) for c in KEYS)
    fields = {"cen_top_bar": F.when(n == 2, F.concat(F.lit("4-UHD"), _t(p % 30))), "MAIN_BAR": F.when(n == 1, F.concat(F.lit("3-D"), _t(s % 30))).otherwise("see note"), "top_bar": F.when(n == 3, F.concat(F.lit(" 5 - SHD "), _t(o % 30)))}
    depth = M.depth_hint((p % 400).cast("int"), [F.lit("none"), F.concat(F.lit("RG1 (300 x"), _t(s * 13 % 900), F.lit(")"))], F.array(F.lit("x"), F.concat(F.lit("G(20*"), _t(o % 700), F.lit(")"))))
    raw = F.when(n == 1, "true").when(n == 2, F.concat(F.lit(" "), _t(s))).when(n == 3, " ").when(n == 4, F.concat(F.lit("k"), _t(s))).otherwise("false")
    layout = F.when(n == 1, "vertical_blocks_x").when(n == 2, "flat").otherwise("other")
    role = F.when(n == 3, "beam_flat").otherwise("none")
    instance = M.instance_key(F.concat(F.lit("B K"), _t(n)), s % 3, F.when(n != 4, s % 7), n)
    strips = F.when(p % 2 == 0, F.array(F.lit(1)))
    return table(spark, sf_dir, "lineitem").select(*KEYS, M.main_bar_text(fields).alias("bars"), depth.alias("depth"), instance.alias("instance"), M.insert_link(raw).alias("link"), M.is_table_record(layout, role, strips).alias("from_table"))


@query(f"""
WITH d AS (SELECT {COLS}, 'C' || l_linenumber || ' ' || (l_partkey % 6000) AS a, l_suppkey % 9 AS f FROM lineitem), m AS (SELECT *, l_partkey % 6000 AS n FROM d)
SELECT {COLS}, CASE WHEN n BETWEEN 200 AND 4000 THEN 'C' || l_linenumber ELSE a END AS body, CASE WHEN n BETWEEN 200 AND 4000 THEN CAST(n AS INT) END AS mm, CASE WHEN f = 0 THEN '~' || l_linenumber ELSE f || '~' || l_linenumber END AS label FROM m
""")
def story_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, p, f = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey") % 9
    body, mm = S.without_dimension(F.concat(F.lit("C"), _t(n), F.lit(" "), _t(p % 6000)))
    label = S.story_label(F.array(F.when(f == 0, "~").otherwise(_t(f)), _t(n)))
    return table(spark, sf_dir, "lineitem").select(*KEYS, body.alias("body"), mm.alias("mm"), label.alias("label"))


WORDS = ["INT.", "Interior Span", "내부", "CENTER", "mid-span", "중앙부", "EXT", "외부", "END", "both", "ALL", "전체", "x", "", "양단부", "C-1", "all zones"]
ZONES = ["int", "int", "int", "cen", "cen", "cen", "ext", "ext", "ext", "_both", "_all", "_all", None, None, "_both", "cen", "_all"]


@query(f"""
WITH t(k, label, zone) AS (VALUES {", ".join(f"({i}, '{w}', {z and f"'{z}'" or 'NULL'})" for i, (w, z) in enumerate(zip(WORDS, ZONES)))})
SELECT event_id, label, zone, lower(replace(replace(replace(replace(label, ' ', ''), '-', ''), '.', ''), '_', '')) AS compact FROM events JOIN t ON event_id % {len(WORDS)} = k
""")
def location_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.element_at(F.array(*map(F.lit, WORDS)), (F.col("event_id") % len(WORDS) + 1).cast("int"))
    out = table(spark, sf_dir, "events").select("event_id", label.alias("label"))
    return out.select("event_id", "label", S.location_zone(F.col("label")).alias("zone"), S.compact(F.col("label")).alias("compact"))


@query(f"""
WITH d AS (SELECT {COLS}, l_orderkey % 7000 AS n FROM lineitem)
SELECT {COLS}, CASE WHEN length(CAST(n AS VARCHAR)) >= 2 AND n BETWEEN 100 AND 5000 THEN CAST(n AS INT) END AS mm, length(CAST(n AS VARCHAR)) IN (3, 4) AND n BETWEEN 200 AND 4000 AS lone,
    'a_b_' || n || '__' || l_linenumber AS slug, CASE WHEN n > 0 THEN CAST(n AS DOUBLE) END AS positive, CASE WHEN l_linenumber = 1 THEN 0.0 ELSE CAST(n AS DOUBLE) END AS finite FROM d
""")
def number_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("l_orderkey") % 7000, F.col("l_linenumber")
    text = F.concat(F.lit("d="), _t(n), F.lit(" mm"))
    wild = F.when(k == 1, F.lit(float("nan"))).otherwise(n.cast("double"))
    return table(spark, sf_dir, "lineitem").select(*KEYS, S.millimetres(text).alias("mm"), S.is_lone_dimension(F.concat(_t(n), F.lit(" MM"))).alias("lone"), S.slug(F.concat(F.lit(" a b-"), _t(n), F.lit("!")), k).alias("slug"), S.positive(_t(n)).alias("positive"), N.finite(wild).alias("finite"))


@query(f"""
SELECT {COLS}, CASE l_linenumber WHEN 1 THEN 'unknown' WHEN 2 THEN 'mixed_or_labeled' WHEN 3 THEN 'inline' WHEN 4 THEN 'mixed_or_labeled' ELSE 'unknown' END AS variant, l_linenumber IN (1, 3, 4) OR l_partkey % 2 = 0 AS useful, l_linenumber = 2 AS unread FROM lineitem
""")
def slab_and_record_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, p, s = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    size = F.concat(_t(s), F.lit("x"), _t(p))
    cells = F.when(n == 1, F.array(_t(s))).when(n == 2, F.array(size, F.lit("Y"))).when(n == 3, F.array(size)).when(n == 4, F.array(F.lit("Y D10"), size)).otherwise(F.array(F.lit("no sizes")))
    none, null = F.lit(""), F.lit(None).cast("int")
    useful = S.is_useful(F.when(n == 1, F.concat(_t(s), F.lit("-D10"))), F.when(n == 3, F.lit("300x400")), F.when(n == 4, "C1"), none, F.when(p % 2 == 0, s.cast("int")), null)
    label = F.when(n == 2, F.concat(F.lit("C~"), _t(s))).when(n == 3, F.concat(_t(s), F.lit("~"), _t(p), F.lit("C1"))).otherwise("C1")
    return table(spark, sf_dir, "lineitem").select(*KEYS, S.slab_variant(cells).alias("variant"), useful.alias("useful"), S.story_error(label, F.lit(None).cast("string"), F.lit(None).cast("array<string>")).alias("unread"))


@query(f"""
SELECT {COLS}, CASE l_linenumber WHEN 1 THEN l_partkey % 300 WHEN 2 THEN 16711680 + l_suppkey % 256 END AS pen, CASE WHEN l_linenumber <> 3 THEN round(greatest(0.55, least(6.5, 0.55 + (l_partkey % 300) / 45.0)), 9) END AS pixels,
    CASE WHEN l_linenumber = 4 THEN NULL WHEN l_linenumber % 2 = 0 THEN nullif(CAST(l_suppkey AS DOUBLE), 0) ELSE l_quantity END AS height FROM lineitem WHERE l_partkey % 300 > 0
UNION ALL SELECT {COLS}, CASE l_linenumber WHEN 2 THEN 16711680 + l_suppkey % 256 END, CASE WHEN l_linenumber <> 3 THEN 0.55 END, CASE WHEN l_linenumber = 4 THEN NULL WHEN l_linenumber % 2 = 0 THEN nullif(CAST(l_suppkey AS DOUBLE), 0) ELSE l_quantity END FROM lineitem WHERE l_partkey % 300 = 0
""")
def pen_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plinth.operators import viewer

    n, p, s = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    value = F.when(n == 1, _t(p % 300)).when(n == 2, F.concat(F.lit("#FF00"), F.lpad(F.hex(s % 256), 2, "0"))).otherwise("by layer")
    kind = F.when(n % 2 == 0, "MTEXT").otherwise("TEXT")
    height = viewer.label_height(kind, F.when(n == 4, -1.0).otherwise(F.col("l_quantity").cast("double")), F.when(n == 4, 0.0).otherwise(s.cast("double")))
    return table(spark, sf_dir, "lineitem").select(*KEYS, colors.value_pen(value).alias("pen"), F.round(colors.line_pixels(F.when(n == 3, -1).otherwise(p % 300)), 9).alias("pixels"), height.alias("height"))


STEP = "CAST(CAST(round_even({}, 0) AS BIGINT) AS VARCHAR)".format
ANGLE = "CAST(CAST(round_even({} / 0.01, 0) AS BIGINT) AS VARCHAR)".format


def _hashed(*parts: str) -> str:
    return f"substring(sha256(concat_ws('|', {', '.join(parts)})), 1, 32)"


@query(f"""
WITH d AS (SELECT *, l_extendedprice AS x, l_quantity * 10 AS y, l_quantity * 7 AS u, l_suppkey * 3.0 AS v FROM lineitem), s AS (SELECT *, {STEP("x")} || ',' || {STEP("y")} AS p, {STEP("u")} || ',' || {STEP("v")} AS q, (round_even(x, 0), round_even(y, 0)) <= (round_even(u, 0), round_even(v, 0)) AS first FROM d)
SELECT {COLS}, {_hashed("'LINE'", "CASE WHEN first THEN p || ';' || q ELSE q || ';' || p END", "l_returnflag", "CAST(l_linenumber AS VARCHAR)")} AS line, {_hashed("'POLYLINE'", "CASE WHEN l_linenumber = 1 THEN 'true' ELSE 'false' END", "p || ';' || q", "l_returnflag", "'0'")} AS polyline,
    {_hashed("'ARC'", "p", STEP("l_quantity"), ANGLE("CAST(l_linenumber AS DOUBLE)"), ANGLE("CAST(l_suppkey AS DOUBLE)"), "l_returnflag", "'3'")} AS arc, {_hashed("'TEXT'", "p", "l_linestatus", "l_returnflag", "'0'")} AS text,
    {_hashed("'INSERT'", "'B' || l_partkey", "p", ANGLE("CAST(l_linenumber AS DOUBLE)"), "'100'", "'-200'", "l_returnflag", "'1'", "'A=' || l_linenumber || ';B=' || l_suppkey")} AS insert FROM s
""")
def fingerprint_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s, layer, q = F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_returnflag"), F.col("l_quantity")
    x, y, u, v = F.col("l_extendedprice"), q * 10, q * 7, s * 3.0
    none = F.lit(None).cast("int")
    attributes = F.array(F.struct(F.lit("B").alias("tag"), _t(s).alias("value")), F.struct(F.lit("A").alias("tag"), _t(n).alias("value")))
    return table(spark, sf_dir, "lineitem").select(
        *KEYS, FP.line(x, y, u, v, layer, n).alias("line"), FP.polyline(F.array(G.point(x, y), G.point(u, v)), n == 1, layer, none).alias("polyline"), FP.arc(x, y, q, n.cast("double"), s.cast("double"), layer, F.lit(3)).alias("arc"),
        FP.text(x, y, F.col("l_linestatus"), layer, none).alias("text"), FP.insert(F.concat(F.lit("B"), _t(F.col("l_partkey"))), x, y, n.cast("double"), F.lit(1.0), F.lit(-2.0), layer, F.lit(1), attributes).alias("insert"),
    )


@query(f"""
WITH d AS (SELECT {COLS}, CAST(l_linenumber AS VARCHAR) AS a, CAST(l_suppkey AS VARCHAR) AS b, CAST(l_partkey AS VARCHAR) AS c FROM lineitem)
SELECT {COLS}, 'LINESTRING (' || a || ' ' || b || ', ' || b || ' ' || c || ')' AS flat, CAST(2 AS INT) AS n, CAST(l_suppkey AS DOUBLE) AS x1, CAST(l_partkey AS DOUBLE) AS y1, 7.5 AS z1, 'LINESTRING' AS kind,
    'POLYGON ((' || a || '.0 0.0, ' || b || '.0 1.0, ' || c || '.0 5.0, ' || a || '.0 0.0))' AS ring, 'POINT (' || a || '.0 ' || b || '.0)' AS point, 'LINESTRING (' || (l_linenumber + 1) || '.0 ' || (l_suppkey * 2) || '.0, ' || (l_suppkey + 1) || '.0 ' || (l_partkey * 2) || '.0)' AS moved,
    l_linenumber <> 3 AS valid FROM d
""")
def wkt_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s, p = F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_partkey")
    raw = F.concat(F.lit("LINESTRING Z ("), _t(n), F.lit(" "), _t(s), F.lit(" 3.5, "), _t(s), F.lit(" "), _t(p), F.lit(" 7.5)"))
    points = F.col("points")
    last = F.element_at(points, -1)
    ring = F.array(G.point(n, F.lit(0)), G.point(s, F.lit(1)), G.point(p, F.lit(5)))
    moved = M.wkt_moved(F.col("raw"), points, lambda q: G.point(q["x"] + 1, q["y"] * 2))
    valid = F.when(n == 3, "CIRCLE (1 1, 3)").otherwise(F.col("raw")).rlike(P.GEOMETRY_PREFIX)
    lines = table(spark, sf_dir, "lineitem").withColumn("raw", raw).withColumn("points", G.wkt_points(F.col("raw")))  # read once
    raw = F.col("raw")
    return lines.select(*KEYS, G.wkt_2d(raw).alias("flat"), F.size(points).alias("n"), last["x"].alias("x1"), last["y"].alias("y1"), last["z"].alias("z1"), M.wkt_kind(raw).alias("kind"), M.polygon_wkt(ring).alias("ring"), M.point_wkt(n.cast("double"), s.cast("double")).alias("point"), moved.alias("moved"), valid.alias("valid"))


@query(f"""
WITH d AS (SELECT {COLS}, CAST(l_quantity AS DOUBLE) AS r, CAST(l_suppkey AS DOUBLE) AS cx, CAST(l_linenumber AS DOUBLE) AS cy FROM lineitem)
SELECT {COLS}, CAST(33 AS INT) AS n, round(cx + r, 6) AS first_x, round(cy + r, 6) AS quarter_y, round(cx, 6) AS circle_x, round(cy, 6) AS circle_y, round(r, 6) AS circle_r,
    round((20 * (cx + 10) + 5 * (cx + 20)) / 25, 6) AS centroid_x, round((20 * cy + 5 * (cy + 2.5)) / 25, 6) AS centroid_y, round(cx, 6) AS ring_x FROM d
""")
def circle_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, cx, cy = F.col("l_quantity").cast("double"), F.col("l_suppkey").cast("double"), F.col("l_linenumber").cast("double")
    # A 33-gon's first vertex stands twice: the mean of all vertices is not the centre, so the copy is left out.
    out = table(spark, sf_dir, "lineitem").select(*KEYS, G.circle_points(cx, cy, r).alias("c"), F.array(G.point(cx, cy), G.point(cx + 20, cy), G.point(cx + 20, cy + 5)).alias("l"), cx.alias("cx"), cy.alias("cy"), r.alias("r"))
    out = out.withColumn("box", G.extent(F.col("c"))).withColumn("mid", G.length_centroid(F.col("l")))  # made once
    box = F.col("box")
    ring = G.closed_ring(F.array(G.point(F.col("cx"), F.col("cy")), G.point(F.col("cx") + 1, F.col("cy")), G.point(F.lit(-1), F.lit(-1))))
    mid = F.col("mid")
    return out.select(
        *KEYS, F.size("c").alias("n"), F.round(F.element_at("c", 1)["x"], 6).alias("first_x"), F.round(F.element_at("c", 9)["y"], 6).alias("quarter_y"), F.round((box["minx"] + box["maxx"]) / 2, 6).alias("circle_x"), F.round((box["miny"] + box["maxy"]) / 2, 6).alias("circle_y"),
        F.round((box["maxx"] - box["minx"]) / 2, 6).alias("circle_r"), F.round(mid["x"], 6).alias("centroid_x"), F.round(mid["y"], 6).alias("centroid_y"), F.round(F.element_at(ring, -1)["x"], 6).alias("ring_x"),
    )


@query(f"""
WITH d AS (SELECT user_id, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value) AS INT) AS i, value - lag(value) OVER (PARTITION BY user_id ORDER BY value) AS gap FROM events),
t AS (SELECT user_id, sum(CASE WHEN gap > 4 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i) AS tier FROM d), n AS (SELECT user_id, tier, count(*) AS n FROM t GROUP BY 1, 2)
SELECT user_id, string_agg(CAST(n AS VARCHAR), ',' ORDER BY tier) AS sizes, 0.25 AS tolerance FROM n GROUP BY 1
""")
def tier_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list("value").alias("v"))
    sizes = F.transform(M.tier_sizes(F.col("v"), 4.0), lambda n: n.cast("string"))
    return values.select("user_id", F.array_join(sizes, ",").alias("sizes"), M.tolerance_of(F.create_map(F.lit("fp_tolerance_mm"), F.lit("0.25"))).alias("tolerance"))


@query("""
SELECT o_orderkey AS id, 'P-' || strftime(o_orderdate, '%Y%m%d') || '-' || upper(substring(sha256(CAST(o_orderkey AS VARCHAR)), 1, 6)) AS code, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS INT) END AS k, CASE WHEN o_orderkey % 3 = 0 AND o_custkey % 2 = 0 THEN 'y' END AS flag FROM orders
""")
def project_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    form = F.when(o % 3 == 0, F.concat(F.lit('{"k": '), _t(c), F.when(c % 2 == 0, ', "f": "y"').otherwise(""), F.lit("}"))).when(o % 3 == 1, " ").otherwise("null")
    out = table(spark, sf_dir, "orders").select(o.alias("id"), RC.project_code("P", F.col("o_orderdate"), o).alias("code"), RC.form_json(form, "k int, f string").alias("j"))
    return out.select("id", "code", "j.k", F.col("j.f").alias("flag"))


@query(f"""
SELECT {COLS}, CASE WHEN l_linenumber % 2 = 0 THEN 'C' || l_partkey ELSE 'note ' || l_suppkey END AS mark, CASE WHEN l_linenumber > 3 THEN repeat('wide section ', 4) || l_suppkey ELSE '' END AS section, l_suppkey || 'x' || l_partkey AS size,
    CASE WHEN l_linenumber = 5 THEN 'fck = ' || l_suppkey || 'MPa' ELSE '' END AS strength, (l_partkey % 9) || '-D' || (l_suppkey % 30) AS main_bar, 'D10 @' || l_suppkey AS mid_hoop, CASE WHEN l_linenumber = 1 THEN 'D10@' || l_partkey ELSE '' END AS end_hoop FROM lineitem
""")
def slot_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, p, s = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    size = F.concat(_t(s), F.lit("x"), _t(p))
    texts = F.array(
        F.lit(" "), F.lit("NAME"), F.when(n % 2 == 0, F.concat(F.lit("C"), _t(p))).otherwise(F.concat(F.lit("note "), _t(s))), size, F.concat(size, F.lit("0")), F.when(n == 5, F.concat(F.lit("fck = "), _t(s), F.lit("MPa"))).otherwise(""),
        F.concat(_t(p % 9), F.lit("-D"), _t(s % 30)), F.lit("9-D99"), F.concat(F.lit("D10 @"), _t(s)), F.when(n == 1, F.concat(F.lit("D10@"), _t(p))).otherwise("x"), F.when(n > 3, F.concat(F.expr("repeat('wide section ', 4)"), _t(s))).otherwise(F.lit(None)),
    )
    return table(spark, sf_dir, "lineitem").select(*KEYS, M.slot_record(texts).alias("r")).select(*KEYS, *(f"r.{x}" for x in M.SLOTS))
