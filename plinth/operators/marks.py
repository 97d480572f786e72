"""Names of members on a sheet: texts that name one are clustered, and strips of values find theirs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plinth.functions import members as M
from plinth.functions.numbers import median
from plinth.functions.signals import zone_label
from plinth.operators.clusters import chains, components, leader_rows
from plinth.operators.spatial import nearest


def canonical(text: Column) -> Column:
    """The longest of some texts; of equally long ones the last by code points. Blank texts don't count."""
    t = F.trim(text)
    return F.max(F.when(t != "", F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]


def mark_clusters(marks: DataFrame, y_tolerance: float, x_gap: float) -> DataFrame:
    """Marks (commit_id, id, x, y, text) whose y is within the tolerance of their row's least one, and in it those with no
    gap along x over ``x_gap``, are one: (commit_id, x, y, text) with the mean x, the median y and the longest text. Clusters
    of blank texts are none."""
    rows = leader_rows(marks, "commit_id", F.col("y"), [F.col("x"), F.col("id")], y_tolerance, "mark_row")
    runs = chains(rows, ["commit_id", "mark_row"], F.col("x"), [F.col("id")], x_gap, "mark_run")
    out = runs.groupBy("commit_id", "mark_row", "mark_run").agg(F.avg("x").alias("x"), F.percentile("y", F.lit(0.5)).alias("y"), canonical(F.col("text")).alias("text"))
    return out.filter("text is not null").select("commit_id", "x", "y", "text")


def merged_marks(marks: DataFrame, radius: float) -> DataFrame:
    """Marks (commit_id, id, x, y, text) that steps of at most the radius join, as one: mean place and longest text."""
    joined = components(marks.select("commit_id", "id", "x", "y"), radius)
    out = marks.join(joined, ["commit_id", "id"]).groupBy("commit_id", "component").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), canonical(F.col("text")).alias("text"))
    return out.filter("text is not null").select("commit_id", "component", "x", "y", "text")


def nearest_marks(strips: DataFrame, texts: DataFrame, sheets: DataFrame) -> DataFrame:
    """For each strip (commit_id, strip, x_center) the member title nearest to its centre along x, among those (commit_id,
    x, y, text) within their sheet's window (commit_id, y_name, x_lo, x_hi, band); of equally near ones the nearest to y_name,
    then the first by text. Strips of sheets without one have none."""
    own = texts.join(sheets, "commit_id").filter(M.is_member_title(F.col("text")) & F.col("x").between(F.col("x_lo"), F.col("x_hi")) & (F.abs(F.col("y") - F.col("y_name")) <= F.col("band")))
    best = F.min(F.struct(F.abs(F.col("y") - F.col("y_name")).alias("dy"), F.trim("text").alias("text")))
    at = own.groupBy("commit_id", F.col("x").alias("mark_x")).agg(best.alias("b")).select("commit_id", "mark_x", F.col("b.text").alias("mark"), F.col("b.dy").alias("mark_dy"))
    return nearest(strips, at, "commit_id", "x_center", "mark_x", ["mark", "mark_dy"], tie="mark_dy").filter("mark is not null")


def template_places(template: DataFrame) -> DataFrame:
    """Of each sheet's rows (commit_id, y, label, kind) the first named one's y (from the top), and the median y of those
    that name a zone."""
    name = F.max(F.when(F.col("kind") == "name", F.col("y")))
    zone = F.percentile(F.when(zone_label(F.col("label")).isNotNull(), F.col("y")), F.lit(0.5))
    return template.groupBy("commit_id").agg(name.alias("name_y"), zone.alias("zone_y"))


def next_member_y(strips: DataFrame, texts: DataFrame, x_gate: float = 4500.0, gap: float = 55.0) -> DataFrame:
    """(commit_id, strip, next_y): of the titles (commit_id, strip, x, y, text) of another member in a strip (commit_id,
    strip, x_center, cutoff, mark) that stand more than ``gap`` below its cutoff, and within the gate along x, the highest
    one's y. A title that is the strip's mark, or that with up to eight characters more, is no other member."""
    want, own = M.member_key(F.col("mark")), M.member_key(F.col("text"))
    same = (want != "") & ((own == want) | (own.startswith(want) & (F.length(own) <= F.length(want) + 8)))
    met = strips.join(texts.select("commit_id", "strip", "x", "y", "text").filter(M.is_member_title(F.col("text"))), ["commit_id", "strip"])
    met = met.filter((F.abs(F.col("x") - F.col("x_center")) <= x_gate) & (F.col("y") < F.col("cutoff") - gap) & ~F.coalesce(same, F.lit(False)))
    return met.groupBy("commit_id", "strip").agg(F.max("y").alias("next_y"))


def trimmed_left(items: DataFrame, boundary: float, tolerance: float) -> DataFrame:
    """A strip's items (commit_id, strip, x, ...) right of the boundary and a margin; a strip that has none there stays whole."""
    right = F.col("x") > boundary + max(14.0, 2.5 * tolerance)
    some = F.max(right.cast("int")).over(Window.partitionBy("commit_id", "strip"))
    return items.withColumn("_right", right).withColumn("_some", some).filter("_right or _some = 0").drop("_right", "_some")


def zone_spans(rows: DataFrame) -> DataFrame:
    """Of blocks of rows (commit_id, block, position, label) with two rows or more that name a zone, a piece for each:
    ``piece`` counts from 0, and rows before the first zone are part of its piece. Other blocks are one piece. The block's first
    row, which has its mark, stands in every piece."""
    w = Window.partitionBy("commit_id", "block")
    named = zone_label(F.col("label")).isNotNull().cast("int")
    before = F.sum(named).over(w.orderBy("position").rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("zones", F.sum(named).over(w)).withColumn("before", before).withColumn("first", F.row_number().over(w.orderBy("position")) == 1)
    piece = F.when(F.col("zones") >= 2, F.greatest(F.col("before") - 1, F.lit(0))).otherwise(0)
    pieces = F.when(F.col("first") & (F.col("zones") >= 2), F.sequence(F.lit(0), (F.col("zones") - 1).cast("int"))).otherwise(F.array(piece.cast("int")))
    return out.withColumn("piece", F.explode(pieces)).drop("zones", "before", "first")


def _grouped(points: DataFrame, y_tolerance: Column, x_gap: Column) -> DataFrame:
    """W28 with tolerances of their own for each sheet: places are measured in them, so that both are one."""
    scaled = points.withColumn("ty", y_tolerance).withColumn("tx", x_gap).withColumn("y", F.col("y") / F.col("ty")).withColumn("x", F.col("x") / F.col("tx"))
    sizes = scaled.groupBy("commit_id").agg(F.first("ty").alias("ty"), F.first("tx").alias("tx"))
    found = mark_clusters(scaled.select("commit_id", "id", "x", "y", "text"), 1.0, 1.0).join(sizes, "commit_id")
    return found.select("commit_id", (F.col("x") * F.col("tx")).alias("x"), (F.col("y") * F.col("ty")).alias("y"), "text")


def strip_sheets(strips: DataFrame, items: DataFrame, texts: DataFrame, template: DataFrame, band: float) -> DataFrame:
    """The measures of each sheet by which strips find their members: the range along x around its strips, the names' and the
    zones' y, and tolerances that follow the sheet's width and height. Sheets whose template names no member have none."""
    xs = strips.groupBy("commit_id").agg(F.min("x_center").alias("x0"), F.max("x_center").alias("x1"), F.count("*").alias("n_strips"))
    middle = items.groupBy("commit_id").agg(F.percentile("y", F.lit(0.5)).alias("y_ref"))
    pad = F.greatest(F.lit(560.0), (F.col("x1") - F.col("x0")) * 0.24)
    sheet = xs.join(middle, "commit_id").withColumn("x_lo", F.col("x0") - pad).withColumn("x_hi", F.col("x1") + pad)
    rows = template.join(sheet.select("commit_id", "y_ref"), "commit_id")
    nearest_y = lambda when: F.min(F.when(when, F.struct(F.abs(F.col("y") - F.col("y_ref")).alias("d"), "position", "y")))["y"]
    named = rows.groupBy("commit_id").agg(nearest_y(F.col("kind") == "name").alias("y_name"), nearest_y(zone_label(F.col("label")).isNotNull()).alias("y_row"))
    zones = texts.join(sheet.select("commit_id", "x_lo", "x_hi"), "commit_id").filter(zone_label(F.col("text")).isNotNull() & F.col("x").between(F.col("x_lo"), F.col("x_hi")))
    zones = zones.groupBy("commit_id").agg(F.sort_array(F.collect_list("y")).alias("zone_ys"))  # a sheet's zone labels
    out = sheet.join(named.filter("y_name is not null"), "commit_id").join(zones, "commit_id", "left")
    ys = F.coalesce("zone_ys", F.array().cast("array<double>"))
    own = F.coalesce("y_row", F.when(F.size(ys) > 0, median(ys)), "y_ref")
    out = out.withColumn("y_zone", median(F.concat(ys, F.array(own)))).withColumn("span", F.greatest(F.lit(80.0), F.abs(F.col("y_name") - F.col("y_zone"))))
    wide = F.col("x1") - F.col("x0")
    return out.select(
        "commit_id", "n_strips", "x_lo", "x_hi", "y_ref", "y_name", "y_zone", F.lit(max(88.0, 14 * band)).alias("loose"), F.greatest(F.lit(max(128.0, 20 * band)), F.least(F.lit(420.0), wide * 0.09)).alias("x_gap"),
        F.greatest(F.lit(max(24.0, 4.2 * band)), F.least(F.lit(78.0), F.col("span") * 0.055)).alias("y_tolerance"), F.greatest(F.lit(max(20.0, 3.25 * band)), F.least(F.lit(60.0), F.col("span") * 0.048)).alias("merge"),
    )


def strip_members(strips: DataFrame, items: DataFrame, texts: DataFrame, template: DataFrame, band: float = 4.0) -> DataFrame:
    """(commit_id, strip, mark, source): the member of each strip (commit_id, strip, x_center) of each sheet.

    ``items`` (commit_id, y) are the strips' texts, ``texts`` (commit_id, id, x, y, text) all of the sheet's values,
    ``template`` (commit_id, position, y, label, kind) its rows. Titles that stand close are one; those between the rows of
    names and of zones, and those at the row of names, are clustered apart. Which of the two counts is told by how many each
    has against the strips: as many as strips first, then one or three in between with at most one at the names, two or one or
    three at the names, two in between, whatever there is. One title serves all strips; as many as strips are paired from the
    left; of more, each strip from the left takes the nearest that is left; of fewer, the nearest. Without any, the nearest
    title in a wider range does (J10). Strips of sheets that name no member have no row."""
    sheets = strip_sheets(strips, items, texts, template, band)
    titles = texts.join(sheets, "commit_id").filter(M.is_member_title(F.col("text")) & F.col("x").between(F.col("x_lo"), F.col("x_hi")))
    scaled = titles.select("commit_id", "id", (F.col("x") / F.col("merge")).alias("x"), (F.col("y") / F.col("merge")).alias("y"), "text")
    merged = merged_marks(scaled, 1.0).join(sheets, "commit_id").withColumn("x", F.col("x") * F.col("merge")).withColumn("y", F.col("y") * F.col("merge")).withColumnRenamed("component", "id")
    margin = max(4.0, 1.05 * band)
    low, high = F.least("y_zone", "y_name") + margin, F.greatest("y_zone", "y_name") - margin
    inside = (high > low + 12) & (F.col("y") > low) & (F.col("y") < high)
    parts = {"between": merged.filter(inside), "row": merged.filter(~inside & (F.abs(F.col("y") - F.col("y_name")) <= F.col("loose")))}
    found = [_grouped(p, F.col("y_tolerance"), F.col("x_gap")).withColumn("part", F.lit(name)) for name, p in parts.items()]
    ordered = lambda name: F.array_sort(F.collect_list(F.when(F.col("part") == name, F.struct("x", "y", "text"))))
    marks = found[0].unionByName(found[1]).groupBy("commit_id").agg(ordered("between").alias("between"), ordered("row").alias("row"))
    own = strips.groupBy("commit_id").agg(F.array_sort(F.collect_list(F.struct("x_center", "strip"))).alias("strips"))
    sheet = sheets.join(own, "commit_id").join(marks, "commit_id", "left")
    none = F.array().cast("array<struct<x:double,y:double,text:string>>")
    sheet = sheet.withColumn("between", F.coalesce("between", none)).withColumn("row", F.coalesce("row", none))
    nb, nr, ns = F.size("between"), F.size("row"), F.size("strips")
    mid_y = lambda c: median(F.sort_array(F.transform(c, lambda m: m["y"])))
    off_row, off_between = F.abs(mid_y("row") - F.col("y_name")), F.abs(mid_y("between") - (F.col("y_name") + F.col("y_zone")) / 2)
    source = (
        F.when((ns >= 2) & (nb == ns) & (nr == ns), F.when(off_between + max(22.0, 3.2 * band) < off_row, "between_strip_count").otherwise("row_strip_count"))
        .when((ns >= 2) & (nb == ns), "between_strip_count").when((ns >= 2) & (nr == ns), "row_strip_count")
        .when(nb.isin(1, 3) & (nr <= 1), "between_zone_and_name").when((nr == 2) & (nb == 0), "row_two_marks").when(nr.isin(1, 3), "row").when(nb == 2, "between_two_marks")
        .when(nb > 0, "between_fallback").when(nr > 0, "row_fallback")
    )
    sheet = sheet.withColumn("source", source).withColumn("marks", F.when(F.col("source").startswith("between"), F.col("between")).when(F.col("source").isNotNull(), F.col("row")))
    n = F.size("marks")
    one = F.size(F.array_distinct(F.transform("marks", lambda m: M.member_key(m["text"])))) == 1
    near = lambda x, among: F.array_min(F.transform(among, lambda m, i: F.struct(F.abs(m["x"] - x).alias("d"), i.alias("i"))))["i"]
    at = lambda i: F.get("marks", i)["text"]
    middle = lambda s: F.when(F.abs(s["x_center"] - F.get("marks", F.lit(0))["x"]) <= F.abs(s["x_center"] - F.get("marks", F.lit(1))["x"]), at(F.lit(0))).otherwise(at(F.lit(1)))
    plain = F.transform(
        "strips",
        lambda s, j: F.when((n == 1) | ((ns >= 2) & one), at(F.lit(0))).when(n == ns, at(j)).when((n == 2) & (ns == 3), F.when(j == 0, at(F.lit(0))).when(j == 2, at(F.lit(1))).otherwise(middle(s))).otherwise(at(near(s["x_center"], F.col("marks")))),
    )
    start = F.struct(F.col("marks").alias("pool"), F.array().cast("array<string>").alias("taken"))

    def take(state: Column, s: Column) -> Column:
        i = near(s["x_center"], state["pool"])
        rest = F.filter(state["pool"], lambda _, k: k != i)
        return F.struct(rest.alias("pool"), F.concat(state["taken"], F.array(F.get(state["pool"], i)["text"])).alias("taken"))

    greedy = F.aggregate("strips", start, take, lambda state: state["taken"])
    names = F.when((n > ns) & ~((ns >= 2) & one), greedy).otherwise(plain)
    pairs = sheet.filter("source is not null").select("commit_id", F.explode(F.arrays_zip("strips", names.alias("names"))).alias("p"), "source")
    out = pairs.select("commit_id", F.col("p.strips.strip").alias("strip"), F.col("p.names").alias("mark"), "source")
    bare = sheet.filter("source is null").select("commit_id", "y_name", "x_lo", "x_hi", F.greatest(F.lit(96.0), F.col("loose") * 1.55).alias("band"))
    rest = nearest_marks(strips.join(bare.select("commit_id"), "commit_id", "left_semi"), texts, bare)
    return out.unionByName(rest.select("commit_id", "strip", "mark", F.lit("nearest").alias("source")))
