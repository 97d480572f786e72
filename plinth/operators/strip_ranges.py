"""Ranges along y of beams in vertical tables, by the rows that the table's label column repeats (C26, R16, R17), and the chains from a
member's name over its zone to its section (R14). Each is one or two groupings and windows by sheet and segment or strip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plinth.functions import members as M
from plinth.functions.numbers import median
from plinth.functions.signals import bare, zone_label
from plinth.operators.spatial import nearest

#: Words of rows of bars.
BAR_ROWS = "상부|하부|스트럽|스터럽|띠장"


def _clamp(low: float | Column, v: Column, high: float | Column) -> Column:
    lit = lambda c: c if isinstance(c, Column) else F.lit(c)
    return F.greatest(lit(low), F.least(v, lit(high)))


def row_steps(template: DataFrame) -> DataFrame:
    """(commit_id, segment, step): the median distance of a segment's neighbouring rows (commit_id, segment, y), 40 at least; with under two
    rows ten a row, 80 at least."""
    own = Window.partitionBy("commit_id", "segment").orderBy("y")
    gaps = template.filter("y is not null").withColumn("gap", F.col("y") - F.lag("y").over(own))
    out = gaps.groupBy("commit_id", "segment").agg(F.percentile("gap", F.lit(0.5)).alias("gap"), F.count("*").alias("n"))
    return out.select("commit_id", "segment", F.when(F.col("n") < 2, F.greatest(F.lit(80.0), 10.0 * F.col("n"))).otherwise(F.greatest(F.lit(40.0), F.col("gap"))).alias("step"))


def section_ranges(template: DataFrame, band: float = 2.5) -> DataFrame:
    """(commit_id, segment, anchor, low, high) of each segment of a table's label rows (commit_id, segment, y, label, key): where its
    section is looked for.

    Around the rows that name a section: up to the row above and down to the row below, somewhat padded, and a few row steps far at
    most. A segment without such a row takes the range of its rows of bars, one with neither has none. A range that is higher than
    one block of rows is cut to a block's height around its section's rows, ``anchor``, else around its middle. Rows without a y
    don't count."""
    rows = template.filter("y is not null").withColumn("y", F.col("y").cast("double"))
    own = Window.partitionBy("commit_id", "segment")
    named = M.is_section_anchor(F.col("label"), F.col("key"))
    bars = bare(F.coalesce("label", F.lit(""))).rlike(BAR_ROWS)
    rows = rows.withColumn("top", F.max(F.when(named, F.col("y"))).over(own)).withColumn("bottom", F.min(F.when(named, F.col("y"))).over(own))
    out = rows.groupBy("commit_id", "segment").agg(
        F.first("top").alias("top"), F.first("bottom").alias("bottom"), F.avg(F.when(named, F.col("y"))).alias("anchor"), F.max(F.when(F.col("y") > F.col("top") + 1e-3, F.col("y"))).alias("above"),
        F.max(F.when(F.col("y") < F.col("bottom") - 1e-3, F.col("y"))).alias("below"), F.min(F.when(bars, F.col("y"))).alias("b0"), F.max(F.when(bars, F.col("y"))).alias("b1"), F.count_if(bars).alias("bars"),
    )
    out = out.join(row_steps(rows), ["commit_id", "segment"])
    step, top, bottom = F.col("step"), F.col("top"), F.col("bottom")
    high = F.when(F.col("above").isNotNull(), F.least(F.col("above") + _clamp(50.0, 1.05 * step, 360.0), top + 3.5 * step + max(70.0, 9 * band))).otherwise(top + F.greatest(F.lit(110.0), 2.2 * step))
    low = F.when(F.col("below").isNotNull(), F.greatest(F.col("below") - _clamp(52.0, 1.22 * step, 460.0), bottom - 2.55 * step - max(45.0, 6 * band))).otherwise(bottom - F.greatest(F.lit(140.0), 2.45 * step))
    pad = F.when(F.col("bars") >= 2, max(3.5 * band, 55.0)).otherwise(max(6.0 * band, 70.0))
    sized = out.withColumn("low", F.when(top.isNotNull(), low).otherwise(F.col("b0") - pad)).withColumn("high", F.when(top.isNotNull(), high).otherwise(F.col("b1") + pad)).filter("low is not null")
    sized = sized.withColumn("high", F.when(top.isNotNull() & (F.col("high") <= F.col("low") + 90), F.col("low") + F.greatest(F.lit(380.0), 3.6 * step)).otherwise(F.col("high")))
    block = _clamp(880.0, 4.68 * step + max(185.0, 7.5 * band), 1820.0)
    over = (F.col("high") > F.col("low") + 40) & (F.col("high") - F.col("low") > block)
    middle = F.coalesce(F.round("anchor", 4), (F.col("low") + F.col("high")) / 2)
    cut = lambda c, sign: F.when(over, middle + sign * block / 2).otherwise(F.col(c)).alias(c)
    return sized.select("commit_id", "segment", F.round("anchor", 4).alias("anchor"), cut("low", -1), cut("high", 1))


def rows_of_values(bands: DataFrame, template: DataFrame) -> DataFrame:
    """The bands (commit_id, y, text) of a strip without those that are a number of 200 to 4000 next to a section's row: they are the
    drawing's dimensions. Next is the template's row (commit_id, y, label) nearest to it; of equally near ones the upper. Sheets
    without a template keep all."""
    text = F.trim(F.coalesce("text", F.lit("")))
    number = F.when(text.rlike(r"^\d{3,4}$"), text.try_cast("int"))
    maybe = bands.filter(F.coalesce(number.between(200, 4000), F.lit(False)))
    label = F.regexp_replace(F.coalesce("label", F.lit("")), r"[ \x{3000}]", "")
    drawn = label.contains("형태") | (label.contains("단면") & ~label.contains("단면고")) | F.upper(label).contains("SECTION")
    rows = template.filter("y is not null").groupBy("commit_id", (-F.col("y")).alias("row_y")).agg(F.min_by(drawn, "label").alias("drawn"))
    met = nearest(maybe.filter("y is not null").withColumn("at_y", -F.col("y")), rows, "commit_id", "at_y", "row_y", ["drawn"])
    kept = met.filter(~F.coalesce("drawn", F.lit(False))).select(*bands.columns)
    return bands.filter(~F.coalesce(number.between(200, 4000), F.lit(False)) | F.col("y").isNull()).unionByName(kept)


def section_rows(strips: DataFrame, items: DataFrame, template: DataFrame, gate: float = 4500.0) -> DataFrame:
    """(commit_id, strip, section_y): of a table's rows that name a section (template: commit_id, y, label, key) the one of each strip
    (commit_id, strip, x_center): the highest that is more than 60 below the strip's topmost text and its neighbours' within the
    gate along x; if there is none, the one nearest to the strip's median; without texts, their mean."""
    named = template.filter(M.is_section_anchor(F.col("label"), F.col("key")) & F.col("y").isNotNull()).select("commit_id", F.col("y").cast("double").alias("y"))
    texts = items.filter("x is not null and y is not null").select("commit_id", "strip", "x", "y")
    order = Window.partitionBy("commit_id").orderBy("x_center", "strip")
    own = strips.withColumn("left", F.lag("strip").over(order)).withColumn("right", F.lead("strip").over(order))
    near = own.withColumn("of", F.explode(F.array_compact(F.array("strip", "left", "right")))).select("commit_id", "strip", "x_center", F.col("of").alias("from"), (F.col("left").isNotNull() | F.col("right").isNotNull()).alias("beside"))
    reach = F.greatest(F.when(F.col("beside"), 1.72).otherwise(1.0) * max(2200.0, gate), F.lit(2800.0))
    tops = near.join(texts.withColumnRenamed("strip", "from"), ["commit_id", "from"]).filter(F.abs(F.col("x") - F.col("x_center")) <= reach).groupBy("commit_id", "strip").agg(F.max("y").alias("top"))
    middles = texts.groupBy("commit_id", "strip").agg(F.percentile("y", F.lit(0.5)).alias("middle"))
    met = own.select("commit_id", "strip").join(tops, ["commit_id", "strip"], "left").join(middles, ["commit_id", "strip"], "left").join(named, "commit_id")
    out = met.groupBy("commit_id", "strip").agg(F.max(F.when(F.col("y") < F.col("top") - 60, F.col("y"))).alias("under"), F.min_by("y", F.struct(F.abs(F.col("y") - F.col("middle")), "y")).alias("near"), F.first("middle").alias("middle"), F.avg("y").alias("mean"))
    return out.select("commit_id", "strip", F.round(F.coalesce("under", F.when(F.col("middle").isNotNull(), F.col("near")), "mean"), 4).alias("section_y"))


def match_lines(strips: DataFrame, items: DataFrame, band: float = 2.5) -> DataFrame:
    """(commit_id, strip, mark, inferred, zone_text, points): for each strip with an inferred mark a line of three points: its member's
    name, its zone, and its section.

    ``strips`` have commit_id, strip, x_center, section_y, zone_y, name_y, loose, mark, and low and high, the range of its segment (null: none);
    ``items`` commit_id, strip, x, y, text. Texts count from somewhat below the section's row, and in the segment. The zone is the label
    nearest along x among those near zone_y, else of all; the name is the strip's own member's title nearest to (x_center, name_y), unless
    another title is nearer by far; without either, the strip's centre at that row. Ties go to the lower x, y, then text."""
    own = strips.filter(F.trim("mark") != "").withColumn("mark", F.trim("mark"))
    text = F.trim(F.coalesce("text", F.lit("")))
    met = items.filter("x is not null and y is not null").select("commit_id", "strip", "x", "y", text.alias("text")).join(own, ["commit_id", "strip"])
    floor = F.greatest(F.col("section_y") - max(70.0, 11 * band), F.coalesce("low", F.lit(float("-inf"))))
    met = met.filter((F.col("y") >= floor) & (F.col("high").isNull() | (F.col("y") <= F.col("high") + 0.5)))
    here = F.struct("x", "y", "text")
    dx, dz = F.abs(F.col("x") - F.col("x_center")), F.abs(F.col("y") - F.col("zone_y"))
    far = F.pow(dx, 2) + F.pow(F.col("y") - F.col("name_y"), 2)
    is_zone, title = zone_label(F.col("text")).isNotNull(), M.is_member_title(F.col("text"))
    key = M.member_key(F.col("text"))
    same = title & (key == M.member_key(F.col("mark")))
    found = met.groupBy("commit_id", "strip").agg(
        F.min_by(here, F.when(is_zone, F.struct((dz > max(95.0, 16 * band)).alias("off"), dx.alias("dx"), dz.alias("dz"), here.alias("h")))).alias("z"),
        F.min(F.when(title, F.struct(far.alias("far"), here.alias("h")))).alias("any"), F.min(F.when(same, F.struct(far.alias("far"), here.alias("h")))).alias("own"),
    )
    out = own.join(found, ["commit_id", "strip"], "left")
    slack = F.greatest(F.lit(220.0 * 220.0), F.pow(F.col("loose"), 2) * 1.55)
    name = F.when(F.col("own.far") <= F.col("any.far") + slack, F.col("own.h")).otherwise(F.col("any.h"))
    out = out.withColumn("name", name)
    at = lambda x, y: F.struct(F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))
    points = F.array(
        at(F.coalesce("name.x", "x_center"), F.coalesce("name.y", "name_y")), at(F.coalesce("z.x", "x_center"), F.coalesce("z.y", "zone_y")), at(F.col("x_center"), F.col("section_y"))
    )
    return out.select("commit_id", "strip", F.coalesce("name.text", "mark").alias("mark"), F.col("mark").alias("inferred"), F.coalesce("z.text", F.lit("")).alias("zone_text"), points.alias("points"))
