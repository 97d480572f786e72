"""Schedules of walls, slabs and columns from rows of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from plinth.functions import signals as S
from plinth.operators.clusters import leader_rows, row_summaries

KINDS = ["주근", "형태", "대근_중앙", "대근_상하단"]


def row_table(texts: DataFrame, category: str, tolerance: float = 2.5, min_texts: int = 1) -> DataFrame:
    """R2: a record for each row of texts with enough of them: cells from left to right, signals merged over the cells (the
    last that has one counts), role and, for slabs, the order of X and Y."""
    items = S.with_signals(leader_rows(texts, "commit_id", -F.col("y"), [F.col("x"), F.col("id"), F.col("text")], tolerance), "text", "signals")
    rows = row_summaries(items, "signals").filter(F.size("cells") >= min_texts)
    merged = S.let(F.col("signals"), S.merged_signals)
    out = rows.withColumn("_m", merged).select(*(c for c in rows.columns if c != "signals"), *(F.col("_m")[f].alias(f) for f in S.SIGNALS))
    out = out.withColumn("category", F.lit(category)).withColumn("role", S.row_role(F.col("cells")))
    return out.withColumn("xy_variant", S.slab_variant(F.col("cells"))) if category == "slab" else out


def column_pivot(rows: DataFrame) -> DataFrame:
    """A record for each column of a column schedule: the first row of marks (부호) names them, and rows of bars, shapes
    and hoops fill them, later rows overwriting earlier ones. Drawings without a row of marks have none. ``rows`` has
    commit_id, y_mean and cells."""
    top = Window.partitionBy("commit_id").orderBy(F.col("y_mean").desc())
    kind = S.column_label(F.try_element_at("cells", F.lit(1)))
    own = rows.withColumn("kind", kind).withColumn("n", F.row_number().over(top))
    marks = own.filter("kind = '부호' and size(cells) >= 2").groupBy("commit_id").agg(F.min_by("cells", "n").alias("c"))
    marks = marks.select("commit_id", F.posexplode(F.slice("c", 2, F.size("c"))).alias("at", "mark_cell"))
    values = own.filter(F.col("kind").isin(KINDS) & (F.size("cells") > 1)).select("commit_id", "kind", "n", F.posexplode(F.slice("cells", 2, F.size("cells"))).alias("at", "value"))
    last = values.groupBy("commit_id", "at").pivot("kind", KINDS).agg(F.max_by("value", "n"))
    building = own.filter("kind = '동_헤더'").groupBy("commit_id").agg(F.max_by(F.col("cells")[0], "n").alias("building"))
    out = marks.join(last, ["commit_id", "at"], "left").join(building, "commit_id", "left")
    parsed = S.story_and_mark(F.col("mark_cell"))
    body, _ = S.without_dimension(S.story_text(F.col("mark_cell")))
    story = F.coalesce(parsed["story"], S.story_label(parsed["floor_range"]))
    return out.select("commit_id", F.col("at").alias("column"), F.coalesce(parsed["mark"], body).alias("mark"), story.alias("story_label"), "building", *(F.coalesce(k, F.lit("")).alias(k) for k in KINDS))
