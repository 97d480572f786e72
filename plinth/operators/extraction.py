"""A schedule's extraction: one entry takes texts, a category and settings to records and a summary for each drawing."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from plinth.operators import beams, columns, schedules, vertical
from plinth.operators.numbering import numbered
from plinth.operators.records import CATEGORIES
from plinth.operators.relational import Box, Selection, normalized, parsed_boxes, text_items
from plinth.session import spare, staged


@dataclass(frozen=True)
class ExtractionConfig:
    """the knobs of an extraction."""

    rules_version: str = "1.0"
    layer_include: tuple[str, ...] = ()
    layer_exclude: tuple[str, ...] = ()
    y_tolerance: float = 2.5
    min_row_texts: int = 1
    bbox_wkt: str | None = None
    selection_bbox: Box | None = None
    selection_bboxes: tuple[Box, ...] = ()
    wall_mode: str = "cad"
    building_tag: str | None = None
    slab_layout: str = "auto"
    column_layout: str = "horizontal_table"
    column_strip_gap: float | None = None
    column_band_y_tol: float = 4.0
    beam_layout: str = "auto"
    beam_band_y_tol: float | None = None
    include_empty_text_entities: bool = False
    beam_row_merge_y_max: float | None = None
    beam_row_merge_y_max_mark: float | None = None
    beam_row_merge_max_glue: int | None = None
    beam_row_merge_max_merged: int | None = None
    beam_row_bridge_max_endpoint: int | None = None
    beam_row_bridge_max_mid: int | None = None
    beam_row_bridge_passes: int | None = None

    @property
    def boxes(self) -> list[Box]:
        return list(self.selection_bboxes) or ([self.selection_bbox] if self.selection_bbox else [])

    @property
    def joins(self) -> beams.RowJoins:
        """How a beam table's thin rows are joined. Rows of marks may be further apart than others, 80 at least."""
        gap = self.beam_row_merge_y_max if self.beam_row_merge_y_max and self.beam_row_merge_y_max > 0 else max(3.5 * self.y_tolerance, 10.0)
        mark_gap = self.beam_row_merge_y_max_mark if self.beam_row_merge_y_max_mark is not None else max(gap, 80.0)
        return beams.RowJoins(gap, mark_gap, self.beam_row_merge_max_glue, self.beam_row_merge_max_merged, self.beam_row_bridge_max_endpoint, self.beam_row_bridge_max_mid, self.beam_row_bridge_passes)


def _number(kind: type, value: object, least: float | None = None):
    try:
        out = kind(value)
    except (TypeError, ValueError):
        return None
    return out if least is None or out > least else None


def configured(raw: dict | None, category: str) -> ExtractionConfig:
    """settings as users send them: what is missing, blank or not a number takes its default; beams keep empty texts
    unless that is refused."""
    raw = dict(raw or {})
    known = {f.name for f in fields(ExtractionConfig)}
    out = ExtractionConfig(include_empty_text_entities=category == "beam" and raw.get("include_empty_text_entities") is not False)
    for name in ("rules_version", "wall_mode", "slab_layout"):
        out = replace(out, **{name: str(raw.get(name) or getattr(out, name))})
    for name in ("column_layout", "beam_layout"):
        out = replace(out, **{name: str(raw.get(name) or getattr(out, name)).strip().lower()})
    for name in ("y_tolerance", "column_band_y_tol"):
        out = replace(out, **{name: _number(float, raw.get(name) or getattr(out, name)) or getattr(out, name)})
    for name in ("column_strip_gap", "beam_band_y_tol", "beam_row_merge_y_max", "beam_row_merge_y_max_mark"):
        out = replace(out, **{name: _number(float, raw.get(name))})
    for name in sorted(n for n in known if n.startswith(("beam_row_bridge", "beam_row_merge_max"))):
        out = replace(out, **{name: _number(int, raw.get(name), 0)})
    boxes = parsed_boxes(raw.get("selection_bboxes"))
    one = parsed_boxes([raw.get("selection_bbox")])
    return replace(
        out, layer_include=tuple(raw.get("layer_include") or ()), layer_exclude=tuple(raw.get("layer_exclude") or ()), bbox_wkt=raw.get("bbox_wkt"), building_tag=raw.get("building_tag"),
        min_row_texts=_number(int, raw.get("min_row_texts") or 1) or 1, selection_bbox=normalized(one[0]) if one else None, selection_bboxes=tuple(boxes),
    )


def selection_of(config: ExtractionConfig) -> Selection:
    return Selection(config.selection_bbox, config.selection_bboxes, config.layer_include, config.layer_exclude, config.include_empty_text_entities)


def duplicate_key(category: str) -> list[Column]:
    """What makes two records of a category the same: of beams mark, width, depth and their bars; of walls the first 200
    characters; of slabs all cells; of columns bars, spacing, sizes and the first 120 characters."""
    text = lambda n: F.substring(F.array_join(F.coalesce("cells", F.array().cast("array<string>")), " "), 1, n)
    if category == "beam":
        bars = (f"{zone}_{part}_bar" for part in ("top", "bot") for zone in ("int", "cen", "ext"))
        return [F.trim(F.coalesce("mark", F.lit(""))), F.col("width_mm"), F.col("depth_mm"), F.concat_ws("|", *(F.substring(F.coalesce(b, F.lit("")), 1, 48) for b in bars))]
    if category == "wall":
        return [text(200)]
    return [F.col("cells")] if category == "slab" else [F.col("size_mm"), F.col("rebar_d"), F.col("spacing"), text(120)]


def numbered_duplicates(rows: DataFrame, category: str, index: str = "row") -> DataFrame:
    """``rows`` with ``is_duplicate``: an earlier record of its drawing has the same key."""
    names, key = [], rows
    for i, c in enumerate(duplicate_key(category)):
        names.append(spare(key, f"key{i}"))
        key = key.withColumn(names[-1], c)
    w = Window.partitionBy("commit_id", *names).orderBy(index)
    return key.withColumn("is_duplicate", F.row_number().over(w) > 1).drop(*names)


def records(texts: DataFrame, category: str, config: ExtractionConfig) -> DataFrame:
    """The records of each drawing's selected texts, numbered by ``row`` from 0, with the fields of their category."""
    if category == "beam" and config.beam_layout.startswith("vertical"):
        return vertical.vertical_schedule(texts, config.beam_band_y_tol or config.column_band_y_tol, config.column_strip_gap)
    if category == "beam":
        return beams.beam_schedule(texts, config.y_tolerance, config.beam_layout, config.joins)
    if category == "column" and config.column_layout == "vertical_blocks":
        out = columns.column_schedule(texts, config.column_band_y_tol, config.column_strip_gap)
        none = F.lit(None).cast("int")
        return out.withColumn("size_mm", F.when(F.col("width_mm").isNotNull(), F.array("width_mm", "depth_mm"))).withColumn("rebar_d", none).withColumn("spacing", none)
    rows = schedules.row_table(texts, category, config.y_tolerance, config.min_row_texts).withColumnRenamed("row_index", "row")
    rows = rows.withColumn("wall_mode", F.lit(config.wall_mode)).withColumn("building", F.lit(config.building_tag).cast("string"))
    if category == "slab" and config.slab_layout != "auto":
        rows = rows.withColumn("xy_variant", F.lit(config.slab_layout))
    return rows


def extract(texts: DataFrame, category: str, raw: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, summaries) of all drawings of ``texts`` (commit_id, id, x, y, layer, entity_type, text).

    Columns that aren't in vertical blocks are pivoted where a drawing has a row of marks, else its rows stand as they are. A
    summary (A22) has the counts of texts and records, the records that repeat an earlier one, the boxes, and a warning where a
    box selects nothing. Drawings without any text have no summary; an unknown category is an error."""
    if category not in CATEGORIES:
        raise ValueError(f"unknown category: {category}")
    config = configured(raw, category)
    found = text_items(texts, selection_of(config))
    rows = staged(numbered_duplicates(records(found, category, config), category), "extracted-rows")  # both results read them
    flags = rows.groupBy("commit_id").agg(F.count("*").alias("row_count"), F.array_sort(F.collect_list(F.when(F.col("is_duplicate"), F.col("row")))).alias("duplicate_row_indices"))
    pivoted = F.lit(None).cast("boolean")
    out = rows
    if category == "column" and config.column_layout != "vertical_blocks":
        table = schedules.column_pivot(rows)
        some = table.groupBy("commit_id").agg(F.count("*").alias("n"))
        flags = flags.join(some, "commit_id", "left").withColumn("row_count", F.coalesce("n", "row_count"))
        pivoted = F.col("n").isNotNull()
        kept = rows.join(some.select("commit_id"), "commit_id", "left_anti")
        out = kept.unionByName(table.withColumn("row", F.col("column")), allowMissingColumns=True)
    counts = texts.select("commit_id").distinct().join(found.groupBy("commit_id").agg(F.count("*").alias("text_entity_count")), "commit_id", "left")
    summary = counts.join(flags, "commit_id", "left").select(
        "commit_id", F.lit(category).alias("category"), F.coalesce("text_entity_count", F.lit(0)).cast("long").alias("text_entity_count"), F.coalesce("row_count", F.lit(0)).cast("long").alias("row_count"),
        F.coalesce("duplicate_row_indices", F.array().cast("array<int>")).alias("duplicate_row_indices"), pivoted.alias("column_schedule_pivot"),
        F.lit(len(config.boxes)).alias("boxes"), F.when(F.lit(bool(config.boxes)) & F.col("text_entity_count").isNull(), "no text in the selection").alias("warning"),
    )
    return out, summary


def appended_run(history: DataFrame, summary: DataFrame, config: ExtractionConfig, at: Column) -> DataFrame:
    """The history of runs (id, commit_id, category, rules_version, row_count, created_at) and a run for each summary;
    ids follow the greatest one."""
    last = history.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long")).first()[0]
    new = numbered(summary.select("commit_id", "category", F.lit(config.rules_version).alias("rules_version"), "row_count", at.alias("created_at")), ["commit_id"], "id", last)
    return history.unionByName(new.select(*(F.col(f.name).cast(f.dataType) for f in history.schema.fields)))
