"""The dispatcher: settings as users send them, records and summaries of every category."""

import pytest
from pyspark.sql import functions as F

from plinth.operators import extraction as X


def texts(spark):
    rows = [(1, 0.0, 100.0, "W1"), (1, 50.0, 100.0, "D10 @200"), (1, 0.0, 50.0, "W1"), (1, 50.0, 50.0, "D10 @200"), (1, 0.0, 10.0, "W2"), (2, 0.0, 0.0, "D13"), (3, 900.0, 900.0, "far"), (1, 5.0, 5.0, " ")]
    rows += [(4, 0.0, 90.0, "부호"), (4, 10.0, 90.0, "-1 C1"), (4, 20.0, 90.0, "C2"), (4, 0.0, 80.0, "주근"), (4, 10.0, 80.0, "8-D22"), (4, 20.0, 80.0, "8-D22")]
    return spark.createDataFrame([(c, i, x, y, "0", "TEXT", t) for i, (c, x, y, t) in enumerate(rows)], "commit_id long, id long, x double, y double, layer string, entity_type string, text string")


def test_settings_take_their_defaults():
    c = X.configured({"y_tolerance": "", "beam_row_merge_max_glue": "-1", "beam_row_bridge_passes": "3", "column_strip_gap": "x", "column_layout": " Vertical_Blocks ", "selection_bbox": [9, 8, 1, 2], "selection_bboxes": [[1, 2], "no"]}, "beam")
    assert (c.y_tolerance, c.beam_row_merge_max_glue, c.beam_row_bridge_passes, c.column_strip_gap, c.column_layout) == (2.5, None, 3, None, "vertical_blocks")
    assert c.selection_bbox == (1, 2, 9, 8) and c.boxes == [(1, 2, 9, 8)] and c.include_empty_text_entities
    assert not X.configured({"include_empty_text_entities": False}, "beam").include_empty_text_entities and not X.configured(None, "wall").include_empty_text_entities
    assert X.configured({"selection_bbox": "junk", "selection_bboxes": [[4, 3, 2, 1]]}, "wall").boxes == [(2, 1, 4, 3)]


def test_walls_and_their_summary(spark):
    rows, summary = X.extract(texts(spark), "wall", {"selection_bbox": [-10, -10, 200, 200]})
    got = {(r.commit_id, r.row): (r.cells, r.is_duplicate) for r in rows.filter("commit_id < 3").collect()}
    assert got == {(1, 0): (["W1", "D10 @200"], False), (1, 1): (["W1", "D10 @200"], True), (1, 2): (["W2"], False), (2, 0): (["D13"], False)}
    s = {r.commit_id: (r.text_entity_count, r.row_count, r.duplicate_row_indices, r.warning, r.boxes) for r in summary.collect()}
    assert s[1] == (5, 3, [1], None, 1) and s[3] == (0, 0, [], "no text in the selection", 1)


def test_columns_are_pivoted_where_marks_name_them(spark):
    rows, summary = X.extract(texts(spark), "column")
    got = {(r.commit_id, r.row): r.mark for r in rows.filter("commit_id = 4").collect()}
    assert got == {(4, 0): "C1", (4, 1): "C2"}
    s = {r.commit_id: (r.row_count, r.column_schedule_pivot) for r in summary.collect()}
    assert s[4] == (2, True) and s[1] == (3, False) and rows.filter("commit_id = 1").count() == 3


@pytest.mark.parametrize("category", ["beam", "slab"])
def test_other_categories_have_records(spark, category):
    rows, summary = X.extract(texts(spark), category, {"building_tag": "T"})
    assert rows.count() == summary.agg(F.sum("row_count")).first()[0] > 0


def test_unknown_category_and_runs(spark):
    with pytest.raises(ValueError, match="roof"):
        X.extract(texts(spark), "roof")
    _, summary = X.extract(texts(spark), "wall")
    at = F.to_timestamp(F.lit("2020-01-01"))
    none = spark.createDataFrame([], "id long, commit_id long, category string, rules_version string, row_count long, created_at timestamp")
    one = X.appended_run(none, summary, X.ExtractionConfig(), at)
    assert sorted(r.id for r in X.appended_run(one, summary, X.ExtractionConfig(), at).collect()) == [*range(1, 9)]


def beam_rows(spark, raw, rows):
    df = spark.createDataFrame([(1, i, float(x), float(y), "0", "TEXT", t) for i, (x, y, t) in enumerate(rows)], "commit_id long, id long, x double, y double, layer string, entity_type string, text string")
    found, _ = X.extract(df, "beam", {"beam_layout": "flat"} | raw)
    return [len(r.cells) for r in found.orderBy("row").collect()]


def test_each_row_setting_counts(spark):
    thin = [(0, 100, "RG1"), (10, 93, "4-D19"), (20, 93, "2-D19"), (30, 60, "x"), (40, 60, "y")]
    assert beam_rows(spark, {}, thin) == [3, 2]
    assert beam_rows(spark, {"beam_row_merge_y_max": 2, "beam_row_bridge_max_endpoint": 2}, thin) == [1, 2, 2]  # nothing is near enough
    assert beam_rows(spark, {"beam_row_merge_y_max": 50}, thin) == [5]
    assert beam_rows(spark, {"beam_row_merge_max_glue": 1, "beam_row_bridge_max_endpoint": 1}, thin) == [3, 2]  # two items don't glue, but bridge
    many = [(i, 100, f"a{i}") for i in range(6)] + [(i, 93, f"b{i}") for i in range(3)]
    assert beam_rows(spark, {}, many) == [9] and beam_rows(spark, {"beam_row_merge_max_merged": 8}, many) == [6, 3]
    apart = [(0, 100, "p"), (1, 100, "q"), (2, 100, "r"), (3, 100, "s"), (4, 100, "t"), (0, 95, "u"), (0, 70, "RG5"), (0, 30, "RG6")]
    assert beam_rows(spark, {}, apart) == [6, 2] and beam_rows(spark, {"beam_row_merge_y_max_mark": 5}, apart) == [6, 1, 1]
    ladder = [(0, 100, "RG1"), (0, 60, "RG2"), (0, 20, "RG3")]
    assert beam_rows(spark, {}, ladder) == [2, 1] and beam_rows(spark, {"beam_row_bridge_passes": 3}, ladder) == [3]
    between = [(0, 100, "RG1"), (0, 80, "p"), (1, 80, "q"), (2, 80, "r"), (3, 80, "s"), (4, 80, "t"), (0, 60, "RG2")]
    assert beam_rows(spark, {}, between) == [1, 5, 1] and beam_rows(spark, {"beam_row_bridge_max_mid": 9}, between) == [2, 5]
    ends = [(i, 100, f"RG{i}") for i in range(5)] + [(0, 60, "RG9")]
    assert beam_rows(spark, {}, ends) == [5, 1] and beam_rows(spark, {"beam_row_bridge_max_endpoint": 6}, ends) == [6]
