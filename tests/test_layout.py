import random

import pytest
from pyspark.sql import functions as F

from plinth.operators import beams as B, clusters, layout as L, schedules

I = L.Item  # noqa: E741


def test_rows_by_leader_and_bands_by_chain():
    items = [I(0, 100, "A"), I(50, 100, "B"), I(0, 50, "C")]
    rows = L.leader_rows(items, 5)
    assert [[i.text for i in r] for r in rows] == [["A", "B"], ["C"]]
    ys = [I(0, y, str(y)) for y in (10, 8.5, 8.0, 7.4, 5.0)]
    assert [len(r) for r in L.leader_rows(ys, 2.5)] == [3, 2]
    assert len(L.y_bands(ys, 2.5)) == 1


def test_sparse_rows_join():
    row = lambda y: [I(0, y, "a")]
    assert [len(r) for r in L.joined_rows([row(100), row(95)], 2.5, gap=12)] == [2]
    assert len(L.joined_rows([row(100), row(40)], 2.5, gap=12)) == 2
    chain = [[I(i, 200 - 0.6 * i, "x")] for i in range(8)]
    assert [len(r) for r in L.joined_rows(chain, 2.5, gap=20, glue=1)] == [8]
    assert len(L.joined_rows([[I(0, 10, "부호")], [I(5, 9, "RG2")]], 2.5)) == 2


def test_bridges():
    rows = [[I(0, 100, "RG13B")], [I(400, 99.6, "-")], [I(1200, 99.85, "RG13B")]]
    got = L.bridged_rows(rows, 15)
    assert len(got) == 2 and [i.x for i in max(got, key=len)] == [0, 1200]
    dense = [I(x, 99.9, "D16") for x in range(5)]
    assert len(L.bridged_rows([rows[0], dense, rows[2]], 15)) == 3


def test_strips_merge():
    strip = lambda x, n: [I(x, i, f"t{i}") for i in range(n)]
    out, _ = L.merged_strips([strip(-16828, 14), strip(-16062, 4)])
    assert [len(s) for s in out] == [18]
    out, log = L.merged_strips([strip(68508, 6), strip(68566, 4)])
    assert [len(s) for s in out] == [10] and "fragment_pair" in log


def test_segments():
    labels = ["기호", "형태", "상부근"] * 4
    rows = [(1000 - 10 * i, lab) for i, lab in enumerate(labels)]
    segments = L.template_segments(rows, 4)
    assert [len(s) for s in segments] == [3, 3, 3, 3]
    assert L.segment_at(985, rows, segments, 4) == 0 and L.segment_at(0, rows, segments, 4) == 3
    ys = [1100, 1090, 1110, 1105]
    assert L.segment_at(1110, [(y, "") for y in ys], [[0, 1], [2, 3]], 4) == 1


def wide_sheet():
    heads = ["NAME", "TYPE", "MATERIAL", "WIDTH", "DEPTH", "INT TOP", "CEN TOP", "EXT TOP", "INT BOT", "CEN BOT", "EXT BOT", "INT STIRRUP", "CEN STIRRUP", "EXT STIRRUP", "SIDE BAR"]
    cells = ["G21", "B", "C24", "500", "600", *["11-11-D16"] * 6, *["D10@200"] * 3, "2-D13"]
    return [I(100 * i, 1000, t) for i, t in enumerate(heads)] + [I(100 * i, 900, t) for i, t in enumerate(cells)]


def test_wide_beam_table():
    assert [L.wide_key(i.text) for i in wide_sheet()[:15]] == L.BEAM_KEYS
    (row,) = B.beam_records(wide_sheet())
    assert (row["beam_layout"], row["mark"], row["width_mm"], row["depth_mm"], row["int_top_bar"]) == ("horizontal_wide", "G21", "500", "600", "11/11-D16")


def location_sheet():
    lines = [["NAME", "LOCATION", "TOP BAR", "BOT BAR", "STIRRUP"], ["RG11", "INT", "4-D16", "3-D16", "D10@200"], ["", "CENTER", "2-D16", "5-D16", "D10@250"], ["RG12", "ALL", "6-D16", "6-D16", "D10@150"]]
    return [I(100 * j, 1000 - 50 * i, t) for i, line in enumerate(lines) for j, t in enumerate(line)]


def test_location_tree():
    rows = B.beam_records(location_sheet())
    assert [r["mark"] for r in rows] == ["RG11", "RG12"]
    assert (rows[0]["int_top_bar"], rows[0]["cen_top_bar"]) == ("4-D16", "2-D16")
    assert rows[1]["int_top_bar"] == rows[1]["cen_top_bar"] == rows[1]["ext_top_bar"] == "6-D16"
    assert rows[0]["row_y_mean"] == 925


def test_flat_fallback():
    (row,) = B.beam_records([I(0, 0, "noise")])
    assert row["beam_layout"] == "flat"


def test_beams_of_drawings(spark):
    rows = [(1, k, i.x, float(i.y), i.text) for k, i in enumerate(wide_sheet())] + [(2, k, float(i.x), float(i.y), i.text) for k, i in enumerate(location_sheet())] + [(3, 1, None, 1.0, "x"), (3, 2, 1.0, 1.0, None)]
    df = spark.createDataFrame([(a, b, None if x is None else float(x), y, t) for a, b, x, y, t in rows], "commit_id long, id long, x double, y double, text string")
    got = {(r.commit_id, r.mark): r.beam_layout for r in B.beam_schedule(df).collect()}
    assert got == {(1, "G21"): "horizontal_wide", (2, "RG11"): "horizontal_location_tree", (2, "RG12"): "horizontal_location_tree", (3, ""): "flat"}


def test_column_pivot(spark):
    rows = [
        (1, 100.0, ["부호", "-4 ~ -3C2A", "C5 500"]), (1, 90.0, ["주근", "8-D22", "4-D16"]), (1, 85.0, ["대근(중앙)", "D10@300"]), (1, 80.0, ["형태", "A", "B"]),
        (1, 70.0, ["주근", "9-D22"]), (1, 60.0, ["101동"]), (2, 10.0, ["x", "y"]),
    ]
    got = [tuple(r) for r in schedules.column_pivot(spark.createDataFrame(rows, "commit_id long, y_mean double, cells array<string>")).orderBy("column").collect()]
    assert got == [(1, 0, "C2A", "-4~-3", "101동", "9-D22", "A", "D10@300", ""), (1, 1, "C5", None, "101동", "4-D16", "B", "", "")]


def test_wall_rows(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 10.0, "W1 D22 @200"), (1, 2, 5.0, 9.0, "600x400"), (1, 3, 0.0, 0.0, "B2F~B1F 600(400)")], "commit_id long, id long, x double, y double, text string")
    a, b = schedules.row_table(df, "wall").orderBy("row_index").collect()
    assert (a.cells, a.rebar_d, a.spacing, a.size_mm) == (["W1 D22 @200", "600x400"], 22, 200, [600, 400])
    assert (b.floor_range, b.thickness_pair) == (["B2F", "B1F"], [600, 400])


@pytest.mark.parametrize("seed", range(3))
def test_streamed_leaders_agree_with_the_kernel(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 2, None]), i, float(rng.randrange(50)), rng.choice([None, *(rng.randrange(400) / 10 for _ in range(20))]), "t") for i in range(2500)]
    df = spark.createDataFrame(rows, "commit_id long, id long, x double, y double, text string")
    got = {r.id: r.row_index for r in clusters.leader_rows(df, "commit_id", -F.col("y"), [F.col("x"), F.col("id")], 2.5).collect()}
    for key in (1, 2, None):
        for n, row in enumerate(L.leader_rows([I(x, y, t, i) for c, i, x, y, t in rows if c == key and y is not None], 2.5)):
            assert {got[i.id] for i in row} == {n}
    assert all(got[i] is None for c, i, x, y, t in rows if y is None)


def row(*parts):
    return [I(x, y, t) for x, y, t in parts]


def test_bundle():
    items = row((10, 3000, "Name"), (10, 2910, "Width"), (10, 2820, "Int. TopBar"), (200, 3000, "BX1"), (200, 2910, "400"), (200, 2820, "5-D22"))
    (got,) = B.beam_records(items, 5.0, joins=B.RowJoins(gap=12.0))
    assert (got["beam_layout"], got["mark"], got["width_mm"], got["int_top_bar"]) == ("row_cluster_bundle", "BX1", "400", "5-D22")


def test_bundle_zones():
    lines = [("부호", "RG13C (1000x900)"), ("END(INT)", "-"), ("상부근", "4-4-D16"), ("양단부", "-"), ("하부근", "6-D16"), ("스트럽", "D10@200")]
    items = [I(x, 1000 - 100 * k, t) for k, pair in enumerate(lines) for x, t in zip((0, 500), pair) if t]
    (got,) = B.beam_records(items)
    assert (got["mark"], got["width_mm"], got["depth_mm"], got["int_top_bar"]) == ("RG13C", "1000", "900", "4/4-D16")
    assert got["int_bot_bar"] == got["ext_bot_bar"] == "6-D16" and "cen_bot_bar" not in got


def test_zone_slabs_and_windows():
    zones = row((1000, 5000, "INT (BOTH)"), (2000, 5000, "28-UHD19"), (6000, 5000, "END (INT)"), (7000, 5000, "4-UHD19"))
    assert [len(s) for s in B.zone_slabs(zones)] == [2, 2]
    assert len(B.zone_slabs(zones[:2])) == 1 and len(B.zone_slabs(row((1000, 0, "INT"), (1050, 0, "CENTER")))) == 1
    low, high = B.focus_window(row((0, 1000, "RG11"), (200, 1100, "INT"), (400, 1120, "900"), (200, 2600, "28-UHD19")))
    assert (low, high) == (1055, 2645)
    assert B.focus_window(row((0, 1000, "RG11"), (200, 1000, "INT"), (400, 1000, "28-UHD19"))) is None
    assert B.is_mark("RG11 (1000x900)") and not B.is_mark("28-UHD19") and B.is_zone("  CENTER  ")
    assert B.tight_window(row((0, 0, "INT"), (0, 100, "D10@200"))) == (-50, 150)


def test_keys_of_columns_use_compiled_patterns(monkeypatch):
    """a cell's key is asked for each pair of cells, most of which have none."""
    monkeypatch.setattr(L, "re", None)
    cells = ["INT. TOP BAR F5", "END bot_bar F5", "중앙 스트럽 F5", "cen f5 both ends top", "3-D12 @100 F5", "top bar F5", "side bar F5", "F5 width", " - "]
    assert [L.wide_key(c) for c in cells] == ["int_top_bar", "ext_bot_bar", "cen_stirrup_bar", "cen_top_bar", None, None, "side_bar", "width_mm", None]
    assert [L.narrow_key(c) for c in ("구간 F5", "F5 topbar", "3-D12 F5")] == ["location", "top_bar", None]
