"""Vertical blocks of beams, on literal sheets."""

from plinth.operators import layout as L, vertical as V
from plinth.operators.extraction import extract

I = L.Item  # noqa: E741


def sheet():
    labels = [(100, "부호"), (80, "형태"), (60, "상부근"), (40, "하부근"), (20, "스터럽")]
    items = [I(0, y, t) for y, t in labels]
    strips = {2000: ("RG1 (400x700)", "INT.", "4-D22", "3-D22", "D10@150"), 2400: ("", "CENTER", "2-D22", "5-D22", "D10@200"), 3400: ("RG2", "ALL", "4-D25", "4-D25", "D13@100")}
    for x, cells in strips.items():
        items += [I(x, y, t) for (y, _), t in zip(labels, cells) if t]
    return items


def test_members_and_their_zones():
    got = V.vertical_records(sheet(), gap=250.0)
    assert [r["name"] for r in got] == ["RG1", "RG2"]
    one, two = got
    assert (one["width_mm"], one["depth_mm"]) == ("400", "700")
    assert (one["int_top_bar"], one["cen_top_bar"], one["cen_bot_bar"], one["int_stirrup_bar"]) == ("4-D22", "2-D22", "5-D22", "D10@150")
    assert "ext_top_bar" not in one and {two[f"{z}_top_bar"] for z in ("int", "cen", "ext")} == {"4-D25"}


def test_zone_columns_are_cut_apart():
    items = [I(600, 80, "INT."), I(600, 60, "a"), I(605, 40, "b"), I(1000, 80, "CENTER"), I(1000, 60, "c"), I(1002, 40, "d")]
    template = [(100.0, "부호"), (80.0, "형태"), (60.0, "상부근")]
    assert [sorted(i.text for i in s) for s in V.zone_columns([items], template, 4.0)] == [["INT.", "a", "b"], ["CENTER", "c", "d"]]
    same = [i._replace(text="INT.") if i.text == "CENTER" else i for i in items]
    assert len(V.zone_columns([same], template, 4.0)) == 1


def test_band_zone_is_the_nearest_last():
    bands = [(90.0, "EXT."), (70.0, "INT. CENTER"), (10.0, "ALL")]
    assert V.band_zone(bands, 72.0) == "CENTER" and V.band_zone(bands, None) == "EXT." and V.band_zone([(1.0, "D10")], 1.0) is None


def test_runs_carry_names_on():
    runs = V.member_runs([(3, {"name": "G2"}), (1, {"name": "G 1"}), (2, {}), (4, {"name": "g2"})])
    assert [[p.get("name") for p in r] for r in runs] == [["G 1", None], ["G2", "g2"]]


def test_through_the_dispatcher(spark):
    rows = [(7, i, float(t.x), float(t.y), "0", "TEXT", t.text) for i, t in enumerate(sheet())]
    df = spark.createDataFrame(rows, "commit_id long, id long, x double, y double, layer string, entity_type string, text string")
    out, summary = extract(df, "beam", {"beam_layout": "vertical_blocks", "column_strip_gap": 250})
    assert [(r.row, r.mark, r.cen_bot_bar) for r in out.orderBy("row").collect()] == [(0, "RG1", "5-D22"), (1, "RG2", "4-D25")]
    assert summary.first()["row_count"] == 2
