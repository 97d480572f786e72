import pytest
from pyspark.sql import functions as F

from plinth.functions import kernels as K, signals as S
from plinth.operators import columns as C, layout as L

I = L.Item  # noqa: E741

STORIES = [
    ("-4 ~ -3C2A", ("-4~-3", "C2A", ["-4", "-3"], None)), ("-4 - -3 C2A", ("-4~-3", "C2A", ["-4", "-3"], None)), ("~ -1C2", ("~-1", "C2", ["~", "-1"], None)),
    ("-2 C1", ("-2", "C1", None, None)), ("-3C31", ("-3", "C31", None, None)), ("2C5", ("2", "C5", None, None)), ("-4C~-2C1 500", (None, None, None, 500)),
    ("-2C21A 500", ("-2", "C21A", None, 500)), ("-3C31 500", ("-3", "C31", None, 500)), ("", (None,) * 4), ("500", (None,) * 4),
]


def test_stories(spark):
    assert [tuple(K.member(t)) for t, _ in STORIES] == [w for _, w in STORIES]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(STORIES)], "i int, t string").select("i", S.story_and_mark(F.col("t")).alias("s")).orderBy("i").collect()
    assert [tuple(r.s) for r in got] == [w for _, w in STORIES]


def test_signals(spark):
    texts = ["D22 @200 600x400 B2F~B1F", "600(400) wall", "600/400", "-4 ~ -3C2A", "8-UHD19", "SHD25", "1F 지하", None]
    got = [r.s for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", S.text_signals(F.col("t")).alias("s")).orderBy("i").collect()]
    assert (got[0].rebar_d, got[0].spacing, got[0].size_mm, got[0].floor_range) == (22, 200, [600, 400], ["B2F", "B1F"])
    assert got[1].thickness_pair == got[2].thickness_pair == [600, 400]
    assert got[3].floor_range == ["-4", "-3"] and (got[4].main_bar_bars, got[4].rebar_d) == (8, 19) and got[5].rebar_d == 25
    assert got[6].floor_tokens == ["1F"] and got[7].rebar_d is None


def test_strength_and_callouts():
    rest, notes = K.strength("fck = 35MPa 12-UHD19")
    assert "12-UHD19" in rest and "fck" in notes and "35" in notes
    assert K.without_callouts("#32.C51 extra", "C42") == "extra" and K.without_callouts("#32.C42 note", "C42") == "C42 note"


def test_far_storey_lines_reach_the_name_row():
    template = [(10000.0, "부호"), (9600.0, "형태"), (9000.0, "주근")]
    got = C.mapped([(13300.0, "-4 ~ -3"), (10020.0, "C22")], template, 4.0)
    assert set(got) == {0} and "C22" in got[0] and got[0].startswith("-4 ~ -3")


def test_beams_drop_far_noise():
    template = [(1000.0 - 50 * i, f"row{i}") for i in range(17)]
    bands = [(983.0, "RG11"), (50.0, "FAR-NOISE")]
    assert "FAR-NOISE" not in C.mapped(bands, template, 4.0, beams=True).values()
    assert "FAR-NOISE" in C.mapped(bands, template, 4.0).values()


def sheet():
    labels = ["NAME", "SECTION", "SIZE", "MAIN BAR", "(MID) HOOP BAR"]
    members = [("-2C21A 500", "", "600 x 400", "12-UHD19", "D10@300"), ("-4 ~ -3 C5", "", "500 x 500", "fck = 35MPa 8-D22", "D10@200"), ("-1C7", "", "800 X 700", "16-D25", "D13@150")]
    items = [I(0, 1000 - 100 * i, t) for i, t in enumerate(labels)]
    return items + [I(3000 + 3000 * k, 1000 - 100 * i, t) for k, m in enumerate(members) for i, t in enumerate(m) if t]


def test_vertical_blocks(spark):
    rows = C.column_records(sheet())
    assert [(r["mark"], r["story_label"], r["width_mm"], r["depth_mm"]) for r in rows] == [("C21A", "-2", 600, 400), ("C5", "-4~-3", 500, 500), ("C7", "-1", 800, 700)]
    assert rows[1]["MAIN_BAR"] == "8-D22" and "35" in rows[1]["CONCRETE_STRENGTH"] and rows[0]["center_hoop_bar"] == "D10@300"
    assert rows[0]["member_label"] == "-2C21A" and rows[0]["keys"][0] == "NAME__0"
    df = spark.createDataFrame([(1, i, float(t.x), float(t.y), t.text) for i, t in enumerate(sheet())] + [(2, 1, 0.0, 0.0, "x")], "commit_id long, id long, x double, y double, text string")
    got = C.column_schedule(df).orderBy("row").collect()
    assert [(r.commit_id, r.mark, r.SIZE) for r in got] == [(1, "C21A", "600 x 400"), (1, "C5", "500 x 500"), (1, "C7", "800 X 700")]


def test_name_gives_size():
    r = C.record([(0.0, "NAME")], ["-2C21A 500"])
    assert (r["member_label"], r["mark"], r["story_label"], r["SIZE"]) == ("-2C21A", "C21A", "-2", "500")
    assert C.record([(0.0, "NAME")], ["-4C~-2C1"])["story_parse_error"]


@pytest.mark.parametrize("text,mm", [("900", True), ("900mm", True), ("1,000", True), ("형       태", False), ("99", False)])
def test_lone_dimensions(spark, text, mm):
    assert spark.range(1).select(S.is_lone_dimension(F.lit(text))).first()[0] is mm


def test_marks_and_tiers(spark):
    row = spark.range(1).select(S.mark_and_size(F.lit("RG13C (1000x900)")).alias("m"), S.two_tiers(F.lit("11-11-D16")).alias("t")).first()
    assert tuple(row.m) == ("RG13C", 1000, 900) and row.t == "11/11-D16"
