"""Marks of strips: one sheet for each rule, on literal fixtures."""

import pytest

from plinth.operators import marks as K

#: Sheets by number: strips' centres, titles (x, y, text), and what each strip is called. Names stand at y 1000, zones at 600.
SHEETS = {
    1: ([0, 1000, 2000], [(10, 1000, "G1"), (1010, 1000, "G2"), (1990, 1000, "G3")], ["G1", "G2", "G3"], "row_strip_count"),
    2: ([0, 1000], [(500, 800, "RG7 (400x700)")], ["RG7 (400x700)"] * 2, "between_zone_and_name"),
    3: ([0, 1000, 2000], [(0, 1000, "G1"), (2100, 1000, "G2")], ["G1", "G1", "G2"], "row_two_marks"),
    4: ([0, 1000], [(0, 800, "G1"), (1000, 800, "G2"), (400, 1000, "G9")], ["G1", "G2"], "between_strip_count"),
    5: ([0, 1000], [(900, 1000, "G1"), (300, 1000, "G5"), (1500, 1000, "G8")], ["G5", "G1"], "row"),
    6: ([0, 1000, 2000], [(0, 1000, "G 1"), (1000, 1000, "G1"), (2000, 1000, "g1")], ["G 1"] * 3, "row_strip_count"),
    7: ([0, 1000], [(100, 1110, "G4")], ["G4", "G4"], "nearest"),
    8: ([0, 1000, 2000, 3000], [(0, 1000, "G1"), (1600, 1000, "G2")], ["G1", "G2", "G2", "G2"], "row_two_marks"),
    9: ([0, 1000, 2000], [(0, 1000, "300"), (5, 990, "2-D10")], None, None),
}


def frames(spark):
    strips, items, texts, template = [], [], [], []
    for sheet, (centers, titles, _, _) in SHEETS.items():
        strips += [(sheet, i, float(x)) for i, x in enumerate(centers)]
        items += [(sheet, 600.0), (sheet, 500.0)]
        texts += [(sheet, sheet * 100 + i, float(x), float(y), t) for i, (x, y, t) in enumerate(titles)] + [(sheet, sheet * 100 + 90, 0.0, 600.0, "CENTER"), (sheet, sheet * 100 + 91, 0.0, 400.0, "3-D22")]
        template += [(sheet, 0, 1000.0, "NAME", "name"), (sheet, 1, 600.0, "END (INT.)", None), (sheet, 2, 400.0, "TOP BAR", "top_bar")]
    return (
        spark.createDataFrame(strips, "commit_id long, strip int, x_center double"), spark.createDataFrame(items, "commit_id long, y double"),
        spark.createDataFrame(texts, "commit_id long, id long, x double, y double, text string"), spark.createDataFrame(template, "commit_id long, position int, y double, label string, kind string"),
    )


@pytest.fixture(scope="module")
def found(spark):
    out = {}
    for r in K.strip_members(*frames(spark)).collect():
        out.setdefault(r.commit_id, {})[r.strip] = (r.mark, r.source)
    return out


@pytest.mark.parametrize("sheet", sorted(SHEETS))
def test_strips_find_their_members(found, sheet):
    centers, _, names, source = SHEETS[sheet]
    if names is None:
        assert sheet not in found
        return
    assert [found[sheet][i][0] for i in range(len(centers))] == names
    assert {s for _, s in found[sheet].values()} == {source}


def test_no_sheets(spark):
    assert K.strip_members(*(df.limit(0) for df in frames(spark))).count() == 0


def test_clusters_by_row_and_run(spark):
    rows = [(1, 1, 0.0, 0.0, "G1"), (1, 2, 20.0, 2.0, "G1 (3x4)"), (1, 3, 100.0, 1.0, "G2"), (1, 4, 0.0, 9.0, " "), (2, 5, 0.0, 0.0, "x")]
    got = K.mark_clusters(spark.createDataFrame(rows, "commit_id long, id long, x double, y double, text string"), 2.5, 30.0).collect()
    assert sorted(map(tuple, got)) == [(1, 10.0, 1.0, "G1 (3x4)"), (1, 100.0, 1.0, "G2"), (2, 0.0, 0.0, "x")]
