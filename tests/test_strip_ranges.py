"""Ranges of sections in vertical tables, and chains of names, zones and sections, against plain Python."""

import random
from statistics import median

import pytest

from plinth.operators import strip_ranges as R

TEMPLATE = "commit_id long, segment int, y double, label string, key string"
LABELS = ["부호", "형태", "SECTION", "상부근", "하부근", "스트럽", "표피철근", "TYPE", None, "단 면", "단면고"]


def is_section(label):
    t = (label or "").replace(" ", "")
    return "형태" in t or "단면" in t or "SECTION" in (label or "").upper() or (label or "").strip().upper() == "TYPE"


def ranges(rows, band):
    """(anchor, low, high) of one segment."""
    ys = sorted((y for y, _ in rows), reverse=True)
    step = max(40.0, median(a - b for a, b in zip(ys, ys[1:]))) if len(ys) > 1 else max(80.0, 10.0 * len(ys))
    named = [y for y, label in rows if is_section(label)]
    if named:
        top, bottom = max(named), min(named)
        above, below = [y for y in ys if y > top + 1e-3], [y for y in ys if y < bottom - 1e-3]
        high = min(max(above) + max(50, min(1.05 * step, 360)), top + 3.5 * step + max(70, 9 * band)) if above else top + max(110, 2.2 * step)
        low = max(max(below) - max(52, min(1.22 * step, 460)), bottom - 2.55 * step - max(45, 6 * band)) if below else bottom - max(140, 2.45 * step)
        if high <= low + 90:
            high = low + max(380, 3.6 * step)
    else:
        bars = [y for y, label in rows if any(w in (label or "").replace(" ", "") for w in ("상부", "하부", "스트럽", "스터럽", "띠장"))]
        if not bars:
            return None
        pad = max(3.5 * band, 55.0) if len(bars) > 1 else max(6 * band, 70.0)
        low, high = min(bars) - pad, max(bars) + pad
    anchor = round(sum(named) / len(named), 4) if named else None
    block = max(880.0, min(4.68 * step + max(185.0, 7.5 * band), 1820.0))
    if high > low + 40 and high - low > block:
        middle = anchor if anchor is not None else (low + high) / 2
        low, high = middle - block / 2, middle + block / 2
    return anchor, low, high


def test_ranges(spark):
    rng = random.Random(5)
    segments = {s: [(rng.choice([rng.uniform(0, 900), rng.uniform(0, 6000), 100.0]), rng.choice(LABELS)) for _ in range(rng.randrange(1, 9))] for s in range(120)}
    rows = [(1, s, y, label, None) for s, own in segments.items() for y, label in own] + [(1, 500, None, "형태", None)]
    for band in (2.5, 30.0):
        got = {r.segment: (r.anchor, r.low, r.high) for r in R.section_ranges(spark.createDataFrame(rows, TEMPLATE), band).collect()}
        want = {s: found for s, own in segments.items() if (found := ranges(own, band))}
        assert got.keys() == want.keys()
        for s in want:
            assert got[s] == pytest.approx(want[s], abs=1e-6), (s, segments[s])


def test_dimensions_of_drawings_are_no_rows(spark):
    bands = [(1, 100.0, "900"), (1, 300.0, "900"), (1, 100.0, "199"), (1, 100.0, "RG1"), (1, None, "900"), (1, 200.0, "800"), (2, 100.0, "900"), (1, 101.0, " 1000 "), (1, 100.0, None)]
    template = [(1, 110.0, "형 태"), (1, 290.0, "상부근"), (3, 1.0, "형태")]
    got = R.rows_of_values(spark.createDataFrame(bands, "commit_id long, y double, text string"), spark.createDataFrame(template, "commit_id long, y double, label string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([b for i, b in enumerate(bands) if i not in (0, 7)], key=str)  # 200 is as near to the upper row


STRIP = "commit_id long, strip int, x_center double, section_y double, zone_y double, name_y double, loose double, mark string, low double, high double"
ITEM = "commit_id long, strip int, x double, y double, text string"


def test_section_rows(spark):
    strips = spark.createDataFrame([(1, 0, 0.0), (1, 1, 3000.0), (1, 2, 30_000.0), (2, 0, 0.0), (3, 0, 0.0)], "commit_id long, strip int, x_center double")
    items = spark.createDataFrame([(1, 0, 0.0, 500.0, "a"), (1, 0, 0.0, 300.0, "b"), (1, 1, 3000.0, 1200.0, "c"), (1, 2, 30_000.0, 90.0, "d"), (2, 0, 0.0, 100.0, "e")], ITEM)
    template = spark.createDataFrame([(1, 1000.0, "형태", None), (1, 200.0, "SECTION", None), (1, 1190.0, "부호", None), (2, 900.0, "형태", None), (2, 300.0, "형태", None)], "commit_id long, y double, label string, key string")
    got = {(r.commit_id, r.strip): r.section_y for r in R.section_rows(strips, items, template).collect()}
    assert got == {(1, 0): 1000.0, (1, 1): 1000.0, (1, 2): 200.0, (2, 0): 300.0}


def test_match_lines(spark):
    strips = [(1, 0, 0.0, 500.0, 700.0, 900.0, 100.0, "RG1", None, None), (1, 1, 5000.0, 500.0, 700.0, 900.0, 100.0, "RG2", 400.0, 950.0), (1, 2, 9000.0, 500.0, 700.0, 900.0, 100.0, " ", None, None), (1, 3, 12_000.0, 500.0, 700.0, 900.0, 1.0, "RG4", None, None), (1, 4, 20_000.0, 1.0, 2.0, 3.0, 1.0, "RG5", None, None)]
    items = [
        (1, 0, 10.0, 890.0, "RG1"), (1, 0, 0.0, 900.0, "RG7"), (1, 0, 30.0, 710.0, "INT"), (1, 0, 5.0, 3000.0, "CENTER"), (1, 0, 0.0, 100.0, "ALL"), (1, 0, 1.0, 700.0, "note"),
        (1, 1, 5000.0, 960.0, "RG2"), (1, 1, 5001.0, 940.0, "RG9"), (1, 1, 5000.0, 3000.0, "INT"), (1, 3, 12_000.0, 900.0, "RG8"), (1, 3, 12_000.0, 1400.0, "RG4"), (1, 3, 12_500.0, 1800.0, "EXT"), (1, 3, None, 1.0, "INT"),
    ]
    got = {r.strip: (r.mark, r.zone_text, [tuple(p) for p in r.points]) for r in R.match_lines(spark.createDataFrame(strips, STRIP), spark.createDataFrame(items, ITEM)).collect()}
    assert got == {
        0: ("RG1", "INT", [(10.0, 890.0), (30.0, 710.0), (0.0, 500.0)]), 1: ("RG9", "", [(5001.0, 940.0), (5000.0, 700.0), (5000.0, 500.0)]),
        3: ("RG8", "EXT", [(12_000.0, 900.0), (12_500.0, 1800.0), (12_000.0, 500.0)]), 4: ("RG5", "", [(20_000.0, 3.0), (20_000.0, 2.0), (20_000.0, 1.0)]),
    }


def test_nothing(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    assert R.section_ranges(none(TEMPLATE)).collect() == R.match_lines(none(STRIP), none(ITEM)).collect() == []
