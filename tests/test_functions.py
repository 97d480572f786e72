import random
from statistics import median

import pytest
from pyspark.sql import Row, functions as F

from plinth.functions import colors, fingerprints, geometry as G, numbers as N, signals as S
from plinth.operators import layout as L, relational as R, sections, spatial


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def array(values):
    return F.array(*(F.lit(float(v)) for v in values)) if values else F.array().cast("array<double>")


@pytest.mark.parametrize("seed", range(4))
def test_statistics(spark, seed):
    rng = random.Random(seed)
    v = [rng.randrange(200) / 4 for _ in range(rng.randrange(1, 40))]
    got = one(spark, m=N.median(array(v)), u=N.upper_median(array(v)), p=N.nearest_rank(array(v), 0.9), q=N.upper_quartile(array(v)), g=N.median_gap(array(v)), n=N.level_count(array(v), 3.0), e=N.edge_band(array(v)))
    s = sorted(v)
    assert (got.m, got.u, got.p, got.q) == (median(v), s[len(s) // 2], s[round(0.9 * (len(s) - 1))], s[len(s) * 3 // 4])
    assert got.n == sections.levels(v, 3.0) and got.g == pytest.approx(sections.median_gap(v)) and got.e == pytest.approx(sections.edge_band(v))
    assert L.upper(v, 3, 4) == got.q


def test_empty_and_odd_numbers(spark):
    got = one(spark, m=N.median(array([])), u=N.upper_median(array([])), n=N.level_count(array([]), 1.0), r=N.to_step(F.lit(2.5), 1.0), z=N.to_step(F.lit(2.5), 0.0), f=N.finite(F.lit(float("inf"))), nan=N.finite(F.lit(float("nan"))), p=S.positive(F.lit(" 3.5 ")), q=S.positive(F.lit("-1")), t=S.positive(F.lit("x")))
    assert (got.m, got.u, got.n, got.r, got.z, got.f, got.nan, got.p, got.q, got.t) == (0, None, 0, 2, 2.5, 0, 0, 3.5, None, None)


def points(*ps):
    return F.array(*(G.point(F.lit(float(x)), F.lit(float(y))) for x, y in ps)) if ps else F.array().cast("array<struct<x:double,y:double>>")


def test_geometry(spark):
    square = [(0, 0), (400, 0), (400, 600), (0, 600), (0, 0)]
    circle = G.circle_points(F.lit(5.0), F.lit(5.0), F.lit(2.0))
    got = one(spark, a=G.signed_area(points(*square[:-1])), none=G.signed_area(points((0, 0), (1, 1))), box=G.as_rectangle(points(*square)), not_=G.as_rectangle(points((0, 0), (200, 300), (400, 0), (400, 600), (0, 0))), c=G.as_circle(circle), n=F.size(circle), m=G.length_centroid(points((0, 0), (4, 0), (4, 2))), same=G.length_centroid(points((3, 3), (3, 3))), ring=G.closed_ring(points((0, 0), (1, 0), (9, 9))))
    assert (got.a, got.none, got.n) == (240_000, 0, 33) and tuple(got.box) == (0, 0, 400, 600) and got.not_ is None
    assert (got.c.x, got.c.y, got.c.r) == pytest.approx((5 + 2 / 33, 5, 2)) and got.ring[-1] == Row(x=0.0, y=0.0)
    assert tuple(got.m) == pytest.approx(((2 * 4 + 4 * 2) / 6, 2 / 6)) and tuple(got.same) == (3, 3)
    arc = one(spark, a=G.arc_points(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(30.0), F.lit(30.0)), b=G.arc_points(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    assert len(arc.a) == 31 and arc.b == []


def test_wkt_and_boxes(spark):
    got = one(spark, z=G.wkt_2d(F.lit("LINESTRING Z (0 0 1, 2.5 -3 4)")), p=G.wkt_points(F.lit("POLYGON ((1 2 3, 4 5))")), e=G.wkt_2d(F.lit("POINT Z EMPTY")), b=spatial.common_box([F.lit(x) for x in (0, 0, 5, 5)], [F.lit(x) for x in (4, 3, 9, 9)]), n=spatial.common_box([F.lit(x) for x in (0, 0, 5, 5)], [F.lit(x) for x in (5, 3, 9, 9)]))
    assert got.z == "LINESTRING (0 0, 2.5 -3)" and got.e == "POINT Z EMPTY" and [tuple(p) for p in got.p] == [(1, 2, 3), (4, 5, 0)]
    assert tuple(got.b) == (4, 3, 5, 5) and got.n is None
    assert R.parsed_boxes([[3, 4, 1, 2], "x", [1, 2], None, ["1", 2, 3, 4]]) == [(1, 2, 3, 4), (1, 2, 3, 4)] and R.parsed_boxes(None) == []


def test_selection(spark):
    rows = [(1, "TEXT", "WALL-1", " a ", 0.0, 0.0), (2, "TEXT", None, "b", 50.0, 50.0), (3, "LINE", "WALL-1", "c", 0.0, 0.0), (4, "MTEXT", "wall-x", "", 0.0, 0.0), (5, "ATTRIB", "HIDE", "d", 0.0, 0.0), (6, "TEXT", "WALL-1", "e", None, 0.0)]
    df = spark.createDataFrame(rows, "id long, entity_type string, layer string, text string, x double, y double")
    ids = lambda **k: sorted(r.id for r in R.text_items(df, R.Selection(**k)).collect())
    assert ids() == [1, 2, 5] and ids(keep_empty=True) == [1, 2, 4, 5] and ids(include_layers=["wall.*"], exclude_layers=[".*x"]) == [1]
    assert ids(box=(40, 40, 60, 60), boxes=[(-1, -1, 1, 1)]) == [1, 5] and ids(box=(60, 60, 40, 40)) == [2] and ids(exclude_layers=[""]) == [1, 5]


def test_colours_and_fingerprints(spark):
    palette = F.create_map(F.lit(1), F.lit("#ff0000"), F.lit(7), F.lit("#ffffff"))
    pen = lambda **k: colors.entity_pen(*(F.lit(k.get(n)).cast("long") for n in ("color", "raw", "true", "layer")))
    got = one(spark, a=pen(color=256, layer=1), b=pen(color=3, true=16744512), c=pen(color=256), d=pen(color=0, raw=0), e=pen(), f=pen(raw=5, color=9), css=colors.pen_css(F.lit(1), palette), bg=colors.pen_css(F.lit(256), palette), rgb=colors.pen_css(F.lit(16744512), palette), hexed=colors.value_pen(F.lit("#FF8000")), w=colors.line_pixels(F.lit(1000)))
    assert (got.a, got.b, got.c, got.d, got.e, got.f) == (1, 16744512, 7, 0, 7, 5)
    assert (got.css, got.bg, got.rgb, got.hexed, got.w) == ("#ff0000", "#e0e0e0", "#ff8040", 0xFF8000, 6.5)
    line = lambda a, b, c, d: fingerprints.line(*(F.lit(float(v)) for v in (a, b, c, d)), F.lit("L"), F.lit(None))
    same = one(spark, a=line(0, 0, 5, 5), b=line(5.2, 4.9, 0.1, 0), c=line(0, 0, 5, 6))
    assert same.a == same.b != same.c and len(same.a) == 32


def test_round_trip_of_block_points(spark):
    p = G.to_world(F.lit(3.0), F.lit(1.0), (F.lit(1.0), F.lit(1.0)), (F.lit(10.0), F.lit(20.0)), (F.lit(2.0), F.lit(1.0)), F.lit(90.0))
    got = one(spark, p=p, q=G.to_world(F.lit(3.0), F.lit(1.0), (F.lit(1.0), F.lit(1.0)), (F.lit(10.0), F.lit(20.0)), (F.lit(2.0), F.lit(1.0)), F.lit(0.0)))
    assert tuple(got.p) == pytest.approx((10, 24)) and tuple(got.q) == (14, 20)
