import math

import pytest
from pyspark.sql import functions as F

from plinth.sources import dxf, store


def tags(*pairs):
    return "".join(f"{c:>3}\n{v}\n" for c, v in pairs)


def drawing(entities, layers="", blocks=""):
    return (
        tags((0, "SECTION"), (2, "TABLES")) + layers + tags((0, "ENDSEC"), (0, "SECTION"), (2, "BLOCKS")) + blocks
        + tags((0, "ENDSEC"), (0, "SECTION"), (2, "ENTITIES")) + entities + tags((0, "ENDSEC"), (0, "EOF"))
    ).encode()


TEXT = tags((0, "TEXT"), (8, "0"), (10, 0), (20, 0), (40, 2.5), (1, "D22 @200 600x400"))


def rows(content, **kw):
    return list(dxf.Scanner(dxf.Drawing.parse(content), kw.get("skip", False)).rows())


def entities(content, **kw):
    return [r for r in rows(content, **kw) if r["row_kind"] == "entity"]


def test_minimal_text():
    (only,) = entities(drawing(TEXT))
    assert only["entity_type"] == "TEXT" and "D22" in only["props"]["text"]


def test_mtext_paragraph_aligns():
    (only,) = entities(drawing(tags((0, "MTEXT"), (8, "0"), (10, 0), (20, 0), (40, 2.5), (41, 40), (1, "\\pqc;L1\\P\\pql;L2"))))
    assert only["props"]["mtext_line_aligns"] == "center,left" and only["props"]["mtext_width"] == "40.0"
    assert only["props"]["text"] == "L1\nL2"


def test_off_layers():
    layers = tags((0, "LAYER"), (2, "ON_L"), (70, 0), (62, 7)) + tags((0, "LAYER"), (2, "OFF_L"), (70, 0), (62, -7))
    line = lambda layer, y: tags((0, "LINE"), (8, layer), (10, 0), (20, y), (11, 10), (21, y))
    content = drawing(line("ON_L", 0) + line("OFF_L", 5), layers)
    assert len(entities(content)) == 2
    assert [r["layer"] for r in entities(content, skip=True)] == ["ON_L"]


def test_blocks_nest_and_inherit():
    line = tags((0, "LINE"), (8, "0"), (62, 0), (10, 0), (20, 0), (11, 10), (21, 0))
    inner = tags((0, "BLOCK"), (2, "IN"), (10, 0), (20, 0)) + line + tags((0, "ENDBLK"))
    outer = tags((0, "BLOCK"), (2, "OUT"), (10, 1), (20, 0), (0, "INSERT"), (8, "0"), (62, 0), (2, "IN"), (10, 1), (20, 0), (0, "INSERT"), (2, "OUT"), (10, 0), (20, 0), (0, "ENDBLK"))
    insert = tags((0, "INSERT"), (8, "WALL"), (62, 3), (66, 1), (2, "OUT"), (10, 100), (20, 50), (41, 2), (42, 2), (50, 90), (70, 2), (44, 10), (0, "ATTRIB"), (2, "NO"), (1, "7"), (0, "SEQEND"))
    got = rows(drawing(insert, blocks=inner + outer))
    lines = [r for r in got if r["row_kind"] == "entity"]
    assert len(lines) == 2 and {(r["layer"], r["color"], r["insert_key"]) for r in lines} == {("WALL", 3, 1)}
    first, second = lines
    assert [(round(p["x"], 6), round(p["y"], 6)) for p in first["points"]] == [(100, 50), (100, 70)]
    assert [(round(p["x"], 6), round(p["y"], 6)) for p in second["points"]] == [(100, 60), (100, 80)]
    assert [(r["tag"], r["value"]) for r in got if r["row_kind"] == "attribute"] == [("NO", "7")]
    assert {r["block_name"] for r in got if r["row_kind"] == "block"} == {"IN", "OUT"}


def test_round_shapes():
    circle = tags((0, "CIRCLE"), (10, 5), (20, 5), (40, 2))
    arc = tags((0, "ARC"), (10, 0), (20, 0), (40, 1), (50, 270), (51, 90))
    bulge = tags((0, "LWPOLYLINE"), (70, 1), (10, 0), (20, 0), (42, 1), (10, 2), (20, 0), (42, 1))
    c, a, b = entities(drawing(circle + arc + bulge))
    assert len(c["points"]) == 33 and (round(c["cx"], 9), round(c["maxx"], 9)) == (5, 7)
    assert len(a["points"]) == 16 and 0.99 < a["maxx"] <= 1 and round(a["miny"], 9) == -1
    assert math.isclose(abs(dxf.area([(p["x"], p["y"]) for p in b["points"]])), math.pi, rel_tol=0.02)


def test_hatch_and_dimension():
    hatch = tags((0, "HATCH"), (2, "SOLID"), (70, 1), (91, 2), (92, 2), (93, 3), (10, 0), (20, 0), (10, 1), (20, 0), (10, 0), (20, 1), (97, 0), (92, 2), (93, 4), (10, 0), (20, 0), (10, 9), (20, 0), (10, 9), (20, 9), (10, 0), (20, 9), (97, 0))
    block = tags((0, "BLOCK"), (2, "*D1"), (10, 0), (20, 0)) + TEXT + tags((0, "ENDBLK"))
    dims = tags((0, "DIMENSION"), (8, "DIM"), (2, "*D1")) + tags((0, "DIMENSION"), (8, "DIM"), (2, "none"), (13, 0), (23, 0), (14, 4), (24, 0))
    h, t, line = entities(drawing(hatch + dims, blocks=block))
    assert h["maxx"] == 9 and t["props"]["from_dimension"] == line["props"]["from_dimension"] == "true" and line["maxx"] == 4


def test_scan_and_tables(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out, tmp_path = tmp_path / "out", tmp_path / "in"
    (tmp_path / "a.dxf").write_bytes(drawing(TEXT + tags((0, "LINE"), (8, "L"), (10, 0), (20, 0), (11, 3), (21, 4))))
    (tmp_path / "b.dxf").write_bytes("  0\nSECTION\n  2\nENTITIES\n  0\nTEXT\n  8\n벽\n 10\n1\n 20\n2\n  1\n기둥\n  0\nENDSEC\n".encode("cp949"))
    (tmp_path / "c.dxf").write_bytes(b"not a drawing")
    got = dxf.read(spark, str(tmp_path)).cache()
    assert {r["props"]["text"] for r in got.filter("entity_type = 'TEXT'").collect()} == {"D22 @200 600x400", "기둥"}
    assert {r.kind: r.n for r in store.statistics(got).groupBy("kind").agg(F.sum("n").alias("n")).collect()} == {"TEXT": 2, "LINE": 1}
    rows_ = store.entities_of(got, F.xxhash64("path"))
    store.write_partitioned(rows_, str(out))
    assert spark.read.parquet(str(out)).count() == 3
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.dxf").load(str(tmp_path))
    assert store.uploads(files).filter("name = 'a.dxf' and length(sha256) = 64").count() == 1


@pytest.mark.parametrize("raw,plain", [("a\\Pb", "a\nb"), ("{\\fArial|b0;x} %%c5%%d", "x ⌀5°"), ("\\S1^2; \\\\", "1/2 \\")])
def test_plain_text(raw, plain):
    assert dxf.plain_text(raw, "MTEXT") == plain


def as_binary(content):
    """The same drawing as a binary file."""
    import struct

    lines, out = content.decode().splitlines(), [dxf.BINARY]
    for code, value in zip(lines[::2], lines[1::2]):
        code = int(code)
        kind = next(k for low, high, k in dxf.VALUES if low <= code <= high)
        out.append(code.to_bytes(2, "little"))
        out.append(value.encode() + b"\0" if kind == "text" else struct.pack(kind, float(value) if kind == "<d" else int(value)))
    return b"".join(out)


def test_binary_files_read_as_text_ones():
    layers = tags((0, "LAYER"), (2, "벽체"), (70, 0), (62, -7))
    circle = tags((0, "CIRCLE"), (8, "벽체"), (62, 3), (10, 1.5), (20, 2), (40, 4))
    content = drawing(TEXT + circle, layers)
    assert rows(as_binary(content)) == rows(content) and len(entities(content)) == 2
    assert len(entities(as_binary(content)[:-40])) >= 1  # cut off


def test_splines_follow_their_curve():
    knots = tags(*((40, k) for k in (0, 0, 0, 0, 1, 1, 1, 1)))
    control = tags((10, 0), (20, 0), (10, 0), (20, 3), (10, 3), (20, 3), (10, 3), (20, 0))
    (only,) = entities(drawing(tags((0, "SPLINE"), (8, "0"), (71, 3)) + knots + control))
    points = [(p["x"], p["y"]) for p in only["points"]]
    assert points[0] == (0, 0) and points[-1] == (3, 0) and points[4] == pytest.approx((1.5, 2.25)) and len(points) == 9
    fit = tags((11, 1), (21, 1), (11, 2), (21, 2))
    (only,) = entities(drawing(tags((0, "SPLINE"), (8, "0"), (71, 3)) + knots + control + fit))
    assert [(p["x"], p["y"]) for p in only["points"]] == [(1, 1), (2, 2)]


def test_wipeouts_are_closed():
    clip = tags((0, "WIPEOUT"), (8, "0"), (10, 10), (20, 20), (11, 4), (21, 0), (12, 0), (22, 2), (14, -0.5), (24, -0.5), (14, 0.5), (24, 0.5))
    (only,) = entities(drawing(clip))
    assert [(p["x"], p["y"]) for p in only["points"]] == [(10, 22), (14, 22), (14, 20), (10, 20), (10, 22)]


def test_blocks_keep_their_members(spark):
    line = tags((0, "LINE"), (8, "0"), (10, 0), (20, 0), (11, 5), (21, 0))
    block = tags((0, "BLOCK"), (2, "B"), (10, 1), (20, 2)) + line + TEXT + tags((0, "ENDBLK"))
    insert = tags((0, "INSERT"), (8, "0"), (2, "B"), (10, 100), (20, 50), (41, 2))
    found = dxf.scan(spark.createDataFrame([("a.dxf", drawing(insert, blocks=block))], "path string, content binary"))
    blocks = store.blocks_of(found, F.lit(7))
    (b,) = blocks.collect()
    assert (b.commit_id, b.name, b.base_x, b.base_y, b.entity_count, [m.entity_type for m in b.members]) == (7, "B", 1.0, 2.0, 2, ["LINE", "TEXT"])
    from plinth.operators.spatial import block_shapes

    inserts = store.inserts_of(found, F.lit(7)).withColumn("block_def_id", F.lit(None).cast("long"))
    (shape,) = block_shapes(inserts, blocks).collect()
    assert [(p.x, p.y) for p in shape.points] == [(98.0, 48.0), (108.0, 48.0)]


def kinds(found, kind):
    return {r.get("entity_type"): r["n"] for r in found if r["row_kind"] == kind}


def test_damaged_text_files_give_what_is_sound():
    line = lambda x: tags((0, "LINE"), (8, "A"), (10, x), (20, 0), (11, x + 1), (21, 0))
    whole = drawing("".join(line(x) for x in range(4)))
    assert not kinds(rows(whole), "left") and len(entities(whole)) == 4
    lines = whole.decode().splitlines()
    at = lines.index("LINE", lines.index("LINE") + 1)  # the second line's kind
    lost = "\n".join(lines[: at + 3] + lines[at + 4 :]).encode()  # a group code is gone, so pairs are shifted
    found = rows(lost)
    ends = sorted(r["maxx"] for r in found if r["row_kind"] == "entity")
    assert {1, 3, 4} <= set(ends) and kinds(found, "left")[None] > 0
    noise = "\n".join(lines[: at + 1] + ["???", "garbage", "7"] + lines[at + 1 :]).encode()
    assert {1, 3, 4} <= {r["maxx"] for r in rows(noise) if r["row_kind"] == "entity"}
    cut = "\n".join(lines[: at + 4]).encode()
    assert [r["maxx"] for r in rows(cut) if r["row_kind"] == "entity"][:1] == [1]
    bad = drawing(line(0) + tags((0, "LWPOLYLINE"), (8, "A"), (10, "x"), (20, 0), (10, 1), (20, 1)) + line(5))
    found = rows(bad)
    assert kinds(found, "faulty") == {"LWPOLYLINE": 1} and sorted(r["maxx"] for r in found if r["row_kind"] == "entity") == [1, 6]


def test_damaged_binary_files_give_what_is_sound():
    line = lambda x: tags((0, "LINE"), (8, "A"), (10, x), (20, 0), (11, x + 1), (21, 0))
    whole = as_binary(drawing("".join(line(x) for x in range(4))))
    assert len(entities(whole)) == 4 and not kinds(rows(whole), "left")
    at = whole.index(b"LINE\0", whole.index(b"LINE\0") + 1)
    broken = whole[: at + 5] + b"\xf0\x7f\xf0\x7f" + whole[at + 5 :]
    found = rows(broken)
    assert {1, 3, 4} <= {r["maxx"] for r in found if r["row_kind"] == "entity"} and kinds(found, "left")[None] > 0
    cut = rows(whole[: at + 20])
    assert [r["maxx"] for r in cut if r["row_kind"] == "entity"][:1] == [1]
