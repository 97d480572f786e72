"""Fingerprints of entities: a SHA-256 prefix of canonical text. Coordinates are counted in steps of the tolerance, as
whole numbers, so no engine's way of printing doubles matters."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TOLERANCE = 1.0
ANGLE = 0.01


def steps(v: Column, tolerance: float = TOLERANCE) -> Column:
    return F.rint(v / tolerance).cast("long").cast("string")


def digest(*parts: Column) -> Column:
    """H2: the first 32 hex digits of the parts joined by bars; nulls are empty."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 32)


def _place(x: Column, y: Column, tolerance: float) -> Column:
    return F.concat_ws(",", steps(x, tolerance), steps(y, tolerance))


def line(x1: Column, y1: Column, x2: Column, y2: Column, layer: Column, color: Column, tolerance: float = TOLERANCE) -> Column:
    """H3: the same whichever end comes first."""
    ends = F.array_sort(F.array(F.struct(F.rint(x1 / tolerance).cast("long").alias("x"), F.rint(y1 / tolerance).cast("long").alias("y")), F.struct(F.rint(x2 / tolerance).cast("long").alias("x"), F.rint(y2 / tolerance).cast("long").alias("y"))))
    text = F.array_join(F.transform(ends, lambda p: F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string"))), ";")
    return digest(F.lit("LINE"), text, layer, F.coalesce(color, F.lit(0)))


def polyline(points: Column, closed: Column, layer: Column, color: Column, tolerance: float = TOLERANCE) -> Column:
    """H4: direction counts."""
    text = F.array_join(F.transform(points, lambda p: _place(p["x"], p["y"], tolerance)), ";")
    return digest(F.lit("POLYLINE"), closed, text, layer, F.coalesce(color, F.lit(0)))


def circle(x: Column, y: Column, r: Column, layer: Column, color: Column, tolerance: float = TOLERANCE) -> Column:
    return digest(F.lit("CIRCLE"), _place(x, y, tolerance), steps(r, tolerance), layer, F.coalesce(color, F.lit(0)))


def arc(x: Column, y: Column, r: Column, start: Column, end: Column, layer: Column, color: Column, tolerance: float = TOLERANCE) -> Column:
    return digest(F.lit("ARC"), _place(x, y, tolerance), steps(r, tolerance), steps(start, ANGLE), steps(end, ANGLE), layer, F.coalesce(color, F.lit(0)))


def text(x: Column, y: Column, content: Column, layer: Column, color: Column, tolerance: float = TOLERANCE) -> Column:
    return digest(F.lit("TEXT"), _place(x, y, tolerance), content, layer, F.coalesce(color, F.lit(0)))


def insert(block: Column, x: Column, y: Column, rotation: Column, sx: Column, sy: Column, layer: Column, color: Column, attributes: Column, tolerance: float = TOLERANCE) -> Column:
    """H5: attributes (array of struct(tag, value)) in the order of their tags."""
    pairs = F.array_join(F.transform(F.array_sort(attributes), lambda a: F.concat_ws("=", a["tag"], a["value"])), ";")
    return digest(F.lit("INSERT"), block, _place(x, y, tolerance), steps(rotation, ANGLE), steps(sx, ANGLE), steps(sy, ANGLE), layer, F.coalesce(color, F.lit(0)), pairs)
