"""Pens and colours of entities, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BACKGROUND = "#e0e0e0"


def value_pen(value: Column) -> Column:
    """V3: a pen of a number above 0 or of ``#rrggbb``, else null."""
    hexed = F.conv(F.regexp_extract(value, r"^\s*#([0-9A-Fa-f]{6})", 1), 16, 10).try_cast("long")
    n = F.trim(value).try_cast("long")
    return F.when(value.rlike(r"^\s*#[0-9A-Fa-f]{6}"), hexed).when(n >= 1, n)


def entity_pen(color: Column, raw: Column, true_color: Column, layer_pen: Column) -> Column:
    """V1: true colour; else the layer's pen (7 without one) for 256; else the raw colour; else the entity's; else 7."""
    by_layer = F.coalesce((raw == 256) | (color == 256), raw == 256, color == 256, F.lit(False))
    return (
        F.when(true_color > 255, true_color)
        .when(by_layer, F.coalesce(layer_pen, F.lit(7)))
        .when(raw >= 1, raw)
        .when((raw == 0) & (color == 0), 0)
        .otherwise(F.coalesce(color, F.lit(7)))
        .cast("long")
    )


def packed_css(pen: Column) -> Column:
    """V2: ``#rrggbb`` of a packed colour."""
    return F.concat(F.lit("#"), F.lpad(F.lower(F.hex(pen.cast("long").bitwiseAND(0xFFFFFF))), 6, "0"))


def pen_css(pen: Column, palette: Column) -> Column:
    """V2: the background for 0 and 256, packed colours above 255, else the palette's (a map pen -> css; 7 where unknown)."""
    return F.when(pen.isin(0, 256), BACKGROUND).when(pen > 255, packed_css(pen)).otherwise(F.coalesce(F.try_element_at(palette, pen.cast("int")), F.try_element_at(palette, F.lit(7))))


def line_pixels(weight: Column) -> Column:
    """V5: a line's width in pixels; null below 0."""
    return F.when(weight >= 0, F.greatest(F.lit(0.55), F.least(F.lit(6.5), F.lit(0.55) + weight / 45)))
