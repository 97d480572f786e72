"""Filters, joins, aggregates and listings over drawings' tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from plinth.functions import patterns as P
from plinth.functions.signals import stripped
from plinth.session import spare

Box = tuple[float, float, float, float]


@dataclass(frozen=True)
class Selection:
    """What a text scan takes (F1, F5, F6): boxes win over the single box; layers are full, case-insensitive patterns, and
    exclusion wins."""

    box: Box | None = None
    boxes: Sequence[Box] = ()
    include_layers: Sequence[str] = ()
    exclude_layers: Sequence[str] = ()
    keep_empty: bool = False


def normalized(box: Box) -> Box:
    """least and greatest corners."""
    a, b, c, d = box
    return min(a, c), min(b, d), max(a, c), max(b, d)


def parsed_boxes(raw: object) -> list[Box]:
    """boxes of four numbers; anything else in the list is skipped."""
    out = []
    for item in raw if isinstance(raw, (list, tuple)) else ():
        try:
            a, b, c, d = (float(v) for v in item)
        except (TypeError, ValueError):
            continue
        out.append(normalized((a, b, c, d)))
    return out


def in_box(x: Column, y: Column, box: Box) -> Column:
    """closed on all sides."""
    x0, y0, x1, y1 = normalized(box)
    return x.between(x0, x1) & y.between(y0, y1)


def selected(x: Column, y: Column, selection: Selection) -> Column:
    """in one of the boxes, else in the single box, else everywhere."""
    if selection.boxes:
        out = F.lit(False)
        for box in selection.boxes:
            out = out | in_box(x, y, box)
        return out
    return in_box(x, y, selection.box) if selection.box else F.lit(True)


def layer_ok(layer: Column, selection: Selection) -> Column:
    """null is the empty layer."""
    name = F.trim(F.coalesce(layer, F.lit("")))
    some = lambda ps: F.lit(False) if not ps else name.rlike("(?i)^(?:" + "|".join(f"(?:{p})" for p in ps) + ")$")
    kept = ~some(selection.exclude_layers)
    return kept & some(selection.include_layers) if selection.include_layers else kept


def text_items(entities: DataFrame, selection: Selection = Selection()) -> DataFrame:
    """Text entities with a place, a layer that is asked for and, unless kept, a text. The type and the boxes are plain
    predicates on columns, so they reach the scan."""
    text = stripped(F.col("text"))
    out = entities.filter(F.col("entity_type").isin(P.TEXT_TYPES) & F.col("x").isNotNull() & F.col("y").isNotNull() & selected(F.col("x"), F.col("y"), selection) & layer_ok(F.col("layer"), selection))
    out = out.withColumn("text", text)
    return out if selection.keep_empty else out.filter(F.col("text") != "")


def near(entities: DataFrame, x: float, y: float, radius: float, limit: int = 50) -> DataFrame:
    """Simple shapes within a radius, by id; the box around the circle reaches the scan."""
    box = F.col("x").between(x - radius, x + radius) & F.col("y").between(y - radius, y + radius)
    return entities.filter(box & (F.hypot(F.col("x") - x, F.col("y") - y) <= radius)).orderBy("id").limit(limit)


def first_place(items: DataFrame) -> DataFrame:
    """Place of the text with the least id in each drawing; zeros for a missing coordinate."""
    first = items.groupBy("commit_id").agg(F.min(F.struct("id", "x", "y")).alias("f"))
    return first.select("commit_id", F.coalesce("f.x", F.lit(0.0)).alias("x"), F.coalesce("f.y", F.lit(0.0)).alias("y"))


def diagnostics(entities: DataFrame) -> DataFrame:
    """A1-A3: entities of each drawing and type, and how many have a place."""
    return entities.groupBy("commit_id", "entity_type").agg(F.count("*").alias("n"), F.count("x").alias("with_place"))


def layers_index(entities: DataFrame) -> DataFrame:
    """A4: entities of each layer; null is layer 0."""
    return entities.groupBy("commit_id", F.coalesce("layer", F.lit("0")).alias("layer")).agg(F.count("*").alias("n"))


def bounds(shapes: DataFrame) -> DataFrame:
    """Each drawing's extent; (0, 0, 1, 1) where nothing has one."""
    agg = shapes.groupBy("commit_id").agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))
    return agg.na.fill({"minx": 0.0, "miny": 0.0, "maxx": 1.0, "maxy": 1.0})


def duplicates(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    """All rows of a key but its first; null keys have no duplicates."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    some = F.lit(True)
    for c in cols:
        some = some & c.isNotNull()
    w = Window.partitionBy(*cols).orderBy(*order)
    held = spare(df, "nth")
    return df.filter(some).withColumn(held, F.row_number().over(w)).filter(F.col(held) > 1).drop(held)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key."""
    held = spare(df, "nth")
    return df.withColumn(held, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(held) == 1).drop(held)


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """O2: the first n rows of each key."""
    held = spare(df, "nth")
    return df.withColumn(held, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(held) <= n).drop(held)


def looked_up(left: DataFrame, right: DataFrame, by_id: tuple[str, str], by_name: tuple[str, str], value: str) -> DataFrame:
    """A right-hand value by id, else by name (the first id of that name)."""
    ids = right.select(F.col(by_id[1]).alias("_id"), F.col(value).alias("_by_id"))
    names = right.groupBy(F.col(by_name[1]).alias("_name")).agg(F.min_by(value, by_id[1]).alias("_by_name"))
    out = left.join(ids, left[by_id[0]] == F.col("_id"), "left").join(names, left[by_name[0]] == F.col("_name"), "left")
    return out.withColumn(value, F.coalesce("_by_id", "_by_name")).drop("_id", "_name", "_by_id", "_by_name")


def without(tables: dict[str, DataFrame], gone: DataFrame, keys: dict[str, str]) -> dict[str, DataFrame]:
    """Tables without the rows whose key is among ``gone`` (one column)."""
    name = gone.columns[0]
    return {k: df.join(gone.select(F.col(name).alias("_gone")), df[keys[k]] == F.col("_gone"), "left_anti") if k in keys else df for k, df in tables.items()}


def orphaned(commits: DataFrame, gone: DataFrame, parent: str = "parent_commit_id") -> DataFrame:
    """A reference to a row that is gone is null."""
    name = gone.columns[0]
    out = commits.join(gone.select(F.col(name).alias("_gone")).distinct(), commits[parent] == F.col("_gone"), "left")
    return out.withColumn(parent, F.when(F.col("_gone").isNull(), F.col(parent))).drop("_gone")


def merged_settings(old: Column, new: Column, deep: str = "sub_tags") -> Column:
    """A shallow merge of two maps of JSON texts, the new one's keys winning; under ``deep`` the two objects are merged
    one level further."""
    as_map = lambda c: F.coalesce(F.from_json(F.try_element_at(c, F.lit(deep)), "map<string,string>"), F.create_map().cast("map<string,string>"))
    union = lambda a, b: F.map_from_entries(F.concat(F.filter(F.map_entries(a), lambda e: ~F.map_contains_key(b, e["key"])), F.map_entries(b)))
    both = F.map_contains_key(old, deep) & F.map_contains_key(new, deep)
    flat = union(old, new)
    nested = F.create_map(F.lit(deep), F.to_json(union(as_map(old), as_map(new))))
    return F.when(both, union(flat, nested)).otherwise(flat)
