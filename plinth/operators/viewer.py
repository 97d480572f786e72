"""The drawable preview of a drawing: labels, vectors, bounds and indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plinth.functions import colors
from plinth.functions.signals import layer_key
from plinth.operators.relational import first_n

MOST = 50_000_000
LABEL_TYPES = ["TEXT", "MTEXT", "ATTRIB"]


def capped(entities: DataFrame, limit: int | None) -> DataFrame:
    """the first entities of each drawing by id; all of them for no limit or one of 0 or less."""
    return entities if not limit or limit <= 0 else first_n(entities, ["commit_id"], [F.col("id")], min(limit, MOST))


def layer_pens(layers: DataFrame) -> DataFrame:
    """V4: (commit_id, layer, key, pen): the pen of each layer by its name, and by its normalized key (the first by name)."""
    return layers.select("commit_id", "layer", layer_key(F.col("layer")).alias("key"), colors.value_pen(F.col("color").cast("string")).alias("pen")).filter("pen is not null")


def with_pens(entities: DataFrame, layers: DataFrame) -> DataFrame:
    """V1, V4: entities (color, color_raw, true_color, layer) with their pen. Layers are joined by exact name, else by key."""
    pens = layer_pens(layers)
    exact = pens.groupBy("commit_id", F.col("layer").alias("_layer")).agg(F.min("pen").alias("_exact"))
    loose = pens.groupBy("commit_id", F.col("key").alias("_key")).agg(F.min_by("pen", "layer").alias("_loose"))
    name = F.coalesce(F.nullif(F.trim("layer"), F.lit("")), F.lit("0"))
    out = entities.withColumn("_layer", name).withColumn("_key", layer_key(name)).join(exact, ["commit_id", "_layer"], "left").join(loose, ["commit_id", "_key"], "left")
    pen = colors.entity_pen(F.col("color"), F.col("color_raw"), F.col("true_color"), F.coalesce("_exact", "_loose"))
    return out.withColumn("pen", pen).drop("_layer", "_key", "_exact", "_loose")


def label_height(kind: Column, height: Column, char_height: Column) -> Column:
    """V7: MTEXT prefers its character height; not above 0 is none."""
    h = F.when(kind == "MTEXT", F.coalesce(char_height, height)).otherwise(F.coalesce(height, char_height))
    return F.when((h > 0) & ~F.isnan(h) & (F.abs(h) != float("inf")), h)


def labels(entities: DataFrame) -> DataFrame:
    """V8: texts at their alignment point, cut to 500 characters, with a box padded by 0.6 of their height, 2 at least."""
    own = entities.filter(F.col("entity_type").isin(LABEL_TYPES) & (F.trim("text") != ""))
    x, y = F.coalesce("text_align_x", "cx"), F.coalesce("text_align_y", "cy")
    height = label_height(F.col("entity_type"), F.col("height"), F.col("char_height"))
    pad = F.greatest(F.lit(2.0), F.coalesce(height, F.lit(0.0)) * 0.6)
    return own.select("commit_id", "id", "layer", "pen", F.substring("text", 1, 500).alias("text"), x.alias("x"), y.alias("y"), height.alias("height"), (x - pad).alias("minx"), (y - pad).alias("miny"), (x + pad).alias("maxx"), (y + pad).alias("maxy"))


def vectors(entities: DataFrame) -> DataFrame:
    """Shapes to draw: a dot of one point, a fill of hatches and wipeouts, else a line."""
    kind = F.when(F.size("points") == 1, "dot").when(F.col("entity_type").isin("HATCH", "WIPEOUT", "POLYGON"), "fill").otherwise("line")
    own = entities.filter(~F.col("entity_type").isin(LABEL_TYPES) & (F.size("points") >= 1))
    return own.select("commit_id", "id", "layer", "pen", kind.alias("kind"), "points", colors.line_pixels(F.col("lineweight")).alias("width"), "minx", "miny", "maxx", "maxy")


def bounds(*parts: DataFrame) -> DataFrame:
    """A6 over labels and vectors; non-finite coordinates don't count, and nothing at all spans (0, 0, 1, 1)."""
    boxes = parts[0].select("commit_id", "minx", "miny", "maxx", "maxy")
    for p in parts[1:]:
        boxes = boxes.union(p.select("commit_id", "minx", "miny", "maxx", "maxy"))
    sane = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c))
    out = boxes.groupBy("commit_id").agg(F.min(sane("minx")).alias("minx"), F.min(sane("miny")).alias("miny"), F.max(sane("maxx")).alias("maxx"), F.max(sane("maxy")).alias("maxy"))
    return out.na.fill({"minx": 0.0, "miny": 0.0, "maxx": 1.0, "maxy": 1.0})


def preview(entities: DataFrame, layers: DataFrame, limit: int | None = None) -> dict[str, DataFrame]:
    """V8: labels, vectors and bounds of the first entities, and the layers' index of all."""
    drawn = with_pens(capped(entities, limit), layers)
    own, shapes = labels(drawn), vectors(drawn)
    index = entities.groupBy("commit_id", F.coalesce("layer", F.lit("0")).alias("layer")).agg(F.count("*").alias("n"))
    return {"labels": own, "vectors": shapes, "bounds": bounds(own, shapes), "layers": index}
