"""Groups of geometries: extents, the largest one, references and combined shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placespark.functions import exprs as E
from placespark.functions import geom as G
from placespark.operators import regions as R


def _boxes(df: DataFrame) -> DataFrame:
    return df.withColumn("_b", G.bounds(E.col("geom")))


def extent(df: DataFrame, group: list[str]) -> DataFrame:
    """Common envelope of each group."""
    return _boxes(df).groupBy(*group).agg(
        F.min("_b.xmin").alias("xmin"), F.min("_b.ymin").alias("ymin"), F.max("_b.xmax").alias("xmax"), F.max("_b.ymax").alias("ymax")
    )


def bounds(df: DataFrame, group: list[str], squared: bool = True) -> DataFrame:
    """Extent of a group; squared: the box around the circle on its diagonal."""
    found = extent(df, group)
    if not squared:
        return found
    r = F.hypot(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")) / 2
    cx, cy = (F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2
    return found.select(*group, (cx - r).alias("xmin"), (cy - r).alias("ymin"), (cx + r).alias("xmax"), (cy + r).alias("ymax"))


def padded_to_square(extents: DataFrame, group: list[str]) -> DataFrame:
    """The shorter side of each extent padded to the longer one."""
    dx, dy = F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    side = F.greatest(dx, dy)
    px, py = (side - dx) / 2, (side - dy) / 2
    return extents.select(
        *group, (F.col("xmin") - px).alias("xmin"), (F.col("ymin") - py).alias("ymin"), (F.col("xmax") + px).alias("xmax"), (F.col("ymax") + py).alias("ymax")
    )


def largest(df: DataFrame, group: str, key: str) -> DataFrame:
    """Member of most area per group, the first of equals; groups without any area have none."""
    sized = df.select(group, key, G.area(E.col("geom")).alias("area")).where("area > 0")
    return sized.groupBy(group).agg(
        F.max_by(key, F.struct(F.col("area"), -F.col(key))).alias(key), F.max("area").alias("area")
    )


def limit_to_inner(df: DataFrame, group: str, key: str) -> DataFrame:
    """Cut the largest member down to the extent of the others where it encloses all of them.

    Nothing changes in groups whose other members are all points."""
    top = largest(df, group, key).select(group, F.col(key).alias("_top"))
    marked = _boxes(df).join(top, group, "left").withColumn("_is_top", F.coalesce(F.col(key) == F.col("_top"), F.lit(False)))
    others = marked.where(~F.col("_is_top")).groupBy(group).agg(
        F.min("_b.xmin").alias("_x0"), F.min("_b.ymin").alias("_y0"), F.max("_b.xmax").alias("_x1"), F.max("_b.ymax").alias("_y1"),
        F.min(F.col("geom.kind") == "Point").alias("_points_only"),
    )
    joined = marked.join(others, group, "left")
    encloses = F.expr("_is_top AND NOT _points_only AND _x0 >= _b.xmin AND _x1 <= _b.xmax AND _y0 >= _b.ymin AND _y1 <= _b.ymax")
    rest = G.envelope(G.geometry("MultiPoint", E.expr("array(array(array(named_struct('x', _x0, 'y', _y0), named_struct('x', _x1, 'y', _y1))))")))
    return joined.select(group, key, F.when(encloses, rest).otherwise(F.col("geom")).alias("geom"))


def pick_reference(g: Column) -> Column:
    """Parts with more than a tenth of the points: one polygon as it is, otherwise their envelope."""
    kept = E.let(
        G.num_points(g),
        lambda n: E.filter(g["parts"], lambda part: E.size(E.flatten(part)) / n > 0.1),
    )

    def choose(parts):
        ring = parts[0][0]
        single = (E.size(parts) == 1) & (E.size(ring) > 3) & (E.element_at(ring, 1) == E.element_at(ring, -1))
        whole = G.geometry("MultiPolygon", parts)
        return E.when(single, G.geometry("Polygon", parts)).otherwise(G.envelope(whole))

    return E.let(kept, choose)


def combine(members: DataFrame, shapes: DataFrame, group: list[str], key: str) -> DataFrame:
    """One shape of a group as it is, several as their intersection, or all of them when that is empty."""
    counts = members.join(shapes.select(key, G.area(E.col("geom")).alias("_area")), key).groupBy(*group).agg(
        F.count(F.lit(1)).alias("inputs"), F.sum("_area").alias("parts_area")
    )
    common = R.areas(R.common(R.member_edges(members, shapes, key), group, key), group)
    joined = counts.join(common, group, "left").withColumn("area", F.coalesce("area", F.lit(0.0)))
    empty = F.col("area") == 0
    form = F.when(empty, "collection").when(F.col("inputs") == 1, "single").otherwise("intersection")
    return joined.select(*group, "inputs", form.alias("form"), F.when(empty, F.col("parts_area")).otherwise(F.col("area")).alias("area"))
