"""Cells touched by geometries, unions of cell values, and cells back to areas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placespark.operators import overlay as O


def rasterize_touched(df: DataFrame, group: list[str], cell: float) -> DataFrame:
    """(group, xi, yi) of every square cell whose inside a geometry meets.

    Inner cells come from scanlines through cell middles, border cells from the pieces of each edge
    in each row of cells; the work grows with the cells covered, not with cells times edges."""
    rows = O.outline_segments(df).withColumns({"_lo": F.least("y1", "y2"), "_hi": F.greatest("y1", "y2")})
    first, last = F.floor(F.col("_lo") / cell), F.ceil(F.col("_hi") / cell) - 1
    inner_level = (F.col("_lo") == F.col("_hi")) & (F.col("_lo") != first * cell)
    pieces = rows.withColumn(
        "yi", F.explode(F.when(first <= last, F.sequence(first, last)).when(inner_level, F.array(first)))
    )
    slope = (F.col("x2") - F.col("x1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))
    at = lambda y: F.coalesce(F.col("x1") + (y - F.col("y1")) * slope, F.col("x1"))
    low, high = F.greatest("_lo", F.col("yi") * cell), F.least("_hi", (F.col("yi") + 1) * cell)
    level = F.col("_lo") == F.col("_hi")
    xa = F.when(level, F.least("x1", "x2")).otherwise(F.least(at(low), at(high)))
    xb = F.when(level, F.greatest("x1", "x2")).otherwise(F.greatest(at(low), at(high)))
    c0, c1 = F.floor(F.col("_xa") / cell), F.ceil(F.col("_xb") / cell) - 1
    upright_inside = (F.col("_xa") == F.col("_xb")) & (F.col("_xa") != c0 * cell)
    border = pieces.withColumns({"_xa": xa, "_xb": xb}).select(
        *group, "yi", F.explode(F.when(c0 <= c1, F.sequence(c0, c1)).when(upright_inside, F.array(c0))).alias("xi")
    )
    runs = O.runs_of(df, group, cell, {"all": F.lit(True)}).where("n_all > 0")
    i0, i1 = O.row_of(F.col("x0"), cell), O.row_of(F.col("x1"), cell) - 1
    inside = runs.where(i0 <= i1).select(*group, F.col("row").alias("yi"), F.explode(F.sequence(i0, i1)).alias("xi"))
    return border.select(*group, "xi", "yi").unionByName(inside.select(*group, "xi", "yi")).distinct()


def union_max(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Largest value per cell."""
    return cells.groupBy(*keys, "xi", "yi").agg(F.max("v").alias("v"))


def cells_area(cells: DataFrame, group: list[str], cell: float, threshold: float = 0.5) -> DataFrame:
    """Area of the union of the squares of all cells above the threshold."""
    squares = cells.where(F.col("v") > threshold).select(
        *group, F.col("yi").alias("row"), (F.col("xi") * cell).alias("x0"), ((F.col("xi") + 1) * cell).alias("x1")
    )
    events = O.slot_events(O.span_events(squares), group, {"all": F.lit(True)})
    runs = O.sweep(events, group, ["all"]).where("n_all > 0")
    return O.span_area(runs, group, cell)
