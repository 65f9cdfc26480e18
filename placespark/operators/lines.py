"""Lines joined at shared ends, and closed lines as polygons."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placespark.functions import exprs as E
from placespark.functions import geom as G
from placespark.schema import LINE


def _joined(lines: list[list[tuple[float, float]]]) -> list[list[tuple[float, float]]]:
    """Lines of one object, joined where exactly two ends meet."""
    ends: dict[tuple[float, float], list[int]] = {}
    for i, line in enumerate(lines):
        if line[0] != line[-1]:
            for p in (line[0], line[-1]):
                ends.setdefault(p, []).append(i)
    open_ends = {p: ids for p, ids in ends.items() if len(ids) == 2}
    used, out = set(), []

    def walk(i, start):
        chain = list(lines[i]) if lines[i][0] == start else list(reversed(lines[i]))
        used.add(i)
        while chain[-1] in open_ends and chain[-1] != chain[0]:
            following = [j for j in open_ends[chain[-1]] if j not in used]
            if not following:
                break
            j = following[0]
            used.add(j)
            chain += lines[j][1:] if lines[j][0] == chain[-1] else list(reversed(lines[j]))[1:]
        return chain

    order = [(i, p) for i, line in enumerate(lines) for p in (line[0], line[-1]) if p not in open_ends]
    for i, start in [*order, *((i, line[0]) for i, line in enumerate(lines))]:
        if i not in used:
            out.append(walk(i, start))
    return out


def merge_ways(df: DataFrame, key: str) -> DataFrame:
    """(key, line) rows -> lines joined end to end at points where two lines meet.

    The ways of one mapped object come together in one task; they are the pieces of one geometry."""
    schema = T.StructType([df.schema[key], T.StructField("line", LINE)])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        lines = [[(p["x"], p["y"]) for p in line] for line in group["line"]]
        merged = [[{"x": x, "y": y} for x, y in line] for line in _joined(lines)]
        return pd.DataFrame({key: [group[key].iloc[0]] * len(merged), "line": merged})

    return df.select(key, "line").groupBy(key).applyInPandas(merge, schema)


def polygonize(df: DataFrame, key: str) -> DataFrame:
    """(key, line) rows -> (key, geom): merged lines, the closed ones as polygons."""
    merged = merge_ways(df, key)
    line = E.col("line")
    closed = E.element_at(line, 1) == E.element_at(line, -1)
    return merged.select(key, E.when(closed, G.make_polygon(line)).otherwise(G.make_line(line)).alias("geom"))
