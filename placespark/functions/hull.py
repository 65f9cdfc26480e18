"""Hull-based shapes, distances between geometries and validity of rings."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as PF
from pyspark.sql import types as T

from placespark.functions import exprs as F
from placespark.functions import geom as G


# Corners up to which plain numbers are faster than arrays.
_FEW = 24


def _hull(p: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise."""
    return np.array(_hull_points(p[:, 0], p[:, 1]))


def _hull_points(xs: np.ndarray, ys: np.ndarray) -> list[tuple[float, float]]:
    p = sorted(set(zip(xs.tolist(), ys.tolist())))
    if len(p) < 3:
        return p

    def half(order):
        chain = []
        for q in order:
            while len(chain) > 1:
                (ax, ay), (bx, by) = chain[-2], chain[-1]
                if (bx - ax) * (q[1] - by) - (by - ay) * (q[0] - bx) > 0:
                    break
                chain.pop()
            chain.append(q)
        return chain[:-1]

    return half(p) + half(p[::-1])


def _tightest_box(xs: np.ndarray, ys: np.ndarray) -> list[float]:
    hull = _hull_points(xs, ys)
    if len(hull) < 3:
        a, b = hull[0], hull[-1]
        return [a[0], a[1], b[0], b[1], b[0], b[1], a[0], a[1]]
    boxes = _boxes_of_few(hull) if len(hull) <= _FEW else _boxes(np.array(hull))
    # Take an axis-aligned or earlier side unless another is clearly tighter.
    limit = min((u1 - u0) * (v1 - v0) for _, _, u0, u1, v0, v1 in boxes) * (1 + 1e-12)
    x, y, u0, u1, v0, v1 = next(b for b in boxes if (b[3] - b[2]) * (b[5] - b[4]) <= limit)
    return [float(c) for a, b in ((u0, v0), (u1, v0), (u1, v1), (u0, v1)) for c in (a * x + b * -y, a * y + b * x)]


def _boxes_of_few(hull: list[tuple[float, float]]) -> list[tuple]:
    """For each side its direction (x, y) and the extent of the hull along and across it."""
    boxes = []
    for (ax, ay), (bx, by) in zip(hull, hull[1:] + hull[:1]):
        dx, dy = bx - ax, by - ay
        size = math.hypot(dx, dy)
        x, y = dx / size, dy / size
        u, v = [px * x + py * y for px, py in hull], [px * -y + py * x for px, py in hull]
        boxes.append((x, y, min(u), max(u), min(v), max(v)))
    return boxes


def _boxes(hull: np.ndarray) -> list[tuple]:
    """As ``_boxes_of_few``."""
    sides = np.roll(hull, -1, axis=0) - hull
    along = sides / np.hypot(sides[:, 0], sides[:, 1])[:, None]
    across = np.column_stack([-along[:, 1], along[:, 0]])
    u, v = hull @ along.T, hull @ across.T
    return list(zip(along[:, 0], along[:, 1], u.min(0), u.max(0), v.min(0), v.max(0)))


@PF.pandas_udf(T.ArrayType(T.DoubleType()))
def _oriented_corners(xs: pd.Series, ys: pd.Series) -> pd.Series:
    return pd.Series([_tightest_box(x, y) for x, y in zip(xs, ys)])


def _xs(g: Column) -> Column:
    return F.transform(G.points(g), lambda p: p["x"])


def _ys(g: Column) -> Column:
    return F.transform(G.points(g), lambda p: p["y"])


def oriented_envelope(g: Column) -> Column:
    """Rectangle of least area around a geometry, at any angle."""
    corners = _oriented_corners(_xs(g), _ys(g))
    return PF.element_at(PF.transform(PF.array(corners), lambda c: _rectangle(c)), 1)


def _rectangle(c: Column) -> Column:
    """Polygon of four corners given as eight numbers."""
    ring = [PF.struct(PF.get(c, PF.lit(i)).alias("x"), PF.get(c, PF.lit(i + 1)).alias("y")) for i in (0, 2, 4, 6, 0)]
    return PF.struct(PF.lit("Polygon").alias("kind"), PF.array(PF.array(PF.array(*ring))).alias("parts"))


def _least_circle(p: np.ndarray) -> list[float]:
    """Smallest circle: grow it over hull corners, re-seating it on one, two or three of them."""
    hull = _hull(p)

    def of(*q):
        if len(q) == 1:
            return q[0], 0.0
        if len(q) == 2:
            return (q[0] + q[1]) / 2, float(np.hypot(*(q[1] - q[0]))) / 2
        m = 2 * np.array([q[1] - q[0], q[2] - q[0]])
        c = np.linalg.solve(m, np.array([q[1] @ q[1] - q[0] @ q[0], q[2] @ q[2] - q[0] @ q[0]]))
        return c, float(np.hypot(*(q[0] - c)))

    def outside(circle, q):
        return np.hypot(*(q - circle[0])) > circle[1] * (1 + 1e-12) + 1e-12

    best = of(hull[0])
    for i, a in enumerate(hull):
        if outside(best, a):
            best = of(a)
            for j, b in enumerate(hull[:i]):
                if outside(best, b):
                    best = of(a, b)
                    for c in hull[:j]:
                        if outside(best, c):
                            best = of(a, b, c)
    return [float(best[0][0]), float(best[0][1]), best[1]]


@PF.pandas_udf(T.ArrayType(T.DoubleType()))
def _circle(xs: pd.Series, ys: pd.Series) -> pd.Series:
    return pd.Series([_least_circle(np.column_stack([x, y])) for x, y in zip(xs, ys)])


def bounding_circle(g: Column) -> Column:
    """struct(cx, cy, r) of the smallest circle around all points; closed form for a two-point line."""
    general = PF.element_at(
        PF.transform(
            PF.array(_circle(_xs(g), _ys(g))),
            lambda c: PF.struct(
                PF.get(c, PF.lit(0)).alias("cx"), PF.get(c, PF.lit(1)).alias("cy"), PF.get(c, PF.lit(2)).alias("r")
            ),
        ),
        1,
    )
    return PF.when(G.num_points(g) == 2, G.bounding_circle_of_diagonal(g)).otherwise(general)


# ---- distances -------------------------------------------------------------------------------


def _segments(g: Column) -> Column:
    return F.flatten(F.transform(G.lines(g), G.segments))


def _steps(g: Column) -> Column:
    """Segments of g with what does not depend on a point next to them."""

    def step(s):
        dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
        return F.struct(
            s["a"]["x"].alias("x"), s["a"]["y"].alias("y"), dx.alias("dx"), dy.alias("dy"), F.nullif(dx * dx + dy * dy, F.lit(0.0)).alias("n")
        )

    return F.transform(_segments(g), step)


def _to_step(s: Column, p: Column) -> Column:
    """Distance of a point to a segment, as that of ``G.closest_on_segment``."""
    t = F.least(F.greatest(F.coalesce(((p["x"] - s["x"]) * s["dx"] + (p["y"] - s["y"]) * s["dy"]) / s["n"], F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return F.let(t, lambda t: F.hypot(s["x"] + t * s["dx"] - p["x"], s["y"] + t * s["dy"] - p["y"]))


def _to_outline(p: Column, steps: Column, points: Column) -> Column:
    """Distance of a point to the lines or points of a geometry."""
    to_lines = F.array_min(F.transform(steps, lambda s: _to_step(s, p)))
    return F.coalesce(to_lines, F.array_min(F.transform(points, lambda q: G.distance_points(p, q))))


def _to_outlines(a: Column, b: Column, pick) -> Column:
    """pick(distances of a's points to b, those of b's to a); points and segments are taken once for each pair."""
    both = F.struct(G.points(a).alias("p"), _steps(a).alias("s"), G.points(b).alias("q"), _steps(b).alias("t"))
    return F.let(
        both,
        lambda k: pick(
            F.transform(k["p"], lambda p: _to_outline(p, k["t"], k["q"])), F.transform(k["q"], lambda q: _to_outline(q, k["s"], k["p"]))
        ),
    )


def _edges_cross(a: Column, b: Column) -> Column:
    def side(s, p):
        return (s["b"]["x"] - s["a"]["x"]) * (p["y"] - s["a"]["y"]) - (s["b"]["y"] - s["a"]["y"]) * (p["x"] - s["a"]["x"])

    return F.let(
        F.struct(_segments(a).alias("a"), _segments(b).alias("b")),
        lambda k: F.exists(
            k["a"],
            lambda s: F.exists(
                k["b"],
                lambda t: (side(s, t["a"]) * side(s, t["b"]) < 0) & (side(t, s["a"]) * side(t, s["b"]) < 0),
            ),
        ),
    )


def _boxes_meet(a: Column, b: Column) -> Column:
    return F.let(
        F.struct(G.bounds(a).alias("a"), G.bounds(b).alias("b")),
        lambda s: (s["a"]["xmin"] <= s["b"]["xmax"])
        & (s["b"]["xmin"] <= s["a"]["xmax"])
        & (s["a"]["ymin"] <= s["b"]["ymax"])
        & (s["b"]["ymin"] <= s["a"]["ymax"]),
    )


def _outline_distance(a: Column, b: Column) -> Column:
    return _to_outlines(a, b, lambda x, y: F.least(F.array_min(x), F.array_min(y)))


def _overlap_surely(a: Column, b: Column) -> Column:
    return _boxes_meet(a, b) & (
        _edges_cross(a, b)
        | G.contains_point(a, F.element_at(G.points(b), 1))
        | G.contains_point(b, F.element_at(G.points(a), 1))
    )


def distance(a: Column, b: Column) -> Column:
    """Least distance between two geometries, 0 when they meet."""
    return F.when(_overlap_surely(a, b), F.lit(0.0)).otherwise(_outline_distance(a, b))


def intersects(a: Column, b: Column) -> Column:
    """Do two geometries share a point? Boxes first, then crossings and containment, then touching."""
    return _boxes_meet(a, b) & (_overlap_surely(a, b) | (_outline_distance(a, b) == 0))


def max_distance(a: Column, b: Column) -> Column:
    """Largest distance between points of two geometries, reached at corners."""
    return F.array_max(
        F.transform(G.points(a), lambda p: F.array_max(F.transform(G.points(b), lambda q: G.distance_points(p, q))))
    )


def hausdorff_distance(a: Column, b: Column) -> Column:
    """Largest distance of a corner of one geometry to the outline of the other, both ways."""
    return _to_outlines(a, b, lambda x, y: F.greatest(F.array_max(x), F.array_max(y)))


def simplify_grid(g: Column, segments: int = 2) -> Column:
    """Array of struct(i, j, source, target): grid points of the envelope and the nearest points of g."""
    cells = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.lit(segments)),
            lambda i: F.transform(
                F.sequence(F.lit(0), F.lit(segments)), lambda j: F.struct(i.alias("i"), j.alias("j"))
            ),
        )
    )
    return F.let(
        G.bounds(g),
        lambda b: F.transform(
            cells,
            lambda c: F.let(
                G.xy(
                    b["xmin"] + (b["xmax"] - b["xmin"]) * c["i"] / segments,
                    b["ymin"] + (b["ymax"] - b["ymin"]) * c["j"] / segments,
                ),
                lambda p: F.struct(c["i"].alias("i"), c["j"].alias("j"), p.alias("source"), G.closest_point(g, p).alias("target")),
            ),
        ),
    )


# ---- validity --------------------------------------------------------------------------------


def simple_rings(df: DataFrame, key: str, cell: float) -> DataFrame:
    """Is every ring of ``geom`` closed, of four points or more and free of self-crossings?

    Edges of a geometry meet in square cells, so only edges near each other are compared. Cells are many for each geometry,
    whose file size tells nothing of them, so they are not broadcast."""
    shaped = df.select(
        key,
        "geom",
        F.forall(G.lines(F.col("geom")), lambda r: (F.size(r) >= 4) & (F.element_at(r, 1) == F.element_at(r, -1))).alias("_formed"),
    )
    edge = shaped.select(key, F.posexplode(_segments(F.col("geom"))).alias("n", "s"))
    spread = (
        edge.withColumn("cx", F.explode(F.sequence(F.floor(F.least("s.a.x", "s.b.x") / cell), F.floor(F.greatest("s.a.x", "s.b.x") / cell))))
        .withColumn("cy", F.explode(F.sequence(F.floor(F.least("s.a.y", "s.b.y") / cell), F.floor(F.greatest("s.a.y", "s.b.y") / cell))))
    )
    other = spread.select(key, "cx", "cy", F.col("n").alias("m"), F.col("s").alias("t"))

    def side(s, p):
        return (F.col(f"{s}.b.x") - F.col(f"{s}.a.x")) * (F.col(f"{p}.y") - F.col(f"{s}.a.y")) - (
            F.col(f"{s}.b.y") - F.col(f"{s}.a.y")
        ) * (F.col(f"{p}.x") - F.col(f"{s}.a.x"))

    crossing = (
        spread.join(other.hint("merge"), [key, "cx", "cy"])
        .where("n < m")
        .where((side("s", "t.a") * side("s", "t.b") < 0) & (side("t", "s.a") * side("t", "s.b") < 0))
    )
    crossed = crossing.groupBy(key).agg(F.lit(True).alias("_crossed"))
    return shaped.join(crossed, key, "left").select(
        key, (F.col("_formed") & F.col("_crossed").isNull()).alias("simple")
    )
