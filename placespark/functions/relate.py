"""Relation matrix of two areas, from the pieces into which each border cuts the other."""

from __future__ import annotations

from pyspark.sql import Column

from placespark.functions import exprs as F
from placespark.functions import geom as G

EPSILON = 1e-9


def _segments(g: Column) -> Column:
    return F.flatten(F.transform(G.lines(g), G.segments))


def _near_outline(g: Column, p: Column) -> Column:
    return F.exists(G.lines(g), lambda ln: F.exists(G.segments(ln), lambda s: G.closest_on_segment(s, p)["d"] <= EPSILON))


def _meets(s: Column, other: Column) -> Column:
    """Places along segment s, 0 to 1, where the segments of ``other`` meet it."""

    def one(t):
        rx, ry = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
        qx, qy = t["b"]["x"] - t["a"]["x"], t["b"]["y"] - t["a"]["y"]
        dx, dy = t["a"]["x"] - s["a"]["x"], t["a"]["y"] - s["a"]["y"]
        ex, ey = t["b"]["x"] - s["a"]["x"], t["b"]["y"] - s["a"]["y"]

        def places(k):
            u, v = (dx * qy - dy * qx) / F.nullif(k["c"], F.lit(0.0)), (dx * ry - dy * rx) / F.nullif(k["c"], F.lit(0.0))
            crossing = F.when((u >= 0) & (u <= 1) & (v >= 0) & (v <= 1), u)
            along = lambda x, y: F.when(F.abs(rx * y - ry * x) <= EPSILON, (x * rx + y * ry) / k["n"])
            on = lambda w: F.let(w, lambda z: F.when((z >= 0) & (z <= 1), z))
            return F.array(crossing, on(F.when(k["c"] == 0, along(dx, dy))), on(F.when(k["c"] == 0, along(ex, ey))))

        return F.let(F.struct((rx * qy - ry * qx).alias("c"), (rx * rx + ry * ry).alias("n")), places)

    return F.array_compact(F.flatten(F.transform(other, one)))


def _pieces(g: Column, other: Column, segments: Column) -> Column:
    """Array of struct(inside, on, meets) of the pieces of g's border against ``other``."""

    def of(s):
        def cut(ts):
            def classify(t, i):
                m = G.xy(
                    s["a"]["x"] + (s["b"]["x"] - s["a"]["x"]) * (t + F.get(ts, i + 1)) / 2,
                    s["a"]["y"] + (s["b"]["y"] - s["a"]["y"]) * (t + F.get(ts, i + 1)) / 2,
                )
                return F.let(
                    m,
                    lambda p: F.let(
                        _near_outline(other, p),
                        lambda on: F.struct(
                            (~on & G.contains_point(other, p)).alias("inside"), on.alias("on"), (F.get(ts, i + 1) - t).alias("w")
                        ),
                    ),
                )

            # Rounding may leave slivers between two hits at one place.
            return F.filter(F.transform(F.slice(ts, 1, F.size(ts) - 1), classify), lambda p: p["w"] > EPSILON)

        return F.let(
            _meets(s, segments),
            lambda met: F.struct(
                F.let(F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), met))), cut).alias("pieces"),
                (F.size(met) > 0).alias("meets"),
            ),
        )

    return F.transform(_segments(g), of)


def matrix(a: Column, b: Column) -> Column:
    """Nine characters: interior, border and exterior of a against those of b."""
    found = F.let(
        F.struct(_segments(a).alias("sa"), _segments(b).alias("sb")),
        lambda s: F.struct(_pieces(a, b, s["sb"]).alias("a"), _pieces(b, a, s["sa"]).alias("b")),
    )

    def letters(k):
        pa = F.flatten(F.transform(k["a"], lambda e: e["pieces"]))
        pb = F.flatten(F.transform(k["b"], lambda e: e["pieces"]))
        facts = F.struct(
            F.exists(pa, lambda p: p["inside"]).alias("a_in"),
            F.exists(pa, lambda p: ~p["inside"] & ~p["on"]).alias("a_out"),
            F.exists(pa, lambda p: p["on"]).alias("shared"),
            F.exists(pb, lambda p: p["inside"]).alias("b_in"),
            F.exists(pb, lambda p: ~p["inside"] & ~p["on"]).alias("b_out"),
            F.exists(k["a"], lambda e: e["meets"]).alias("touch"),
            F.let(G.point_on_surface(a), lambda p: G.contains_point(b, p) & ~_near_outline(b, p)).alias("a_core"),
            F.let(G.point_on_surface(b), lambda p: G.contains_point(a, p) & ~_near_outline(a, p)).alias("b_core"),
        )

        def write(f):
            flag = lambda test, value: F.when(test, value).otherwise("F")
            return F.concat(
                flag(f["a_in"] | f["b_in"] | f["a_core"] | f["b_core"], "2"), flag(f["b_in"], "1"), flag(f["a_out"] | f["b_in"], "2"),
                flag(f["a_in"], "1"), F.when(f["shared"], "1").when(f["touch"], "0").otherwise("F"), flag(f["a_out"], "1"),
                flag(f["b_out"] | f["a_in"], "2"), flag(f["b_out"], "1"), F.lit("2"),
            )

        return F.let(facts, write)

    apart = F.let(F.struct(G.bounds(a).alias("a"), G.bounds(b).alias("b")), _apart)
    return F.when(G.is_area(a) & G.is_area(b) & apart, F.lit("FF2FF1212")).otherwise(F.let(found, letters))


def _apart(s: Column) -> Column:
    """Do the boxes a and b lie further apart than what counts as touching? Then so do the areas."""
    a, b = s["a"], s["b"]
    return (
        (b["xmin"] - a["xmax"] > EPSILON) | (a["xmin"] - b["xmax"] > EPSILON) | (b["ymin"] - a["ymax"] > EPSILON) | (a["ymin"] - b["ymax"] > EPSILON)
    )
