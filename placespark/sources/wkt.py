"""WKT text to geometry columns and back."""

from __future__ import annotations

from pyspark.sql import Column

from placespark.functions import exprs as F
from placespark.functions import geom as G

# WKT tags and kinds of geometry.
TAGS = {
    "POINT": "Point", "MULTIPOINT": "MultiPoint", "LINESTRING": "LineString", "MULTILINESTRING": "MultiLineString",
    "POLYGON": "Polygon", "MULTIPOLYGON": "MultiPolygon",
}


def _points(text: Column) -> Column:
    """ "1 2, 3 4" -> array of points."""

    def point(pair):
        return F.let(
            F.split(F.trim(pair), " +"),
            lambda p: G.xy(F.element_at(p, 1).cast("double"), F.element_at(p, 2).cast("double")),
        )

    return F.transform(F.split(text, ","), point)


def from_text(wkt: Column) -> Column:
    """Geometry of simple and multi WKT; null for anything else."""
    tag = F.upper(F.regexp_extract(wkt, "^ *([A-Za-z]+)", 1))
    kind = None
    for name, value in TAGS.items():
        kind = F.when(tag == name, value) if kind is None else kind.when(tag == name, value)
    body = F.regexp_replace(F.regexp_replace(wkt, "^[^(]*", ""), " *([(),]) *", "$1")
    lists = lambda t: F.transform(F.regexp_extract_all(t, r"\(([^()]+)\)", 1), _points)
    flat = F.regexp_replace(body, "[()]", "")

    def parts(b):
        lines = F.transform(lists(b), lambda ln: F.array(ln))
        rings = F.array(lists(b))
        areas = F.transform(F.regexp_extract_all(b, r"\((\([^()]+\)(?:,\([^()]+\))*)\)", 1), lists)
        dots = F.transform(_points(flat), lambda p: F.array(F.array(p)))
        return (
            F.when(tag.isin("POINT", "MULTIPOINT"), dots)
            .when(tag == "LINESTRING", rings)
            .when(tag == "MULTILINESTRING", lines)
            .when(tag == "POLYGON", rings)
            .otherwise(areas)
        )

    made = F.let(body, lambda b: F.struct(kind.alias("kind"), parts(b).alias("parts")))
    return F.when(tag.isin(*TAGS), made)


def _number(v: Column) -> Column:
    return F.regexp_replace(v.cast("string"), r"\.0$", "")


def as_text(g: Column) -> Column:
    """WKT of a geometry; whole numbers lose their fraction."""

    def pair(p):
        return F.concat(_number(p["x"]), F.lit(" "), _number(p["y"]))

    def listed(items):
        return F.concat(F.lit("("), F.array_join(items, ","), F.lit(")"))

    def line(points):
        return listed(F.transform(points, pair))

    def part(rings):
        return listed(F.transform(rings, line))

    dots = listed(F.transform(G.points(g), pair))
    lines = listed(F.transform(G.lines(g), line))
    text = (
        F.when(G.is_point(g) | (g["kind"] == "LineString"), dots)
        .when(G.is_line(g) | (g["kind"] == "Polygon"), lines)
        .otherwise(listed(F.transform(g["parts"], part)))
    )
    return F.when(G.is_empty(g), F.concat(F.upper(g["kind"]), F.lit(" EMPTY"))).otherwise(
        F.concat(F.upper(g["kind"]), text)
    )
