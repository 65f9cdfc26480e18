"""Discrete size, direction, distance and relation of geometries."""

from __future__ import annotations

from pyspark.sql import Column

from placespark.functions import exprs as F
from placespark.functions import geom as G

# Classes of relation matrices, tried in this order.
RELATIONS = (
    ("Equals", r"^[^F].F..FFF.$"),
    ("Disjoint", r"^FF.FF.{4}$"),
    ("Contains", r"^[^F].{5}FF.$"),
    ("Covers", r"^([^F].{5}FF.|.[^F].{4}FF.|.{3}[^F]..FF.|.{3}[^F].FF.)$"),
    ("Within", r"^[^F].F..F.{3}$"),
    ("CoveredBy", r"^([^F].F..F.{3}|.[^F]F..F.{3}|..F[^F].F.{3}|..F.[^F]F.{3})$"),
    ("Touches", r"^(F[^F].{7}|F..[^F].{5}|F.{3}[^F].{4})$"),
    ("Intersects", r"^([^F].{8}|.[^F].{7}|.{3}[^F].{5}|.{4}[^F].{4})$"),
)


def relation_class(matrix: Column) -> Column:
    found = None
    for name, pattern in RELATIONS:
        test = matrix.rlike(pattern)
        found = F.when(test, name) if found is None else found.when(test, name)
    return found


def frexp10(x: Column) -> Column:
    """struct(m, e) with x = m * 10^e, the exponent cut towards zero; null for x <= 0."""
    exponent = F.when(x > 0, F.log10(x).cast("int"))
    return F.let(exponent, lambda e: F.when(e.isNotNull(), F.struct((x / F.power(F.lit(10.0), e)).alias("m"), e.alias("e"))))


def ldexp10(m: Column, e: Column) -> Column:
    return m * F.power(F.lit(10.0), e)


def _whole(pair: Column) -> Column:
    return F.let(pair, lambda p: F.when(p.isNotNull(), F.struct(p["m"].cast("bigint").alias("m"), p["e"].alias("e"))))


def geometry_size(g: Column, discrete: bool = True) -> Column:
    """Area in millionths or length in thousandths as mantissa and exponent."""
    size = frexp10(F.when(G.is_area(g), G.area(g) * 1000000).otherwise(G.length(g) * 1000))
    return _whole(size) if discrete else size


def azimuth_sector(a: Column, b: Column, discrete: bool = True) -> Column:
    """Eighth of the compass from point a to point b, 0 to 8; 8 is north again."""
    turn = (G.azimuth(a, b) + 22.5) / 45
    return F.floor(turn) if discrete else turn


def distance_bucket(a: Column, b: Column, discrete: bool = True) -> Column:
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    away = frexp10(F.sqrt(dx * dx + dy * dy) * 1000)
    return _whole(away) if discrete else away


def project_centroid(p: Column, m: Column, e: Column, sector: Column) -> Column:
    """Point a bucketed distance and sector away from p."""
    return G.project(p, ldexp10(m, e) / 1000, sector * 45)


def buffer_centroid(p: Column, is_area: Column, m: Column, e: Column) -> Column:
    """Disc of a bucketed size: as large as the area, or half as wide as the length."""
    size = ldexp10(m, e)
    radius = F.when(is_area, F.sqrt(size / 3.141592653589793)).otherwise(size / 2) / 1000
    return F.let(radius, lambda r: G.buffer_point(p, r))
