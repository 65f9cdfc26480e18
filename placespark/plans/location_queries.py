"""Location operators over the places."""

from __future__ import annotations

from pyspark.sql import functions as F

from placespark import fixtures as X
from placespark.functions import exprs as E
from placespark.functions import geom as G
from placespark.operators import locations as L
from placespark.operators import lines as N
from placespark.operators import regions as R
from placespark.operators import resolve, trees
from placespark.plans.catalog import query, rounded
from placespark.plans.text_queries import _operator_rows

_PLACES = X.with_sql("places")
_BOX = "(xmax - xmin) * (ymax - ymin)"


def _leaves(spark, d, rows=32):
    return L.cut_lineage(L.leaf(X.place_shapes(spark, d).select(F.col("place_id").alias("key"), "geom"), rows))


def _cardinals(spark, d):
    return X.places(spark, d).select(F.col("place_id").alias("key"), "cardinal")


def _areas(spans, places=6):
    return L.area_of(spans).select(F.col("key").alias("place_id"), rounded(F.col("area"), places).alias("area"))


def _neighbours(spark, d):
    """Each place and the next one, as two shapes on the rows of the first."""
    first = X.place_shapes(spark, d).select(F.col("place_id").alias("key"), "geom")
    heights = first.select("key", L.row_height(G.bounds(E.col("geom")), 32).alias("h"))
    second = X.place_shapes(spark, d).select((F.col("place_id") - 1).alias("key"), "geom")
    return L.cut_lineage(L.leaf_at(first.join(heights, "key"))), L.cut_lineage(L.leaf_at(second.join(heights, "key")))


def _shifted(spark, d):
    """Each place and a copy of it half a degree east and a quarter north, on common rows."""
    first = X.place_shapes(spark, d).select(F.col("place_id").alias("key"), "geom")
    sized = first.withColumn("h", L.row_height(G.bounds(E.col("geom")), 32))
    moved = sized.withColumn("geom", G.translate(E.col("geom"), 0.5, 0.25))
    return L.leaf_at(sized), L.leaf_at(moved)


_META = "greatest(0, xmax - xmin - 5e-1) * greatest(0, ymax - ymin - 25e-2)"


@query("loc_toponym", _PLACES + f"SELECT place_id, {_BOX} AS area FROM places")
def loc_toponym(spark, d):
    return _areas(_leaves(spark, d))


@query("geolocation_shape", _PLACES[:-1] + f", ring AS (SELECT place_id, {_BOX} AS area FROM places) SELECT place_id, area FROM ring")
def geolocation_shape(spark, d):
    """Borders given as two open lines are merged, closed into a polygon and united."""
    ways = N.polygonize(_box_ways(spark, d), "place_id")
    return _areas(L.leaf(ways.select(F.col("place_id").alias("key"), "geom"), 32))


def _box_ways(spark, d):
    """The border of each place as two lines that meet in opposite corners."""
    p = lambda x, y: G.xy(E.col(x), E.col(y))
    halves = E.array(
        E.array(p("xmin", "ymin"), p("xmax", "ymin"), p("xmax", "ymax")), E.array(p("xmin", "ymin"), p("xmin", "ymax"), p("xmax", "ymax"))
    )
    return X.places(spark, d).select("place_id", F.explode(halves).alias("line"))


@query("merge_ways", _PLACES + "SELECT place_id, CAST(5 AS BIGINT) AS points, true AS closed, round(2 * (xmax - xmin + ymax - ymin), 6) + 0 AS length FROM places")
def merge_ways(spark, d):
    merged = N.merge_ways(_box_ways(spark, d), "place_id").select("place_id", G.make_line(E.col("line")).alias("g"))
    return merged.select(
        "place_id", G.num_points(E.col("g")).alias("points"), G.is_closed(E.col("g")).alias("closed"), rounded(G.length(E.col("g"))).alias("length")
    )


@query("polygonize_ways", _PLACES + f"SELECT place_id, 'Polygon' AS kind, {_BOX} AS area FROM places")
def polygonize_ways(spark, d):
    return N.polygonize(_box_ways(spark, d), "place_id").select("place_id", "geom.kind", G.area(E.col("geom")).alias("area"))


@query("loc_simple", _PLACES + f"SELECT place_id, round({_BOX} / 2, 4) + 0 AS area FROM places")
def loc_simple(spark, d):
    """The northern, eastern, southern or western half of each box."""
    return _areas(L.simple(_leaves(spark, d), _cardinals(spark, d)), 4)


@query("loc_sub", _PLACES + f"SELECT place_id, {_BOX} AS area FROM places")
def loc_sub(spark, d):
    return _areas(L.sub_location(_leaves(spark, d)))


@query("loc_cardinal_region")
def loc_cardinal_region(spark, d):
    regions = L.cardinal_regions(_leaves(spark, d), _cardinals(spark, d))
    return regions.select(F.col("key").alias("place_id"), rounded(G.area(E.col("geom")), 4).alias("area"))


@query("loc_adjacent")
def loc_adjacent(spark, d):
    return _areas(L.adjacent(_leaves(spark, d, 8)), 4)


@query(
    "loc_proximate",
    _PLACES + "SELECT place_id, round(2 * (xmax - xmin + ymax - ymin) * 0.1 + 16 * 0.01 * sin(pi() / 16), 1) + 0 AS area FROM places",
)
def loc_proximate(spark, d):
    return _areas(L.proximate(_leaves(spark, d, 64)), 1)


@query("loc_distance")
def loc_distance(spark, d):
    ten = _cardinals(spark, d).withColumns({"distance": F.lit(10), "unit": F.lit("KM")})
    return _areas(L.at_distance(_leaves(spark, d), ten), 4)


@query("loc_union", _PLACES + f"SELECT place_id, 2 * {_BOX} AS area FROM places")
def loc_union(spark, d):
    return _areas(L.union(*_shifted(spark, d)))


@query("loc_intersection", _PLACES + f"SELECT place_id, {_META} AS area FROM places WHERE {_META} > 0")
def loc_intersection(spark, d):
    return _areas(L.intersection(*_shifted(spark, d)))


@query("loc_between")
def loc_between(spark, d):
    return _areas(L.between(*_neighbours(spark, d)), 4)


@query(
    "loc_route",
    _PLACES + "SELECT a.place_id, round(2e-3 * sqrt(((a.xmin + a.xmax - b.xmin - b.xmax) / 2) ^ 2 + ((a.ymin + a.ymax - b.ymin - b.ymax) / 2) ^ 2)"
    " + 16e-6 * sin(pi() / 16), 6) + 0 AS area FROM places a JOIN places b ON b.place_id = a.place_id + 1",
)
def loc_route(spark, d):
    strips = L.route_shapes(L.route_lines(*_neighbours(spark, d)))
    return strips.select(F.col("key").alias("place_id"), rounded(G.area(E.col("geom"))).alias("area"))


@query("resolve_expressions")
def resolve_expressions(spark, d):
    """Area of every distinct operator tree of the corpus, evaluated level by level."""
    rows = _operator_rows(spark, d).select("operators").distinct().withColumn("expr_id", F.sha2("operators", 256))
    shapes = X.place_shapes(spark, d).select(F.col("place_id").cast("int").alias("shp_id"), "geom")
    found, _ = resolve.regions(trees.operator_nodes(rows.select("expr_id", "operators")), shapes)
    areas = R.areas(found, ["expr_id"])
    return rows.join(areas, "expr_id", "left").select("operators", rounded(F.coalesce("area", F.lit(0.0)), 4).alias("area"))
