"""Exact outlines off any grid: unions, repairs, location expressions of unequal places, with closed forms as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from placespark import fixtures as X
from placespark.functions import exprs as E
from placespark.functions import geom as G
from placespark.operators import regions as R
from placespark.operators import resolve, trees
from placespark.plans.catalog import query, rounded

_PLACES = X.with_sql("places")
_SHAPES = X.with_sql("shapes")
_BOX = "(xmax - xmin) * (ymax - ymin)"
# A bar across each place, thinner than any grid and off all of them.
_THIN, _REACH = 0.001, 10.0


def _members(df, group, *geoms):
    """(group, member, edges) of several geometry columns of each row."""
    both = F.explode(F.array(*(F.struct(F.lit(i).alias("n"), g.alias("geom")) for i, g in enumerate(geoms)))).alias("m")
    rows = df.select(group, both).select(group, F.concat_ws("/", group, "m.n").alias("member"), "m.geom")
    return R.member_edges(rows.select(group, "member"), rows.select("member", "geom"), "member")


def _bar():
    x, y = (E.col("xmin") + E.col("xmax")) / 2, (E.col("ymin") + E.col("ymax")) / 2 + 0.0003
    return G.box(x - _REACH, y, x + _REACH, y + _THIN)


@query(
    "union_thin_area",
    _PLACES + f"SELECT place_id, round({_BOX} + (20 - (xmax - xmin)) * 0.001, 6) + 0 AS area, round((xmax - xmin) * 0.001, 6) + 0 AS common FROM places",
)
def union_thin_area(spark, d):
    """Union and intersection of each place and a bar of a thousandth of a degree, which no row of a grid may miss."""
    rows = _members(X.place_shapes(spark, d), "place_id", E.col("geom"), _bar())
    union = R.areas(R.united(rows, ["place_id"], "member"), ["place_id"])
    common = R.areas(R.common(rows, ["place_id"], "member"), ["place_id"]).withColumnRenamed("area", "common")
    return union.join(common, "place_id").select("place_id", rounded(F.col("area")).alias("area"), rounded(F.col("common")).alias("common"))


def _diamond(dx=0.0, dy=0.0):
    x0, y0, w, h = (E.col(c) for c in ("x0", "y0", "w", "h"))
    corners = ((0.5, 0.0), (1.0, 0.5), (0.5, 1.0), (0.0, 0.5))
    return G.make_polygon(E.array(*(G.xy(x0 + w * (a + dx), y0 + h * (b + dy)) for a, b in corners)))


@query("union_oblique_area", _SHAPES + "SELECT shape_id, round(w * h * 0.76, 6) + 0 AS area, round(w * h * 0.24, 6) + 0 AS common FROM shapes")
def union_oblique_area(spark, d):
    """A diamond and the same one moved: edges that cross in the middle of each other."""
    rows = _members(X.shapes(spark, d).select("shape_id", "x0", "y0", "w", "h"), "shape_id", _diamond(), _diamond(0.3, 0.1))
    union = R.areas(R.united(rows, ["shape_id"], "member"), ["shape_id"])
    common = R.areas(R.common(rows, ["shape_id"], "member"), ["shape_id"]).withColumnRenamed("area", "common")
    return union.join(common, "shape_id").select("shape_id", rounded(F.col("area")).alias("area"), rounded(F.col("common")).alias("common"))


@query("make_valid_area", _SHAPES + "SELECT shape_id, round(w * h / 2, 6) + 0 AS area, CAST(2 AS BIGINT) AS parts FROM shapes")
def make_valid_area(spark, d):
    """Bow-ties become their two halves."""
    x0, y0, w, h = (E.col(c) for c in ("x0", "y0", "w", "h"))
    tie = G.make_polygon(E.array(G.xy(x0, y0), G.xy(x0 + w, y0 + h), G.xy(x0 + w, y0), G.xy(x0, y0 + h)))
    valid = R.make_valid(X.shapes(spark, d).select("shape_id", tie.alias("geom")), "shape_id")
    return valid.select("shape_id", rounded(G.area(E.col("geom"))).alias("area"), F.size("geom.parts").cast("bigint").alias("parts"))


@query(
    "union_outline",
    _PLACES + f"SELECT place_id, 'Polygon' AS kind, CAST(9 AS BIGINT) AS points, round(1.75 * {_BOX}, 6) + 0 AS area, round(3 * (xmax - xmin + ymax - ymin), 6) + 0 AS length FROM places",
)
def union_outline(spark, d):
    """Each place and itself moved by half its sides as one ring of eight corners, without the borders inside."""
    g = E.col("geom")
    moved = G.translate(g, (E.col("xmax") - E.col("xmin")) / 2, (E.col("ymax") - E.col("ymin")) / 2)
    rows = _members(X.place_shapes(spark, d), "place_id", g, moved)
    drawn = R.outlines(R.united(rows, ["place_id"], "member", levels=True), ["place_id"])
    return drawn.select(
        "place_id", "geom.kind", G.num_points(g).cast("bigint").alias("points"), rounded(G.area(g)).alias("area"), rounded(G.length(G.boundary(g))).alias("length")
    )


@query(
    "outline_with_hole",
    _PLACES + f"SELECT place_id, CAST(1 AS BIGINT) AS parts, CAST(2 AS BIGINT) AS rings, round({_BOX} * 3 / 4, 6) + 0 AS area FROM places",
)
def outline_with_hole(spark, d):
    """A place without the box of half its sides in its middle: one part with one hole."""
    x0, y0, x1, y1 = (E.col(c) for c in ("xmin", "ymin", "xmax", "ymax"))
    inner = G.box(x0 * 0.75 + x1 * 0.25, y0 * 0.75 + y1 * 0.25, x0 * 0.25 + x1 * 0.75, y0 * 0.25 + y1 * 0.75)
    shapes = X.place_shapes(spark, d)
    rows = R.edges(shapes.select("place_id", F.lit("a").alias("side"), "geom")).unionByName(R.edges(shapes.select("place_id", F.lit("b").alias("side"), inner.alias("geom"))))
    drawn = R.outlines(R.difference(rows, ["place_id"], levels=True), ["place_id"])
    return drawn.select(
        "place_id", F.size("geom.parts").cast("bigint").alias("parts"), F.size(F.col("geom.parts")[0]).cast("bigint").alias("rings"), rounded(G.area(E.col("geom"))).alias("area")
    )


_PAIRS = X.with_sql("entities", "places", "links")[:-1] + ", boxes AS (SELECT * FROM links JOIN places USING (place_id) JOIN entities USING (entity_id)) "


@query(
    "contains_polygons",
    _PAIRS + "SELECT entity_id, place_id, gxmin <= xmin AND gymin <= ymin AND gxmax >= xmax AND gymax >= ymax AS gold_contains,"
    " xmin <= gxmin AND ymin <= gymin AND xmax >= gxmax AND ymax >= gymax AS place_contains FROM boxes",
)
def contains_polygons(spark, d):
    """Areas in areas, both ways, for each entity and place that it mentions."""
    pairs = X.links(spark, d).join(X.place_shapes(spark, d).select("place_id", F.col("geom").alias("b")), "place_id")
    pairs = pairs.join(X.entities(spark, d).select("entity_id", X.gold_box().alias("a")), "entity_id")
    key = ["entity_id", "place_id"]
    rows = R.edges(pairs.select(*key, F.lit("a").alias("side"), F.col("a").alias("geom"))).unionByName(
        R.edges(pairs.select(*key, F.lit("b").alias("side"), F.col("b").alias("geom")))
    )
    return R.contained(rows, key).select(*key, F.col("a_contains").alias("gold_contains"), F.col("b_contains").alias("place_contains"))


# ---- location expressions ------------------------------------------------------------------------

_DISC = "16 * 0.02 * 0.02 * sin(pi() / 16)"


def _unequal(spark, d):
    """Three places of each fixture place: its centre, itself, and a country around it."""
    x, y = (E.col("xmin") + E.col("xmax")) / 2, (E.col("ymin") + E.col("ymax")) / 2
    own = ((1, G.make_point(x, y)), (2, E.col("geom")), (3, G.box(x - 30, y - 30, x + 30, y + 30)))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("shp_id"), g.alias("geom")) for n, g in own))).alias("s")
    return X.place_shapes(spark, d).select(F.col("place_id").cast("string").alias("entity_id"), each).select("entity_id", "s.*")


def _told(spark, d, texts):
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("what"), F.lit(t).alias("operators")) for n, t in texts.items()))).alias("t")
    rows = X.places(spark, d).select("place_id", F.col("place_id").cast("string").alias("entity_id"), each)
    rows = rows.select("place_id", "entity_id", "t.*", F.concat_ws("/", "entity_id", "t.what").alias("expr_id"))
    nodes = trees.operator_nodes(rows.select("expr_id", "operators"))
    return rows, nodes.join(rows.select("expr_id", "entity_id"), "expr_id")


_MEETINGS = {
    "point": "GeoLocation(1,None)", "point in city": "Intersection(GeoLocation(1,None),GeoLocation(2,None))",
    "point in country": "Intersection(GeoLocation(1,None),GeoLocation(3,None))", "city in country": "Intersection(GeoLocation(3,None),GeoLocation(2,None))",
    "all": "Intersection(GeoLocation(3,None),Intersection(GeoLocation(2,None),GeoLocation(1,None)))",
}


@query(
    "loc_unequal",
    _PLACES + "SELECT place_id, what, round(CASE what WHEN 'city in country' THEN " + _BOX + f" ELSE {_DISC} END, 6) + 0 AS area"
    " FROM places, (SELECT unnest(['" + "', '".join(_MEETINGS) + "']) AS what)",
)
def loc_unequal(spark, d):
    """A point, a city and a country in one expression: work goes with their corners, not with their sizes."""
    rows, nodes = _told(spark, d, _MEETINGS)
    found, _ = resolve.regions(nodes, _unequal(spark, d))
    areas = R.areas(found, ["expr_id"])
    return rows.join(areas, "expr_id").select("place_id", "what", rounded(F.col("area")).alias("area"))


_FAILURES = {
    "no place": "Union(GeoLocation(9,None),GeoLocation(2,None))", "same place": "Between(GeoLocation(2,None),GeoLocation(2,None))",
    "inherited": "SimpleLocation(SubLocation(GeoLocation(9,None)),Some(GeoCardinal(N)))",
}


@query(
    "resolve_reasons",
    _PLACES + "SELECT place_id, what, CASE what WHEN 'inherited' THEN 'no place' ELSE what END AS reason FROM places, (SELECT unnest(['no place', 'same place', 'inherited']) AS what)",
)
def resolve_reasons(spark, d):
    """One row for each expression without a shape, and why; a union with an unknown place is unknown as well."""
    rows, nodes = _told(spark, d, _FAILURES | {"fine": "GeoLocation(2,None)"})
    _, reasons = resolve.regions(nodes, _unequal(spark, d))
    return rows.join(reasons, "expr_id").select("place_id", "what", "reason")
