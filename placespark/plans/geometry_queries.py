"""Geometry functions and overlay operators over the derived place data."""

from __future__ import annotations


from placespark import fixtures as X
from placespark.functions import exprs as E
from placespark.functions import exprs as F
from placespark.functions import geom as G
from placespark.functions import hull as H
from placespark.functions import relate
from placespark.operators import overlay as O
from placespark.operators import regions as R
from placespark.operators.layout import spread
from placespark.plans.catalog import query, rounded
from placespark.sources.tables import table

GEOM = F.col("geom")
SHAPES = X.with_sql("shapes")


def _r(expression: str, name: str, places: int = 6) -> str:
    return f"round({expression}, {places}) + 0 AS {name}"


@query("geom_type", SHAPES + "SELECT shape_id, CASE WHEN form < 3 THEN 'Polygon' ELSE 'LineString' END AS kind FROM shapes")
def geom_type(spark, d):
    return X.shapes(spark, d).select("shape_id", G.kind(GEOM).alias("kind"))


@query("geom_bounds", SHAPES + "SELECT shape_id, x0 AS xmin, y0 AS ymin, x0 + w AS xmax, y0 + h AS ymax FROM shapes")
def geom_bounds(spark, d):
    return X.shapes(spark, d).select("shape_id", G.bounds(GEOM).alias("b")).select("shape_id", "b.*")


@query(
    "geom_area",
    SHAPES + "SELECT shape_id, " + _r("w * h * CASE form WHEN 0 THEN 1 WHEN 1 THEN 0.5 WHEN 2 THEN 0.75 ELSE 0 END", "area")
    + " FROM shapes",
)
def geom_area(spark, d):
    return X.shapes(spark, d).select("shape_id", rounded(G.area(GEOM)).alias("area"))


@query(
    "geom_length",
    SHAPES + "SELECT shape_id, " + _r("CASE WHEN form = 3 THEN sqrt(w * w + h * h) ELSE 0 END", "length") + " FROM shapes",
)
def geom_length(spark, d):
    return X.shapes(spark, d).select("shape_id", rounded(G.length(GEOM)).alias("length"))


@query("geom_median", SHAPES + "SELECT shape_id, " + _r("x0 + w / 2", "x", 3) + ", " + _r("y0 + h / 2", "y", 3) + " FROM shapes")
def geom_median(spark, d):
    """Median of four points in convex position is where their diagonals cross."""
    x0, y0, w, h = (F.col(c) for c in ("x0", "y0", "w", "h"))
    corners = F.array(
        G.xy(x0, y0), G.xy(x0 + w, y0), G.xy(x0 + w, y0 + h), G.xy(x0 + w * 0.25, y0 + h * 0.75)
    )
    spots = G.geometry("MultiPoint", F.transform(corners, lambda p: F.array(F.array(p))))
    return (
        spread(X.shapes(spark, d))
        .select("shape_id", G.geometric_median(spots).alias("m"))
        .select("shape_id", rounded(F.col("m.x"), 3).alias("x"), rounded(F.col("m.y"), 3).alias("y"))
    )


_CENTRE = "CASE form WHEN 2 THEN 5e0 / 12 ELSE 5e-1 END"


@query("geom_centroid", SHAPES + f"SELECT shape_id, {_r(f'x0 + w * {_CENTRE}', 'x')}, {_r(f'y0 + h * {_CENTRE}', 'y')} FROM shapes")
def geom_centroid(spark, d):
    return (
        X.shapes(spark, d)
        .select("shape_id", G.centroid(GEOM).alias("c"))
        .select("shape_id", rounded(F.col("c.x")).alias("x"), rounded(F.col("c.y")).alias("y"))
    )


@query(
    "geom_centrality",
    SHAPES + "SELECT shape_id, form, round(CASE form WHEN 2 THEN least(sqrt(w * w + h * h), 5 * least(w, h)) / 12 ELSE 0 END, 6) + 0 AS moved FROM shapes",
)
def geom_centrality(spark, d):
    """Distance between centroid and centrality of the outline; an L's centroid is off its own corner by 1/12."""
    outline = F.when(F.col("form") == 2, G.boundary(GEOM)).otherwise(GEOM)
    centre = G.centroid(GEOM)
    return X.shapes(spark, d).select(
        "shape_id",
        "form",
        rounded(F.let(centre, lambda c: G.distance_points(c, G.closest_point(outline, c)))).alias("moved"),
    )


@query(
    "point_on_surface",
    SHAPES + "SELECT shape_id, CASE form WHEN 2 THEN x0 + w / 4 WHEN 3 THEN x0 ELSE x0 + w / 2 END AS x,"
    " CASE form WHEN 3 THEN y0 ELSE y0 + h / 2 END AS y FROM shapes",
)
def point_on_surface(spark, d):
    return X.shapes(spark, d).select("shape_id", G.point_on_surface(GEOM).alias("p")).select("shape_id", "p.*")


@query(
    "geom_boundary",
    SHAPES + "SELECT shape_id, CASE WHEN form < 3 THEN 'LineString' ELSE 'MultiPoint' END AS kind,"
    " CAST(CASE form WHEN 2 THEN 7 WHEN 3 THEN 2 ELSE 5 END AS BIGINT) AS points FROM shapes",
)
def geom_boundary(spark, d):
    return (
        X.shapes(spark, d)
        .select("shape_id", G.boundary(GEOM).alias("b"))
        .select("shape_id", F.col("b.kind"), G.num_points(F.col("b")).alias("points"))
    )


@query(
    "geom_envelope",
    SHAPES + "SELECT shape_id, 'Polygon' AS kind, CAST(5 AS BIGINT) AS points, " + _r("w * h", "area") + " FROM shapes",
)
def geom_envelope(spark, d):
    return (
        X.shapes(spark, d)
        .select("shape_id", G.envelope(GEOM).alias("e"))
        .select("shape_id", F.col("e.kind"), G.num_points(F.col("e")).alias("points"), rounded(G.area(F.col("e"))).alias("area"))
    )


@query(
    "oriented_envelope_area",
    SHAPES + "SELECT shape_id, " + _r(
        "CASE form WHEN 3 THEN 0 WHEN 1 THEN w * h * greatest(w * w, h * h) / (w * w + h * h)"
        " ELSE w * h END", "area"
    ) + " FROM shapes",
)
def oriented_envelope_area(spark, d):
    boxes = X.shapes(spark, d).select("shape_id", H.oriented_envelope(GEOM).alias("e"))
    return boxes.select("shape_id", rounded(G.area(F.col("e"))).alias("area"))


@query(
    "bounding_circle",
    SHAPES + "SELECT shape_id, x0 + w / 2 AS cx, y0 + h / 2 AS cy, " + _r("sqrt(w * w + h * h) / 2", "r") + " FROM shapes",
)
def bounding_circle(spark, d):
    """Circle on the bounding diagonal; ``hull.bounding_circle`` serves any point set."""
    return (
        X.shapes(spark, d)
        .select("shape_id", H.bounding_circle(G.bounding_diagonal(GEOM)).alias("c"))
        .select("shape_id", F.col("c.cx"), F.col("c.cy"), rounded(F.col("c.r")).alias("r"))
    )


@query("bounding_diagonal", SHAPES + "SELECT shape_id, x0 AS ax, y0 AS ay, x0 + w AS bx, y0 + h AS bx2 FROM shapes")
def bounding_diagonal(spark, d):
    p = G.points(F.col("l"))
    return (
        X.shapes(spark, d)
        .select("shape_id", G.bounding_diagonal(GEOM).alias("l"))
        .select(
            "shape_id",
            F.get(p, F.lit(0))["x"].alias("ax"),
            F.get(p, F.lit(0))["y"].alias("ay"),
            F.get(p, F.lit(1))["x"].alias("bx"),
            F.get(p, F.lit(1))["y"].alias("bx2"),
        )
    )


@query("line_is_closed", SHAPES + "SELECT shape_id, form < 3 AS closed FROM shapes")
def line_is_closed(spark, d):
    line = F.when(G.is_area(GEOM), G.boundary(GEOM)).otherwise(GEOM)
    return X.shapes(spark, d).select("shape_id", G.is_closed(line).alias("closed"))


@query("geom_numpoints", SHAPES + "SELECT shape_id, CAST(CASE form WHEN 2 THEN 7 WHEN 3 THEN 2 ELSE 5 END AS BIGINT) AS points FROM shapes")
def geom_numpoints(spark, d):
    return X.shapes(spark, d).select("shape_id", G.num_points(GEOM).alias("points"))


# ---- pairs of geometries ---------------------------------------------------------------------


def _shape_place_pairs(spark, d):
    """Distinct (shape, place) pairs with the shape's geometry and the middle of the place."""
    middle = X.places(spark, d).select("place_id", ((F.col("xmin") + F.col("xmax")) / 2).alias("px"), ((F.col("ymin") + F.col("ymax")) / 2).alias("py"))
    return spread(X.pairs(spark, d)).join(middle, "place_id").join(X.shapes(spark, d), "shape_id")


def _place_box():
    return G.box(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"))


def _gold_place_pairs(spark, d):
    return _paired(spark, d, X.places(spark, d), X.entities(spark, d))


def _paired(spark, d, places, entities):
    joined = spread(X.links(spark, d), "entity_id").join(places, "place_id").join(entities, "entity_id")
    return joined.withColumns({"gold": X.gold_box(), "place": _place_box()})


_MIDDLES = "middles AS (SELECT place_id, (xmin + xmax) / 2 AS px, (ymin + ymax) / 2 AS py FROM places)"
_BOXES = X.with_sql("entities", "places", "links")[:-1] + (
    ", boxes AS (SELECT * FROM links JOIN places USING (place_id) JOIN entities USING (entity_id)) "
)
_GAP_X, _GAP_Y = "greatest(xmin - gxmax, gxmin - xmax, 0)", "greatest(ymin - gymax, gymin - ymax, 0)"


@query(
    "point_in_polygon",
    X.with_sql("places", "pairs", "corner_edges")[:-1] + f", {_MIDDLES}"
    " SELECT shape_id, place_id, any_value(form) < 3 AND sum(CASE WHEN (y1 > py) <> (y2 > py)"
    " AND px < x1 + (py - y1) * (x2 - x1) / nullif(y2 - y1, 0) THEN 1 ELSE 0 END) % 2 = 1 AS inside"
    " FROM pairs JOIN middles USING (place_id) JOIN corner_edges USING (shape_id) GROUP BY ALL",
)
def point_in_polygon(spark, d):
    return _shape_place_pairs(spark, d).select(
        "shape_id", "place_id", G.contains_point(GEOM, G.xy(F.col("px"), F.col("py"))).alias("inside")
    )


@query(
    "closest_point",
    X.with_sql("places", "pairs", "corner_edges")[:-1] + f", {_MIDDLES}, feet AS (SELECT shape_id, place_id, form, px, py, x1, y1, x2, y2,"
    " greatest(0, least(1, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / ((x2 - x1) ^ 2 + (y2 - y1) ^ 2))) AS t"
    " FROM pairs JOIN middles USING (place_id) JOIN corner_edges USING (shape_id))"
    " SELECT shape_id, place_id, round(CASE WHEN any_value(form) < 3 AND sum(CASE WHEN (y1 > py) <> (y2 > py)"
    " AND px < x1 + (py - y1) * (x2 - x1) / nullif(y2 - y1, 0) THEN 1 ELSE 0 END) % 2 = 1 THEN 0 ELSE"
    " min(sqrt((x1 + t * (x2 - x1) - px) ^ 2 + (y1 + t * (y2 - y1) - py) ^ 2)) END, 6) + 0 AS away FROM feet GROUP BY ALL",
)
def closest_point(spark, d):
    """How far the nearest point of the shape is from the middle of the place."""
    p = G.xy(F.col("px"), F.col("py"))
    return _shape_place_pairs(spark, d).select(
        "shape_id", "place_id", rounded(G.distance_points(p, G.closest_point(GEOM, p))).alias("away")
    )


@query(
    "geom_distance",
    _BOXES + f"SELECT entity_id, place_id, round(sqrt({_GAP_X} ^ 2 + {_GAP_Y} ^ 2), 6) + 0 AS distance FROM boxes",
)
def geom_distance(spark, d):
    return _gold_place_pairs(spark, d).select(
        "entity_id", "place_id", rounded(H.distance(F.col("gold"), F.col("place"))).alias("distance")
    )


@query(
    "max_distance",
    _BOXES + "SELECT entity_id, place_id, round(sqrt(greatest(gxmax - xmin, xmax - gxmin) ^ 2"
    " + greatest(gymax - ymin, ymax - gymin) ^ 2), 6) + 0 AS distance FROM boxes",
)
def max_distance(spark, d):
    return _gold_place_pairs(spark, d).select(
        "entity_id", "place_id", rounded(H.max_distance(F.col("gold"), F.col("place"))).alias("distance")
    )


_BOX_CORNERS = "(VALUES (0, 0), (0, 1), (1, 0), (1, 1)) c(i, j)"
_HALF_HAUSDORFF = (
    "SELECT entity_id, place_id, max(CASE WHEN x BETWEEN {o}xmin AND {o}xmax AND y BETWEEN {o}ymin AND {o}ymax"
    " THEN least(x - {o}xmin, {o}xmax - x, y - {o}ymin, {o}ymax - y)"
    " ELSE sqrt(greatest({o}xmin - x, x - {o}xmax, 0) ^ 2 + greatest({o}ymin - y, y - {o}ymax, 0) ^ 2) END) AS v"
    " FROM (SELECT *, CASE i WHEN 0 THEN {s}xmin ELSE {s}xmax END AS x, CASE j WHEN 0 THEN {s}ymin ELSE {s}ymax END AS y"
    f" FROM boxes, {_BOX_CORNERS}) GROUP BY ALL"
)


@query(
    "hausdorff_distance",
    _BOXES + "SELECT entity_id, place_id, round(max(v), 6) + 0 AS distance FROM ("
    + _HALF_HAUSDORFF.format(s="g", o="") + " UNION ALL " + _HALF_HAUSDORFF.format(s="", o="g") + ") GROUP BY ALL",
)
def hausdorff_distance(spark, d):
    return _gold_place_pairs(spark, d).select(
        "entity_id", "place_id", rounded(H.hausdorff_distance(F.col("gold"), F.col("place"))).alias("distance")
    )


@query(
    "azimuth",
    _BOXES + "SELECT entity_id, place_id, round(CASE WHEN dx <> 0 OR dy <> 0 THEN"
    " CASE WHEN atan2(dx, dy) < 0 THEN degrees(atan2(dx, dy)) + 360 ELSE degrees(atan2(dx, dy)) END END, 6) + 0 AS azimuth"
    " FROM (SELECT entity_id, place_id, (xmin + xmax) / 2 - (gxmin + gxmax) / 2 AS dx,"
    " (ymin + ymax) / 2 - (gymin + gymax) / 2 AS dy FROM boxes)",
)
def azimuth(spark, d):
    middle = lambda p: G.xy((F.col(f"{p}xmin") + F.col(f"{p}xmax")) / 2, (F.col(f"{p}ymin") + F.col(f"{p}ymax")) / 2)
    return _gold_place_pairs(spark, d).select(
        "entity_id", "place_id", rounded(G.azimuth(middle("g"), middle(""))).alias("azimuth")
    )


# ---- taking apart and moving -----------------------------------------------------------------


@query(
    "dump_parts",
    X.with_sql("predictions")[:-1] + " SELECT entity_id, CAST(0 AS BIGINT) AS part, gxmin AS xmin, CAST(5 AS BIGINT) AS points FROM entities"
    " UNION ALL SELECT entity_id, 1, pxmin, 5 FROM predictions",
)
def dump_parts(spark, d):
    """Parts of the geometry that holds an entity's gold box and, when there is one, its prediction."""
    gold = X.entities(spark, d)
    guess = X.predictions(spark, d)
    both = gold.join(guess, "entity_id", "left").select(
        "entity_id",
        G.geometry(
            "MultiPolygon",
            F.when(F.col("pxmin").isNull(), X.gold_box()["parts"]).otherwise(
                F.concat(X.gold_box()["parts"], X.predicted_box()["parts"])
            ),
        ).alias("geom"),
    )
    return both.select("entity_id", F.posexplode("geom.parts").alias("part", "rings")).select(
        "entity_id",
        F.col("part").cast("bigint").alias("part"),
        F.array_min(F.transform(F.flatten("rings"), lambda p: p["x"])).alias("xmin"),
        F.size(F.flatten("rings")).cast("bigint").alias("points"),
    )


@query("dump_points", X.with_sql("corner_points") + "SELECT shape_id, CAST(pos AS BIGINT) AS pos, x, y FROM corner_points")
def dump_points(spark, d):
    return X.shapes(spark, d).select("shape_id", F.posexplode(G.points(GEOM)).alias("i", "p")).select(
        "shape_id", (F.col("i") + 1).cast("bigint").alias("pos"), "p.*"
    )


@query("geom_translate", X.with_sql("corner_points") + "SELECT shape_id, CAST(pos AS BIGINT) AS pos, x + 5e-1 AS x, y - 25e-2 AS y FROM corner_points")
def geom_translate(spark, d):
    moved = G.translate(GEOM, F.lit(0.5), F.lit(-0.25))
    return X.shapes(spark, d).select("shape_id", F.posexplode(G.points(moved)).alias("i", "p")).select(
        "shape_id", (F.col("i") + 1).cast("bigint").alias("pos"), "p.*"
    )


_MOVED = (
    X.with_sql("corner_points")[:-1] + f", about AS (SELECT shape_id, x0 + w * {_CENTRE} AS cx, y0 + h * {_CENTRE} AS cy FROM shapes)"
    " SELECT shape_id, CAST(pos AS BIGINT) AS pos, round({x}, 6) + 0 AS x, round({y}, 6) + 0 AS y"
    " FROM corner_points JOIN about USING (shape_id)"
)


def _moved_points(spark, d, moved):
    return X.shapes(spark, d).select("shape_id", F.posexplode(G.points(moved)).alias("i", "p")).select(
        "shape_id", (F.col("i") + 1).cast("bigint").alias("pos"), rounded(F.col("p.x")).alias("x"), rounded(F.col("p.y")).alias("y")
    )


@query("geom_scale", _MOVED.format(x="cx + 2.5 * (x - cx)", y="cy + 2.5 * (y - cy)"))
def geom_scale(spark, d):
    return _moved_points(spark, d, G.scale(GEOM, 2.5))


@query(
    "geom_rotate",
    _MOVED.format(
        x="cx + (x - cx) * cos(radians(30)) - (y - cy) * sin(radians(30))",
        y="cy + (x - cx) * sin(radians(30)) + (y - cy) * cos(radians(30))",
    ),
)
def geom_rotate(spark, d):
    return _moved_points(spark, d, G.rotate(GEOM, 30))


@query(
    "project_point",
    X.with_sql("pings") + "SELECT ping_id, round(x + 1.5 * sin(radians((ping_id % 8) * 45)), 6) + 0 AS x,"
    " round(y + 1.5 * cos(radians((ping_id % 8) * 45)), 6) + 0 AS y FROM pings",
)
def project_point(spark, d):
    moved = G.project(G.xy(F.col("x"), F.col("y")), F.lit(1.5), (F.col("ping_id") % 8) * 45)
    return X.pings(spark, d).select("ping_id", moved.alias("p")).select(
        "ping_id", rounded(F.col("p.x")).alias("x"), rounded(F.col("p.y")).alias("y")
    )


@query(
    "make_polygon",
    X.with_sql("shapes") + "SELECT shape_id, CAST(CASE form WHEN 2 THEN 7 WHEN 3 THEN 3 ELSE 5 END AS BIGINT) AS points, "
    + _r("w * h * CASE form WHEN 0 THEN 1 WHEN 1 THEN 0.5 WHEN 2 THEN 0.75 ELSE 0 END", "area") + " FROM shapes",
)
def make_polygon(spark, d):
    """Rings without their last point are closed again; a two-point line becomes a flat ring."""
    p = G.points(GEOM)
    opened = F.when(G.is_area(GEOM), F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p)
    return X.shapes(spark, d).select("shape_id", G.make_polygon(opened).alias("g")).select(
        "shape_id", G.num_points(F.col("g")).alias("points"), rounded(G.area(F.col("g"))).alias("area")
    )


@query(
    "buffer_point_area",
    X.with_sql("pings") + "SELECT ping_id, round(16 * (1 + ping_id % 4) ^ 2 * sin(pi() / 16), 6) + 0 AS area FROM pings",
)
def buffer_point_area(spark, d):
    disc = G.buffer_point(G.xy(F.col("x"), F.col("y")), (1 + F.col("ping_id") % 4).cast("double"))
    return X.pings(spark, d).select("ping_id", rounded(G.area(disc)).alias("area"))


@query(
    "to_web_mercator",
    X.with_sql("shapes") + "SELECT shape_id, round(6378137e0 * radians(x0), 3) + 0 AS xmin,"
    " round(6378137e0 * ln(tan(pi() / 4 + radians(y0) / 2)), 3) + 0 AS ymin, round(6378137e0 * radians(x0 + w), 3) + 0 AS xmax,"
    " round(6378137e0 * ln(tan(pi() / 4 + radians(y0 + h) / 2)), 3) + 0 AS ymax FROM shapes",
)
def to_web_mercator(spark, d):
    return X.shapes(spark, d).select("shape_id", G.bounds(G.to_web_mercator(GEOM)).alias("b")).select(
        "shape_id", *[rounded(F.col(f"b.{c}"), 3).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")]
    )


@query(
    "simplify_grid",
    X.with_sql("shapes") + "SELECT shape_id, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(CASE"
    " WHEN form = 1 AND i <> 1 AND j <> 1 THEN w * h / (2 * sqrt(w * w + h * h))"
    " WHEN form = 2 AND i = 2 AND j = 2 THEN least(w, h) / 2"
    " WHEN form = 3 THEN abs(i - j) * w * h / (2 * sqrt(w * w + h * h)) ELSE 0 END, 6) + 0 AS moved"
    " FROM shapes, (SELECT unnest(range(3)) AS i), (SELECT unnest(range(3)) AS j)",
)
def simplify_grid(spark, d):
    """How far each point of the envelope's 3 x 3 grid moves to reach the shape."""
    grid = H.simplify_grid(GEOM, 2)
    return X.shapes(spark, d).select("shape_id", F.explode(grid).alias("c")).select(
        "shape_id",
        F.col("c.i").cast("bigint").alias("i"),
        F.col("c.j").cast("bigint").alias("j"),
        rounded(G.distance_points(F.col("c.source"), F.col("c.target"))).alias("moved"),
    )


# ---- overlay ---------------------------------------------------------------------------------

H_ROW = 0.25

# Quarter-degree cells covered by boxes: an independent way to the area of aligned boxes.
_CELLS = (
    "(SELECT {keys}, i, j FROM (SELECT {keys}, j, unnest(range(CAST({p}xmin * 4 AS BIGINT), CAST({p}xmax * 4 AS BIGINT))) AS i"
    " FROM (SELECT {keys}, {p}xmin, {p}xmax, unnest(range(CAST({p}ymin * 4 AS BIGINT), CAST({p}ymax * 4 AS BIGINT))) AS j FROM {source})))"
)
_LINK_PLACES = X.with_sql("entities", "places", "links")[:-1] + ", placed AS (SELECT * FROM links JOIN places USING (place_id)) "


def _entity_places(spark, d):
    return R.member_edges(X.links(spark, d), X.place_shapes(spark, d), "place_id")


@query(
    "union_area",
    _LINK_PLACES + "SELECT entity_id, round(count(*) * 0.0625, 6) + 0 AS area FROM (SELECT DISTINCT entity_id, i, j FROM "
    + _CELLS.format(keys="entity_id", p="", source="placed") + ") GROUP BY ALL",
)
def union_area(spark, d):
    """Area of the union of the places an entity mentions."""
    areas = R.areas(R.united(_entity_places(spark, d), ["entity_id"], "place_id"), ["entity_id"])
    return areas.select("entity_id", rounded(F.col("area")).alias("area"))


@query(
    "intersection_area",
    _LINK_PLACES[:-1] + ", counts AS (SELECT entity_id, count(*) AS inputs FROM links GROUP BY ALL),"
    " covered AS (SELECT entity_id, i, j, count(*) AS inputs FROM "
    + _CELLS.format(keys="entity_id", p="", source="placed") + " GROUP BY ALL),"
    " common AS (SELECT entity_id, count(*) * 0.0625 AS area FROM covered JOIN counts USING (entity_id, inputs) GROUP BY ALL)"
    " SELECT entity_id, inputs, round(coalesce(area, 0), 6) + 0 AS area FROM counts LEFT JOIN common USING (entity_id)",
)
def intersection_area(spark, d):
    """Area common to all places an entity mentions."""
    counts = X.links(spark, d).groupBy("entity_id").agg(F.count(F.lit(1)).alias("inputs"))
    areas = R.areas(R.common(_entity_places(spark, d), ["entity_id"], "place_id"), ["entity_id"])
    return counts.join(areas, "entity_id", "left").select("entity_id", "inputs", rounded(F.coalesce("area", F.lit(0.0))).alias("area"))


@query(
    "difference_area",
    _LINK_PLACES[:-1] + ", own AS (SELECT DISTINCT entity_id, i, j FROM "
    + _CELLS.format(keys="entity_id", p="g", source="entities") + "),"
    " other AS (SELECT DISTINCT entity_id, i, j FROM " + _CELLS.format(keys="entity_id", p="", source="placed") + ")"
    " SELECT entity_id, count(*) * 0.0625 AS area_a, count(o.i) * 0.0625 AS overlap, (count(*) - count(o.i)) * 0.0625 AS difference"
    " FROM own LEFT JOIN other o USING (entity_id, i, j) GROUP BY ALL",
)
def difference_area(spark, d):
    """Gold area without the places the entity mentions; several subtracted parts all count."""
    gold = spread(X.entities(spark, d), "entity_id").select("entity_id", F.lit("a").alias("side"), X.gold_box().alias("geom"))
    other = R.united(_entity_places(spark, d), ["entity_id"], "place_id").withColumn("side", F.lit("b"))
    areas = R.set_areas(R.edges(gold).unionByName(other), ["entity_id"])
    return areas.where("area_a > 0").select(
        "entity_id", *[rounded(F.col(c)).alias(c) for c in ("area_a", "overlap", "difference")]
    )


_GOLD_SPANS = (
    "SELECT entity_id, CAST(row AS BIGINT) AS row, gxmin AS x0, gxmax AS x1 FROM"
    " (SELECT entity_id, gxmin, gxmax, unnest(range(CAST(gymin * 4 AS BIGINT), CAST(gymax * 4 AS BIGINT))) AS row FROM entities)"
)


@query(
    "span_interval_join",
    _LINK_PLACES[:-1] + f", a AS ({_GOLD_SPANS}), b AS (SELECT entity_id, place_id, unnest(range(CAST(ymin * 4 AS BIGINT),"
    " CAST(ymax * 4 AS BIGINT))) AS row, xmin AS bx0, xmax AS bx1 FROM placed)"
    " SELECT entity_id, place_id, row, greatest(x0, bx0) AS x0, least(x1, bx1) AS x1 FROM a JOIN b USING (entity_id, row)"
    " WHERE x0 < bx1 AND bx0 < x1",
)
def span_interval_join(spark, d):
    gold = spread(X.entities(spark, d), "entity_id").select("entity_id", X.gold_box().alias("geom"))
    a = O.spans(gold, ["entity_id"], H_ROW)
    b = X.links(spark, d).join(O.spans(X.place_shapes(spark, d).select("place_id", "geom"), ["place_id"], H_ROW), "place_id")
    return O.span_interval_join(a, b, ["entity_id"]).select("entity_id", "place_id", "row", "x0", "x1")


@query(
    "collect_parts",
    X.with_sql("links") + "SELECT entity_id, count(*) AS parts, count(*) * 5 AS points, min(place_id) AS first_place,"
    " max(place_id) AS last_place FROM links GROUP BY ALL",
)
def collect_parts(spark, d):
    """Parts of all places of an entity in one collection, as rows (entity, part): no group is gathered."""
    parts = X.links(spark, d).join(X.place_shapes(spark, d), "place_id").select(
        "entity_id", "place_id", F.explode("geom.parts").alias("rings")
    )
    return parts.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("parts"),
        F.sum(F.size(F.flatten("rings")).cast("bigint")).alias("points"),
        F.min("place_id").alias("first_place"),
        F.max("place_id").alias("last_place"),
    )


@query(
    "buffer_area",
    X.with_sql("shapes") + "SELECT shape_id, form, round(own + border * 0.25 + corners * 4 * 0.0625 * sin(pi() / 16) - notch, 1) + 0 AS area"
    " FROM (SELECT shape_id, form, w * h * CASE form WHEN 0 THEN 1 WHEN 1 THEN 0.5 WHEN 2 THEN 0.75 ELSE 0 END AS own,"
    " CASE form WHEN 1 THEN 2 * sqrt(w * w + h * h) WHEN 3 THEN 2 * sqrt(w * w + h * h) ELSE 2 * (w + h) END AS border,"
    " CASE form WHEN 2 THEN 5 ELSE 4 END AS corners, CASE form WHEN 2 THEN 0.0625 ELSE 0 END AS notch FROM shapes)",
)
def buffer_area(spark, d):
    """Area within 0.25 of a shape: its own, its border times 0.25 and quarter discs at outer corners."""
    grown = O.buffer_areas(spread(X.shapes(spark, d).select("shape_id", "form", "geom"), "shape_id"), ["shape_id", "form"], 0.03125, F.lit(0.25))
    return grown.select("shape_id", "form", rounded(F.col("area"), 1).alias("area"))


@query(
    "ring_is_simple",
    X.with_sql("shapes") + "SELECT shape_id, form IN (0, 2) AS simple FROM shapes",
)
def ring_is_simple(spark, d):
    """Rings whose edges cross; the corners of form 1 are taken in crossed order."""
    x0, y0, w, h = (F.col(c) for c in ("x0", "y0", "w", "h"))
    crossed = G.make_polygon(F.array(G.xy(x0, y0), G.xy(x0 + w, y0 + h), G.xy(x0 + w, y0), G.xy(x0, y0 + h)))
    rings = X.shapes(spark, d).withColumn("geom", F.when(F.col("form") == 1, crossed).otherwise(GEOM))
    return H.simple_rings(rings.select("shape_id", "geom"), "shape_id", 0.5)


_OVER = "(least(gxmax, xmax) > greatest(gxmin, xmin) AND least(gymax, ymax) > greatest(gymin, ymin))"
_NEAR = "(least(gxmax, xmax) >= greatest(gxmin, xmin) AND least(gymax, ymax) >= greatest(gymin, ymin))"
_A_IN_B = "(gxmin >= xmin AND gxmax <= xmax AND gymin >= ymin AND gymax <= ymax)"
_B_IN_A = "(xmin >= gxmin AND xmax <= gxmax AND ymin >= gymin AND ymax <= gymax)"
_A_EDGE_IN_B = "(gxmin > xmin AND gxmin < xmax OR gxmax > xmin AND gxmax < xmax OR gymin > ymin AND gymin < ymax OR gymax > ymin AND gymax < ymax)"
_B_EDGE_IN_A = "(xmin > gxmin AND xmin < gxmax OR xmax > gxmin AND xmax < gxmax OR ymin > gymin AND ymin < gymax OR ymax > gymin AND ymax < gymax)"
_SAME_SIDE = "(gxmin = xmin OR gxmax = xmax OR gymin = ymin OR gymax = ymax)"
_STRICT = "(gxmin > xmin AND gxmax < xmax AND gymin > ymin AND gymax < ymax OR xmin > gxmin AND xmax < gxmax AND ymin > gymin AND ymax < gymax)"


@query(
    "relate_polygons",
    _BOXES + f"SELECT entity_id, place_id, CASE WHEN NOT {_NEAR} THEN 'FF2FF1212' WHEN NOT {_OVER} THEN"
    " CASE WHEN least(gxmax, xmax) > greatest(gxmin, xmin) OR least(gymax, ymax) > greatest(gymin, ymin) THEN 'FF2F11212' ELSE 'FF2F01212' END"
    f" ELSE '2' || CASE WHEN {_B_EDGE_IN_A} THEN '1' ELSE 'F' END || CASE WHEN {_A_IN_B} THEN 'F' ELSE '2' END"
    f" || CASE WHEN {_A_EDGE_IN_B} THEN '1' ELSE 'F' END || CASE WHEN {_SAME_SIDE} THEN '1' WHEN {_STRICT} THEN 'F' ELSE '0' END || CASE WHEN {_A_IN_B} THEN 'F' ELSE '1' END"
    f" || CASE WHEN {_B_IN_A} THEN 'F' ELSE '2' END || CASE WHEN {_B_IN_A} THEN 'F' ELSE '1' END || '2' END AS matrix FROM boxes",
)
def relate_polygons(spark, d):
    return _gold_place_pairs(spark, d).select("entity_id", "place_id", relate.matrix(E.col("gold"), E.col("place")).alias("matrix"))
