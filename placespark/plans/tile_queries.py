"""Tiles, rasters, relation features and geodesic functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from placespark import fixtures as X
from placespark.functions import exprs as E
from placespark.functions import features as R
from placespark.functions import geodesy as D
from placespark.functions import geom as G
from placespark.functions import lexicon as L
from placespark.functions import tiles as T
from placespark.operators import raster
from placespark.operators.layout import spread
from placespark.plans.catalog import query, rounded
from placespark.plans.geometry_queries import _BOXES, _gold_place_pairs, _paired, _place_box
from placespark.sources.tables import table

GEOM = E.col("geom")
LIMITS = (0.0, 0.0, 31.75, 19.75)
N = 16
_NX = "((2e0 * x - 31.75e0) / 31.75e0)"
_NY = "((2e0 * y - 19.75e0) / 19.75e0)"
PX, PY = E.col("x"), E.col("y")


@query("normalize_coord", X.with_sql("pings") + f"SELECT ping_id, round({_NX}, 6) + 0 AS nx, round({_NY}, 6) + 0 AS ny FROM pings")
def normalize_coord(spark, d):
    n = X.pings(spark, d).select("ping_id", T.normalize(PX, PY, LIMITS).alias("n"))
    return n.select("ping_id", rounded(F.col("n.x")).alias("nx"), rounded(F.col("n.y")).alias("ny"))


@query("tile_index_relative", X.with_sql("pings") + f"SELECT ping_id, least(CAST(trunc(({_NX} + 1) / 0.125e0) AS BIGINT), 15) + 16 * least(CAST(trunc(-({_NY} - 1) / 0.125e0) AS BIGINT), 15) AS tile FROM pings")
def tile_index_relative(spark, d):
    return X.pings(spark, d).select("ping_id", T.tile_index_relative(PX, PY, N, LIMITS).alias("tile"))


_TX, _TY = "(event_id % 256 - 16 * ((event_id % 256) // 16))", "((event_id % 256) // 16)"


@query("tile_center", f"SELECT event_id, (-1 + {_TX} * 0.125e0 + 0.0625e0) * 180 AS lon, (1 - {_TY} * 0.125e0 - 0.0625e0) * 90 AS lat FROM events")
def tile_center(spark, d):
    c = table(spark, d, "events").select("event_id", T.tile_center(E.expr("event_id % 256"), N).alias("c"))
    return c.select("event_id", F.col("c.x").alias("lon"), F.col("c.y").alias("lat"))


@query(
    "tile_corners",
    f"SELECT event_id, CAST(k AS BIGINT) AS corner, (-1 + ({_TX} + CASE WHEN k IN (1, 2) THEN 1 ELSE 0 END) * 0.125e0) * 180 AS lon, (1 - ({_TY} + CASE WHEN k >= 2 THEN 1 ELSE 0 END) * 0.125e0) * 90 AS lat FROM events, (SELECT unnest(range(4)) AS k)",
)
def tile_corners(spark, d):
    c = table(spark, d, "events").select("event_id", F.posexplode(T.tile_corners(E.expr("event_id % 256"), N)).alias("corner", "c"))
    return c.select("event_id", F.col("corner").cast("bigint").alias("corner"), F.col("c.x").alias("lon"), F.col("c.y").alias("lat"))


_LON, _LAT = "(CAST((c_custkey * 37) % 400 AS DOUBLE) - 200)", "(CAST((c_custkey * 53) % 200 AS DOUBLE) - 95)"


@query(
    "world_tile_index",
    f"SELECT c_custkey, CASE WHEN i BETWEEN 0 AND 10368 THEN i END AS tile FROM (SELECT c_custkey, 144 * CAST(trunc(abs(CASE WHEN {_LAT} <> -90 THEN {_LAT} - 90 ELSE -179.99e0 END) / 2.5e0) AS BIGINT)"
    f" + CAST(trunc(abs(CASE WHEN {_LON} <> 180 THEN {_LON} + 180 ELSE 359.99e0 END) / 2.5e0) AS BIGINT) AS i FROM customer)",
)
def world_tile_index(spark, d):
    return table(spark, d, "customer").selectExpr("c_custkey", f"{_LON} AS lon", f"{_LAT} AS lat").select(
        "c_custkey", T.world_tile_index(E.col("lon"), E.col("lat"), 2.5).alias("tile")
    )


_WROW, _WCOL = "((c_custkey * 7) % 2592 // 72)", "((c_custkey * 7) % 2592 % 72)"


@query(
    "world_tile_coord",
    f"SELECT c_custkey, CAST(({_WCOL} - 36) * 5 AS BIGINT) AS lon, CAST((18 - {_WROW}) * 5 AS BIGINT) AS lat FROM customer",
)
def world_tile_coord(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.world_tile_coord(E.expr("(c_custkey * 7) % 2592"), 5).alias("c")).select("c_custkey", "c.*")


@query(
    "bounded_grid",
    X.with_sql("places") + "SELECT place_id, CAST(i + 1 AS BIGINT) AS xi, CAST(j + 1 AS BIGINT) AS yi, xmin + i * ((xmax - xmin) / 4) AS x0, ymax - (j + 1) * ((ymax - ymin) / 4) AS y0 FROM places, (SELECT unnest(range(4)) AS i), (SELECT unnest(range(4)) AS j)",
)
def bounded_grid(spark, d):
    cells = T.grid(E.col("xmin"), E.col("ymin"), E.col("xmax"), E.col("ymax"), 4)
    return X.places(spark, d).select("place_id", F.explode(cells).alias("c")).select(
        "place_id", F.col("c.xi").cast("bigint").alias("xi"), F.col("c.yi").cast("bigint").alias("yi"), "c.x0", "c.y0"
    )


CELL = 0.5
_TOUCHED = (
    "touched AS (SELECT place_id, xi, unnest(range(CAST(floor(ymin / 5e-1) AS BIGINT), CAST(ceil(ymax / 5e-1) AS BIGINT))) AS yi FROM"
    " (SELECT *, unnest(range(CAST(floor(xmin / 5e-1) AS BIGINT), CAST(ceil(xmax / 5e-1) AS BIGINT))) AS xi FROM places))"
)


def _touched(spark, d):
    return raster.rasterize_touched(X.place_shapes(spark, d).select("place_id", "geom"), ["place_id"], CELL)


@query("rasterize_touched", X.with_sql("places")[:-1] + f", {_TOUCHED} SELECT * FROM touched")
def rasterize_touched(spark, d):
    return _touched(spark, d)


@query("raster_union_max", X.with_sql("places")[:-1] + f", {_TOUCHED} SELECT xi, yi, max(place_id % 5) AS v FROM touched GROUP BY ALL")
def raster_union_max(spark, d):
    return raster.union_max(_touched(spark, d).withColumn("v", F.col("place_id") % 5), [])


@query("bitmap_to_geometry_area", X.with_sql("places")[:-1] + f", {_TOUCHED} SELECT cardinal, round(count(DISTINCT (xi, yi)) * 0.25, 6) + 0 AS area FROM touched JOIN places USING (place_id) WHERE place_id % 5 > 0.5 GROUP BY ALL")
def bitmap_to_geometry_area(spark, d):
    """Area of the cells above the threshold, united over all places of a side."""
    cells = _touched(spark, d).join(X.places(spark, d).select("place_id", "cardinal"), "place_id").withColumn("v", F.col("place_id") % 5)
    return raster.cells_area(raster.union_max(cells, ["cardinal"]), ["cardinal"], CELL).select("cardinal", rounded(F.col("area")).alias("area"))


@query("pixel_polygon", X.with_sql("places")[:-1] + f", {_TOUCHED} SELECT place_id, xi, yi, CAST(5 AS BIGINT) AS points, xi * 5e-1 AS xmin, (yi + 1) * 5e-1 AS ymax FROM touched")
def pixel_polygon(spark, d):
    square = G.box(E.expr("xi * 0.5D"), E.expr("yi * 0.5D"), E.expr("(xi + 1) * 0.5D"), E.expr("(yi + 1) * 0.5D"))
    return _touched(spark, d).select("place_id", "xi", "yi", square.alias("g")).select(
        "place_id", "xi", "yi", G.num_points(E.col("g")).alias("points"), G.bounds(E.col("g"))["xmin"].alias("xmin"), G.bounds(E.col("g"))["ymax"].alias("ymax")
    )


@query("colored_cells", X.with_sql("places")[:-1] + f", {_TOUCHED} SELECT place_id, xi, yi, 200 AS red, 100 AS green, 50 AS blue FROM touched")
def colored_cells(spark, d):
    colour = F.array(F.lit(200), F.lit(100), F.lit(50))
    return _touched(spark, d).withColumn("colour", colour).select(
        "place_id", "xi", "yi", *[F.get("colour", F.lit(k)).alias(n) for k, n in enumerate(("red", "green", "blue"))]
    )


# ---- features ------------------------------------------------------------------------------------


@query("frexp10", "SELECT l_orderkey, l_partkey, l_linenumber, round(l_extendedprice / 10 ** e, 8) + 0 AS m, e FROM (SELECT *, CAST(trunc(log10(l_extendedprice)) AS INT) AS e FROM lineitem)")
def frexp10(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", R.frexp10(E.col("l_extendedprice")).alias("f")).select(
        "l_orderkey", "l_partkey", "l_linenumber", rounded(F.col("f.m"), 8).alias("m"), "f.e"
    )


_SIZE = "CASE form WHEN 0 THEN w * h WHEN 1 THEN w * h / 2 WHEN 2 THEN w * h * 75e-2 ELSE 0 END * 1000000 + CASE form WHEN 3 THEN sqrt(w * w + h * h) * 1000 ELSE 0 END"


@query("geometry_size", X.with_sql("shapes") + f"SELECT shape_id, CAST(trunc(s / 10 ** e) AS BIGINT) AS m, e FROM (SELECT shape_id, {_SIZE} AS s, CAST(trunc(log10({_SIZE})) AS INT) AS e FROM shapes)")
def geometry_size(spark, d):
    return X.shapes(spark, d).select("shape_id", R.geometry_size(GEOM).alias("s")).select("shape_id", "s.*")


def _middle(p):
    return G.xy(E.expr(f"({p}xmin + {p}xmax) / 2"), E.expr(f"({p}ymin + {p}ymax) / 2"))


_DX, _DY = "((xmin + xmax) / 2 - (gxmin + gxmax) / 2)", "((ymin + ymax) / 2 - (gymin + gymax) / 2)"
_AZ = f"(CASE WHEN {_DX} <> 0 OR {_DY} <> 0 THEN degrees(atan2({_DX}, {_DY})) + CASE WHEN atan2({_DX}, {_DY}) < 0 THEN 360 ELSE 0 END END)"


@query("azimuth_sector", _BOXES + f"SELECT entity_id, place_id, CAST(floor(({_AZ} + 22.5) / 45) AS BIGINT) AS sector FROM boxes")
def azimuth_sector(spark, d):
    return _gold_place_pairs(spark, d).select("entity_id", "place_id", R.azimuth_sector(_middle("g"), _middle("")).alias("sector"))


@query("distance_bucket", _BOXES[:-1] + f", away AS (SELECT entity_id, place_id, sqrt({_DX} * {_DX} + {_DY} * {_DY}) * 1000 AS v FROM boxes), e AS (SELECT *, CASE WHEN v > 0 THEN CAST(trunc(log10(v)) AS INT) END AS e FROM away) SELECT entity_id, place_id, CAST(trunc(v / 10 ** e) AS BIGINT) AS m, e FROM e")
def distance_bucket(spark, d):
    return _gold_place_pairs(spark, d).select("entity_id", "place_id", R.distance_bucket(_middle("g"), _middle("")).alias("b")).select(
        "entity_id", "place_id", "b.m", "b.e"
    )


_M, _E, _S = "(1 + ping_id % 9)", "(ping_id % 4)", "(ping_id % 8)"


@query("project_centroid", X.with_sql("pings") + f"SELECT ping_id, round(x + {_M} * 10 ** {_E} / 1000 * sin(radians({_S} * 45)), 6) + 0 AS x, round(y + {_M} * 10 ** {_E} / 1000 * cos(radians({_S} * 45)), 6) + 0 AS y FROM pings")
def project_centroid(spark, d):
    moved = R.project_centroid(G.xy(PX, PY), E.expr(_M), E.expr(_E), E.expr(_S))
    return X.pings(spark, d).select("ping_id", moved.alias("p")).select("ping_id", rounded(F.col("p.x")).alias("x"), rounded(F.col("p.y")).alias("y"))


@query("buffer_centroid_area", X.with_sql("pings") + f"SELECT ping_id, round(16 * sin(pi() / 16) * CASE ping_id % 2 WHEN 0 THEN {_M} * 10 ** {_E} / pi() / 1e6 ELSE ({_M} * 10 ** {_E} / 2000) ** 2 END, 6) + 0 AS area FROM pings")
def buffer_centroid_area(spark, d):
    disc = R.buffer_centroid(G.xy(PX, PY), E.expr("ping_id % 2 = 0"), E.expr(_M), E.expr(_E))
    return X.pings(spark, d).select("ping_id", rounded(G.area(disc)).alias("area"))


_MATRICES = (("2FFF1FFF2", "Equals"), ("FF2FF1212", "Disjoint"), ("212FF1FF2", "Contains"), ("2FF1FF212", "Within"), ("FF2F11212", "Touches"), ("212101212", "Intersects"))


def _case(index):
    return "CASE c_custkey % 6 " + " ".join(f"WHEN {k} THEN '{m[index]}'" for k, m in enumerate(_MATRICES)) + " END"


@query("relation_class", f"SELECT c_custkey, {_case(0)} AS matrix, {_case(1)} AS relation FROM customer")
def relation_class(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.expr(_case(0)).alias("matrix")).select(
        "c_custkey", "matrix", R.relation_class(E.col("matrix")).alias("relation")
    )


@query("unit_to_meters", "SELECT l_orderkey, l_partkey, l_linenumber, round(l_quantity * CASE l_returnflag WHEN 'A' THEN 1000 WHEN 'N' THEN 1609.344e0 ELSE 1852 END, 6) + 0 AS meters FROM lineitem")
def unit_to_meters(spark, d):
    from placespark.operators.locations import meters

    unit = F.when(F.col("l_returnflag") == "A", "KM").when(F.col("l_returnflag") == "N", "MI").otherwise("NMI")
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", rounded(meters(F.col("l_quantity"), unit)).alias("meters"))


_CARDINALS = "['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW', 'C']"


@query("cardinal_azimuth", f"SELECT c_custkey, {_CARDINALS}[1 + c_custkey % 9] AS cardinal, CASE c_custkey % 9 WHEN 8 THEN -1e0 ELSE (c_custkey % 9) * 45e0 END AS azimuth FROM customer")
def cardinal_azimuth(spark, d):
    from placespark.operators.locations import azimuth_of

    return _customer_cardinals(spark, d).withColumn("azimuth", azimuth_of(F.col("cardinal")))


@query("cardinal_opposite", f"SELECT c_custkey, {_CARDINALS}[1 + c_custkey % 9] AS cardinal, CASE WHEN c_custkey % 9 < 8 THEN {_CARDINALS}[1 + (c_custkey % 9 + 4) % 8] END AS opposite FROM customer")
def cardinal_opposite(spark, d):
    from placespark.operators.locations import opposite_of

    return _customer_cardinals(spark, d).withColumn("opposite", opposite_of(F.col("cardinal")))


def _customer_cardinals(spark, d):
    names = F.array(*[F.lit(c) for c in L.AZIMUTHS])
    return table(spark, d, "customer").select("c_custkey", F.get(names, (F.col("c_custkey") % 9).cast("int")).alias("cardinal"))


# ---- geodesic ------------------------------------------------------------------------------------

_FL = "(1 / 298.257223563e0)"
_B = f"(6378137e0 * (1 - {_FL}))"


def _inverse_sql(source: str, keys: str) -> str:
    """Distance of (ax, ay) to (qx, qy) of a relation, with the rounds of the iteration as nested queries."""
    parts = (
        "sqrt((c2 * sin(lam)) ** 2 + (c1 * s2 - s1 * c2 * cos(lam)) ** 2) AS ss, s1 * s2 + c1 * c2 * cos(lam) AS cs"
    )
    q = f"SELECT {keys}, (ax = qx AND ay = qy) AS same, radians(qx - ax) AS l, radians(qx - ax) AS lam, sin(u1) AS s1, cos(u1) AS c1, sin(u2) AS s2, cos(u2) AS c2 FROM (SELECT *, atan(tan(radians(ay)) * (1 - {_FL})) AS u1, atan(tan(radians(qy)) * (1 - {_FL})) AS u2 FROM {source})"
    base = f"{keys}, same, l, s1, c1, s2, c2"
    for k in range(D.ROUNDS + 1):
        q = f"SELECT {base}, lam, ss, cs, sa, 1 - sa * sa AS c2a, coalesce(cs - 2 * s1 * s2 / nullif(1 - sa * sa, 0), 0) AS c2m FROM (SELECT *, c1 * c2 * sin(lam) / nullif(ss, 0) AS sa FROM (SELECT *, {parts} FROM ({q})))"
        if k < D.ROUNDS:
            q = f"SELECT {base}, l + (1 - c) * {_FL} * sa * (atan2(ss, cs) + c * ss * (c2m + c * cs * (2 * c2m * c2m - 1))) AS lam FROM (SELECT *, c2a * ({_FL} / 16) * (4 + {_FL} * (4 - 3 * c2a)) AS c FROM ({q}))"
    series = f"SELECT *, 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2))) AS aa, u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2))) AS bb FROM (SELECT *, c2a * (6378137e0 ** 2 - {_B} ** 2) / {_B} ** 2 AS u2 FROM ({q}))"
    return (
        f"SELECT {keys}, CASE WHEN same THEN 0 ELSE aa * {_B} * (atan2(ss, cs) - bb * ss * (c2m + bb / 4 * (cs * (2 * c2m * c2m - 1) - bb / 6 * c2m * (4 * ss * ss - 3) * (4 * c2m * c2m - 3)))) END AS metres FROM ({series})"
    )


@query("geodesic_distance", _BOXES[:-1] + f", ends AS (SELECT entity_id, place_id, (gxmin + gxmax) / 2 AS ax, (gymin + gymax) / 2 AS ay, (xmin + xmax) / 2 AS qx, (ymin + ymax) / 2 AS qy FROM boxes), found AS ({_inverse_sql('ends', 'entity_id, place_id')}) SELECT entity_id, place_id, round(metres, 2) + 0 AS metres FROM found")
def geodesic_distance(spark, d):
    return _gold_place_pairs(spark, d).select("entity_id", "place_id", rounded(D.geodesic_distance(_middle("g"), _middle("")), 2).alias("metres"))


_DIAGONALS = f"corners2 AS (SELECT shape_id, form, w, h, x0 AS ax, y0 AS ay, x0 + w AS qx, y0 + h AS qy FROM shapes), found AS ({_inverse_sql('corners2', 'shape_id')})"


@query("geom_diagonal", X.with_sql("shapes")[:-1] + f", {_DIAGONALS} SELECT shape_id, round(metres, 2) + 0 AS metres FROM found")
def geom_diagonal(spark, d):
    return X.shapes(spark, d).select("shape_id", rounded(D.diagonal(G.bounds(GEOM)), 2).alias("metres"))


@query("buffer_radius", X.with_sql("shapes")[:-1] + f", {_DIAGONALS} SELECT shape_id, round((metres * 5 - metres) / 400000, 6) + 0 AS radius FROM found")
def buffer_radius(spark, d):
    return X.shapes(spark, d).select("shape_id", rounded(D.buffer_radius(D.diagonal(G.bounds(GEOM)), 5.0)).alias("radius"))


def _direct_sql(source: str, keys: str) -> str:
    """Destination of (ax, ay) after ``dist`` metres at ``az`` degrees."""
    q = f"SELECT *, sin(u) AS su, cos(u) AS cu, sin(radians(az)) AS sa, cos(radians(az)) AS ca FROM (SELECT *, atan(tan(radians(ay)) * (1 - {_FL})) AS u FROM {source})"
    q = f"SELECT *, 1 - sna * sna AS c2a, atan2(su / cu, ca) AS sg1 FROM (SELECT *, cu * sa AS sna FROM ({q}))"
    q = f"SELECT *, 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2))) AS aa, u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2))) AS bb FROM (SELECT *, c2a * (6378137e0 ** 2 - {_B} ** 2) / {_B} ** 2 AS u2 FROM ({q}))"
    q = f"SELECT *, dist / ({_B} * aa) AS s0, dist / ({_B} * aa) AS s FROM ({q})"
    delta = "bb * sin(s) * (cos(2 * sg1 + s) + bb / 4 * (cos(s) * (2 * cos(2 * sg1 + s) ** 2 - 1) - bb / 6 * cos(2 * sg1 + s) * (4 * sin(s) ** 2 - 3) * (4 * cos(2 * sg1 + s) ** 2 - 3)))"
    for _ in range(D.ROUNDS):
        q = f"SELECT * EXCLUDE (s), s0 + {delta} AS s FROM ({q})"
    c = f"(c2a * ({_FL} / 16) * (4 + {_FL} * (4 - 3 * c2a)))"
    return (
        f"SELECT {keys}, ax + degrees(atan2(sin(s) * sa, cu * cos(s) - su * sin(s) * ca) - (1 - {c}) * {_FL} * sna * (s + {c} * sin(s) * (cos(2 * sg1 + s) + {c} * cos(s) * (2 * cos(2 * sg1 + s) ** 2 - 1)))) AS x,"
        f" degrees(atan2(su * cos(s) + cu * sin(s) * ca, (1 - {_FL}) * sqrt(sna * sna + (su * sin(s) - cu * cos(s) * ca) ** 2))) AS y FROM ({q})"
    )


@query("geodesic_destination", X.with_sql("pings")[:-1] + f", starts AS (SELECT ping_id, x AS ax, y AS ay, (1 + ping_id % 50) * 2000e0 AS dist, (ping_id % 36) * 10e0 AS az FROM pings), found AS ({_direct_sql('starts', 'ping_id')}) SELECT ping_id, round(x, 6) + 0 AS x, round(y, 6) + 0 AS y FROM found")
def geodesic_destination(spark, d):
    end = D.geodesic_destination(G.xy(PX, PY), E.expr("(1 + ping_id % 50) * 2000D"), E.expr("(ping_id % 36) * 10D"))
    return spread(X.pings(spark, d)).select("ping_id", end.alias("p")).select("ping_id", rounded(F.col("p.x")).alias("x"), rounded(F.col("p.y")).alias("y"))


@query("distance_arc", X.with_sql("places")[:-1] + f", starts AS (SELECT place_id, k, (xmin + xmax) / 2 AS ax, (ymin + ymax) / 2 AS ay, 25000e0 AS dist, 90e0 - 45 + k * 10 AS az FROM places, (SELECT unnest(range(10)) AS k)), found AS ({_direct_sql('starts', 'place_id, k')}) SELECT place_id, CAST(k AS BIGINT) AS n, round(x, 6) + 0 AS x, round(y, 6) + 0 AS y FROM found")
def distance_arc(spark, d):
    arc = D.arc_points(_middle(""), E.lit(25000.0), E.lit(90.0))
    return X.places(spark, d).select("place_id", F.posexplode(arc).alias("n", "p")).select(
        "place_id", F.col("n").cast("bigint").alias("n"), rounded(F.col("p.x")).alias("x"), rounded(F.col("p.y")).alias("y")
    )


_T = "least(coalesce(({x1} - {x0}) / 2 / nullif(abs(dy), 0), 1e18), coalesce(({y1} - {y0}) / 2 / nullif(abs(dx), 0), 1e18)) * len"


@query(
    "between_polygon",
    _BOXES[:-1] + f", ways AS (SELECT *, {_DX} AS dx, {_DY} AS dy, sqrt({_DX} * {_DX} + {_DY} * {_DY}) AS len FROM boxes)"
    f" SELECT entity_id, place_id, round(CASE WHEN len > 0 THEN ({_T.format(x0='gxmin', x1='gxmax', y0='gymin', y1='gymax')} + {_T.format(x0='xmin', x1='xmax', y0='ymin', y1='ymax')}) * len END, 10) + 0 AS area FROM ways",
)
def between_polygon(spark, d):
    """Area between an entity's gold box and a place; centres are found once for each box, before boxes are paired."""
    places = spread(X.places(spark, d), "place_id").withColumn("place_center", G.centroid(_place_box()))
    entities = spread(X.entities(spark, d), "entity_id").withColumn("gold_center", G.centroid(X.gold_box()))
    ring = D.between(E.col("gold"), E.col("place"), E.col("gold_center"), E.col("place_center"))
    return _paired(spark, d, places, entities).select("entity_id", "place_id", ring.alias("g")).select("entity_id", "place_id", rounded(G.area(E.col("g")), 10).alias("area"))
