"""The location operators, evaluated over scanline spans; whole expressions are evaluated by ``resolve``.

Every shape is a set of spans (key, h, row, x0, x1): row r of a key covers [r*h, (r+1)*h). The row
height h belongs to the key and is a power of two, so shapes of one expression share their rows and
set operations need no second scan conversion. Operators take and return such DataFrames and shuffle
by (key, row); per key only a centre, an extent and a cut line are summed up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placespark.functions import exprs as E
from placespark.functions import geodesy as D
from placespark.functions import geom as G
from placespark.functions import lexicon as X
from placespark.operators import overlay as O
from placespark.operators.layout import spread
from placespark.operators.score import as_area

GROUP = ["key", "h"]

# Widths in degrees around points and lines, cardinal arcs, near places and routes.
POINT_BUFFER = 0.02
ARC_BUFFER = 0.05
NEAR_BUFFER = 0.1
ROUTE_BUFFER = 0.001
# Rows fine enough for the strip along a route.
ROUTE_HEIGHT = 2.0**-12
# How far cardinal arcs and centers reach in diagonals, and buffer factors.
ARC_REACH = 2.0
CENTER_SHARE = 3.0
ADJACENT_FACTOR = 5.0
DISTANCE_FACTOR = 2.0


def _table(values: dict) -> Column:
    return F.create_map(*[F.lit(v) for pair in values.items() for v in pair])


def meters(distance: Column, unit: Column) -> Column:
    return distance * F.try_element_at(_table(X.UNIT_METERS), unit)


def azimuth_of(cardinal: Column) -> Column:
    return F.try_element_at(_table(X.AZIMUTHS), cardinal)


def opposite_of(cardinal: Column) -> Column:
    """Opposite cardinal; null for the center, which has none."""
    return F.try_element_at(_table(X.OPPOSITES), cardinal)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store a result that several later steps read, so that none of them computes it again.

    The folder is spark.checkpoint.dir, or one in the warehouse where that is unset; all executors see both."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")
    return df.checkpoint()


def row_height(b: Column, rows: int) -> Column:
    """Power of two that gives a box at least ``rows`` rows, however wide it is; a level line has the least height."""
    size = E.greatest(b["ymax"] - b["ymin"], E.lit(1e-6))
    return E.power(E.lit(2.0), E.floor(E.function("log2")(size / rows)))


# ---- building blocks -----------------------------------------------------------------------------


def leaf(shapes: DataFrame, rows: int = 64) -> DataFrame:
    """Spans of (key, geom) rows, several per key being united; points and lines get a small width."""
    shapes = spread(shapes, "key")  # a few rows of a file become many of each shape
    sized = shapes.withColumn("_b", G.bounds(E.col("geom")))
    extents = sized.groupBy("key").agg(
        F.struct(
            F.min("_b.xmin").alias("xmin"), F.min("_b.ymin").alias("ymin"), F.max("_b.xmax").alias("xmax"), F.max("_b.ymax").alias("ymax")
        ).alias("b")
    )
    return leaf_at(shapes.join(extents.select("key", row_height(E.col("b"), rows).alias("h")), "key"))


def leaf_at(shapes: DataFrame) -> DataFrame:
    """Spans of (key, h, geom) rows."""
    h = F.col("h")
    shapes = spread(shapes.select("key", "h", "geom"), "key")
    areas = O.crossings(O.edges(shapes), h)
    thin = shapes.where(~G.is_area(E.col("geom"))).select("key", "h", "geom")
    widened = O.span_events(O.capsule_spans(O.outline_segments(thin), h, F.lit(POINT_BUFFER)))
    events = areas.select(*GROUP, "row", "x", "d").unionByName(widened.select(*GROUP, "row", "x", "d"))
    runs = O.sweep(O.slot_events(events, GROUP, {"all": F.lit(True)}), GROUP, ["all"])
    return O.merged_spans(runs, GROUP, F.col("n_all") > 0)


def summary(spans: DataFrame) -> DataFrame:
    """Per key: area, centre, extent and geodesic diagonal of its spans."""
    w, mid = O.width(), (F.col("row") + 0.5) * F.col("h")
    sums = spans.groupBy(*GROUP).agg(
        F.sum(w * F.col("h")).alias("area"),
        F.struct(
            (F.sum(w * (F.col("x0") + F.col("x1")) / 2) / F.sum(w)).alias("x"), (F.sum(w * mid) / F.sum(w)).alias("y")
        ).alias("o"),
        F.struct(
            F.min("x0").alias("xmin"), F.min(F.col("row") * F.col("h")).alias("ymin"),
            F.max("x1").alias("xmax"), F.max((F.col("row") + 1) * F.col("h")).alias("ymax"),
        ).alias("b"),
    )
    return sums.withColumn("diagonal", D.diagonal(E.col("b")))


def area_of(spans: DataFrame) -> DataFrame:
    return spans.groupBy("key").agg(F.sum(O.width() * F.col("h")).alias("area"))


def combine(a: DataFrame, b: DataFrame, inside: str, b_is_spans: bool = True) -> DataFrame:
    """Set operation of spans a with spans or crossings b; ``inside`` is a condition on n_a and n_b."""
    events_a = O.span_events(a.select(*GROUP, "row", "x0", "x1")).withColumn("side", F.lit("a"))
    events_b = (O.span_events(b.select(*GROUP, "row", "x0", "x1")) if b_is_spans else b.select(*GROUP, "row", "x", "d")).withColumn(
        "side", F.lit("b")
    )
    slots = {"a": F.col("side") == "a", "b": F.col("side") == "b"}
    runs = O.sweep(O.slot_events(events_a.unionByName(events_b), GROUP, slots), GROUP, ["a", "b"])
    return O.merged_spans(runs, GROUP, F.expr(inside))


def _ring_crossings(regions: DataFrame) -> DataFrame:
    """Crossings of (key, h, geom) areas on their own rows."""
    return O.crossings(O.edges(regions.select("key", "h", "geom")), F.col("h"))


def cut_by_line(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """(key, lo, hi): where the line o + t*u of a key enters and leaves its spans; 0, 0 when it misses them."""
    joined = spans.join(lines.select("key", "o", "u"), "key")
    y0, y1 = F.col("row") * F.col("h"), (F.col("row") + 1) * F.col("h")
    ux, uy = F.nullif(F.col("u.x"), F.lit(0.0)), F.nullif(F.col("u.y"), F.lit(0.0))
    ta, tb = (F.col("x0") - F.col("o.x")) / ux, (F.col("x1") - F.col("o.x")) / ux
    tc, td = (y0 - F.col("o.y")) / uy, (y1 - F.col("o.y")) / uy
    in_x = ux.isNotNull() | ((F.col("o.x") >= F.col("x0")) & (F.col("o.x") <= F.col("x1")))
    in_y = uy.isNotNull() | ((F.col("o.y") >= y0) & (F.col("o.y") <= y1))
    met = joined.where(in_x & in_y).select(
        "key", F.greatest(F.least(ta, tb), F.least(tc, td)).alias("lo"), F.least(F.greatest(ta, tb), F.greatest(tc, td)).alias("hi")
    )
    ends = met.where("lo <= hi").groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return lines.select("key").join(ends, "key", "left").select(
        "key", F.struct(F.coalesce("lo", F.lit(0.0)).alias("lo"), F.coalesce("hi", F.lit(0.0)).alias("hi")).alias("cut")
    )


def arc_band(o: Column, arc: Column, radius: float) -> Column:
    """Outline of everything within ``radius`` of an arc around o, with round ends.

    When the radius reaches past o the inner border is gone and the round ends meet behind o."""
    mitre = 1.0038198375433474
    pi = 3.141592653589793

    def outline(p):
        out = lambda q: E.let(G.distance_points(o, q), lambda n: G.xy((q["x"] - o["x"]) / n, (q["y"] - o["y"]) / n))
        outer = E.transform(p, lambda q: E.let(out(q), lambda n: G.xy(q["x"] + radius * mitre * n["x"], q["y"] + radius * mitre * n["y"])))
        inner = E.transform(E.reverse(p), lambda q: E.let(out(q), lambda n: G.xy(q["x"] - radius * mitre * n["x"], q["y"] - radius * mitre * n["y"])))
        reach = G.distance_points(o, E.element_at(p, 1))
        hollow = reach > radius
        sweep = E.when(hollow, E.lit(pi)).otherwise(0.75 * pi + E.asin(E.least(reach * 0.7071067811865476 / radius, E.lit(1.0))))

        def cap(q, sign):
            start = E.atan2(q["y"] - o["y"], q["x"] - o["x"])
            return E.let(
                E.struct(start.alias("s"), sweep.alias("w")),
                lambda k: E.transform(
                    E.sequence(E.lit(1), E.lit(15)),
                    lambda i: G.xy(q["x"] + radius * E.cos(k["s"] + sign * k["w"] * i / 16), q["y"] + radius * E.sin(k["s"] + sign * k["w"] * i / 16)),
                ),
            )

        return E.concat(
            outer, cap(E.element_at(p, -1), -1.0), E.when(hollow, inner).otherwise(E.array().cast("array<struct<x:double,y:double>>")),
            E.reverse(cap(E.element_at(p, 1), 1.0)),
        )

    return G.make_polygon(E.let(arc, outline))


def cardinal_regions(spans: DataFrame, cardinals: DataFrame) -> DataFrame:
    """(key, h, geom): the part of the world that lies to a side of each key's shape.

    For a side, the area from the cut across the shape's centre to an arc twice its diagonal away; for
    the center, the disc of a third of its diagonal."""
    known = summary(spans).join(cardinals.select("key", azimuth_of(F.col("cardinal")).alias("azimuth")), "key")
    o, diagonal = E.col("o"), E.col("diagonal")
    center = E.col("azimuth") < 0
    disc = G.make_polygon(D.arc_points(o, diagonal / CENTER_SHARE))
    band = arc_band(o, D.arc_points(o, diagonal * ARC_REACH, E.col("azimuth")), ARC_BUFFER)
    reach = known.withColumn("band", E.when(center, disc).otherwise(band)).withColumn("c", G.centroid(E.col("band")))
    lines = reach.withColumn("u", E.when(~center, D.direction(o, E.col("c"))))
    cuts = cut_by_line(spans, lines.where("azimuth >= 0"))
    ring = D.between_ring(o, E.col("cut"), E.col("c"), D.line_span(E.col("band"), E.col("c"), E.col("u")), E.col("u"))
    return lines.join(cuts, "key", "left").select(*GROUP, E.when(center, E.col("band")).otherwise(ring).alias("geom"))


# ---- operators -----------------------------------------------------------------------------------


def simple(spans: DataFrame, cardinals: DataFrame | None = None) -> DataFrame:
    """The shape, or the part of it on its cardinal side."""
    if cardinals is None:
        return spans
    regions = cardinal_regions(spans, cardinals)
    return combine(spans, _ring_crossings(regions), "n_a > 0 AND n_b > 0", b_is_spans=False)


def sub_location(spans: DataFrame) -> DataFrame:
    return spans


def grown(spans: DataFrame, radius: Column) -> DataFrame:
    """The shapes with everything within ``radius`` of them."""
    wide = O.grow_spans(spans, F.col("h"), radius).unionByName(spans, allowMissingColumns=True)
    events = O.slot_events(O.span_events(wide.select(*GROUP, "row", "x0", "x1")), GROUP, {"all": F.lit(True)})
    return O.merged_spans(O.sweep(events, GROUP, ["all"]), GROUP, F.col("n_all") > 0)


def adjacent(spans: DataFrame, cardinals: DataFrame | None = None) -> DataFrame:
    """What lies next to a shape: all around it, or to its cardinal side."""
    if cardinals is not None:
        regions = _ring_crossings(cardinal_regions(spans, cardinals))
        return combine(spans, regions, "n_a = 0 AND n_b > 0", b_is_spans=False)
    radii = summary(spans).select("key", D.buffer_radius(E.col("diagonal"), ADJACENT_FACTOR).alias("_radius"))
    around = grown(spans.join(radii, "key"), F.col("_radius"))
    return combine(around, spans, "n_a > 0 AND n_b = 0")


def proximate(spans: DataFrame, cardinals: DataFrame | None = None) -> DataFrame:
    """A ring around a shape, or the part of the ring on its cardinal side."""
    ring = combine(grown(spans, F.lit(NEAR_BUFFER)), spans, "n_a > 0 AND n_b = 0")
    return ring if cardinals is None else simple(ring, cardinals)


def at_distance(spans: DataFrame, distances: DataFrame) -> DataFrame:
    """A band at a distance from a shape: (key, distance, unit, cardinal), the whole circle without cardinal."""
    known = summary(spans).join(
        distances.select("key", meters(F.col("distance"), F.col("unit")).alias("metres"), azimuth_of(F.col("cardinal")).alias("azimuth")), "key"
    )
    o, metres = E.col("o"), E.col("metres")
    arc = E.when(E.col("azimuth").isNotNull(), D.arc_points(o, metres, E.col("azimuth"))).otherwise(D.arc_points(o, metres))
    lines = known.select(*GROUP, D.buffer_radius(E.col("diagonal"), DISTANCE_FACTOR).alias("_radius"), G.make_line(arc).alias("geom"))
    wide = O.grown_rows(spread(lines, "key"), F.col("h"), F.col("_radius"), interior=False)
    events = O.slot_events(O.span_events(wide.select(*GROUP, "row", "x0", "x1")), GROUP, {"all": F.lit(True)})
    return O.merged_spans(O.sweep(events, GROUP, ["all"]), GROUP, F.col("n_all") > 0)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both shapes as one collection; common parts stay double."""
    return a.select(*GROUP, "row", "x0", "x1").unionByName(b.select(*GROUP, "row", "x0", "x1"))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return combine(a, b, "n_a > 0 AND n_b > 0")


def between(a: DataFrame, b: DataFrame) -> DataFrame:
    """The area from the cut across one shape to the cut across the other, without the shapes."""
    sa, sb = summary(a), summary(b)
    ways = sa.select(*GROUP, F.col("o").alias("oa")).join(sb.select("key", F.col("o").alias("ob")), "key")
    lines = ways.withColumn("u", D.direction(E.col("oa"), E.col("ob"))).where("u IS NOT NULL")
    ca = cut_by_line(a, lines.withColumn("o", F.col("oa"))).withColumnRenamed("cut", "cut_a")
    cb = cut_by_line(b, lines.withColumn("o", F.col("ob"))).withColumnRenamed("cut", "cut_b")
    ring = D.between_ring(E.col("oa"), E.col("cut_a"), E.col("ob"), E.col("cut_b"), E.col("u"))
    regions = lines.join(ca, "key").join(cb, "key").select(*GROUP, ring.alias("geom"))
    return combine(union(a, b), _ring_crossings(regions), "n_a = 0 AND n_b > 0", b_is_spans=False)


def route_lines(a: DataFrame, b: DataFrame, onward: DataFrame | None = None) -> DataFrame:
    """(key, h, points): from the centre of a to the centre of b, or on along the route b is itself."""
    starts = summary(a).select(*GROUP, F.col("o").alias("oa"))
    ends = summary(b).select("key", F.array("o").alias("rest"))
    if onward is not None:
        ends = ends.join(onward.select("key", "points"), "key", "left").select("key", F.coalesce("points", "rest").alias("rest"))
    return starts.join(ends, "key").select(*GROUP, F.concat(F.array("oa"), "rest").alias("points"))


def route_shapes(lines: DataFrame) -> DataFrame:
    """(key, geom) of the strips along routes, one part per leg, without scan conversion."""
    return lines.select("key", as_area(G.make_line(E.col("points")), ROUTE_BUFFER).alias("geom"))


def route(lines: DataFrame) -> DataFrame:
    """A narrow strip along (key, h, points); h should be ROUTE_HEIGHT or less for it to be seen."""
    drawn = lines.select("key", "h", G.make_line(E.col("points")).alias("geom"))
    wide = O.capsule_spans(O.outline_segments(drawn), F.col("h"), F.lit(ROUTE_BUFFER))
    events = O.slot_events(O.span_events(wide.select(*GROUP, "row", "x0", "x1")), GROUP, {"all": F.lit(True)})
    return O.merged_spans(O.sweep(events, GROUP, ["all"]), GROUP, F.col("n_all") > 0)


# ---- whole expressions ---------------------------------------------------------------------------


def evaluate(nodes: DataFrame, shapes: DataFrame, rows: int | None = None) -> DataFrame:
    """Operator node rows and shapes (shp_id, geom) -> slabs (expr_id, h, y, x0, x1) of every expression's root.

    Slabs lie between the corners of the outlines, whatever the places' sizes; ``rows`` is not needed any more. See
    ``resolve.regions`` for the outlines themselves and for the reasons of expressions without a shape."""
    from placespark.operators import resolve

    found, _ = resolve.regions(nodes, shapes)
    return resolve.slabs(found, ["expr_id"])
