"""Planar geometry as Spark column expressions.

A geometry column is ``struct(kind, parts)``: parts -> rings or lines -> points. Every function
takes and returns columns, stays in the JVM and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column

from placespark.functions import exprs as F
from placespark.functions.exprs import bind, let
from placespark.schema import AREA_KINDS, GEOMETRY_DDL, LINE_KINDS, POINT_KINDS


def xy(x, y) -> Column:
    return F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y"))


def geometry(kind, parts: Column) -> Column:
    """Geometry from its kind and parts.

    The optimizer copies a plain struct into every place that reads one of its fields, and all the
    work behind the fields with it; behind ``let`` it is computed once."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return let(F.struct(kind.alias("kind"), parts.alias("parts")), lambda g: g)


def empty() -> Column:
    return geometry("GeometryCollection", F.array()).cast(GEOMETRY_DDL)


def make_point(x, y) -> Column:
    return geometry("Point", F.array(F.array(F.array(xy(x, y)))))


def make_line(points: Column) -> Column:
    return geometry("LineString", F.array(F.array(points)))


def close_ring(points: Column) -> Column:

    def close(p):
        first, last = F.element_at(p, 1), F.element_at(p, -1)
        return F.when(first == last, p).otherwise(F.concat(p, F.array(first)))

    return bind(points, close)


def make_polygon(points: Column) -> Column:
    """Polygon from the points of a ring, closed when it is open."""
    return geometry("Polygon", F.array(F.array(close_ring(points))))


def polygon_from_line(g: Column) -> Column:
    return make_polygon(points(g))


def box(xmin, ymin, xmax, ymax) -> Column:
    return geometry(
        "Polygon",
        F.array(F.array(F.array(xy(xmin, ymin), xy(xmin, ymax), xy(xmax, ymax), xy(xmax, ymin), xy(xmin, ymin)))),
    )


def kind(g: Column) -> Column:
    return g["kind"]


def lines(g: Column) -> Column:
    return F.flatten(g["parts"])


def points(g: Column) -> Column:
    return F.flatten(lines(g))


def is_area(g: Column) -> Column:
    return g["kind"].isin(*AREA_KINDS)


def is_line(g: Column) -> Column:
    return g["kind"].isin(*LINE_KINDS)


def is_point(g: Column) -> Column:
    return g["kind"].isin(*POINT_KINDS)


def is_empty(g: Column) -> Column:
    return F.size(points(g)) == 0


def is_collection(g: Column) -> Column:
    return g["kind"].startswith("Multi") | (g["kind"] == "GeometryCollection")


def num_points(g: Column) -> Column:
    return F.size(points(g)).cast("bigint")


def bounds(g: Column) -> Column:
    """struct(xmin, ymin, xmax, ymax) of all points."""
    return let(
        points(g),
        lambda p: F.struct(
            F.array_min(F.transform(p, lambda q: q["x"])).alias("xmin"),
            F.array_min(F.transform(p, lambda q: q["y"])).alias("ymin"),
            F.array_max(F.transform(p, lambda q: q["x"])).alias("xmax"),
            F.array_max(F.transform(p, lambda q: q["y"])).alias("ymax"),
        ),
    )


def segments(line: Column) -> Column:
    """Consecutive point pairs of a line as struct(a, b)."""


    def pairs(p):
        n = F.size(p)
        return F.when(
            n > 1,
            F.zip_with(F.slice(p, 1, n - 1), F.slice(p, 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
        ).otherwise(F.array().cast("array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>>"))

    return bind(line, pairs)


def _sum(items: Column, value) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, s: acc + value(s))


def signed_area(ring: Column) -> Column:
    """Shoelace area of a ring, positive when counter-clockwise, taken about its first point."""
    return let(
        F.element_at(ring, 1),
        lambda o: _sum(
            segments(ring),
            lambda s: (s["a"]["x"] - o["x"]) * (s["b"]["y"] - o["y"])
            - (s["b"]["x"] - o["x"]) * (s["a"]["y"] - o["y"]),
        )
        / 2,
    )


def _shell_minus_holes(part: Column, value) -> Column:
    holes = F.slice(part, F.lit(2), F.greatest(F.size(part) - 1, F.lit(0)))
    return value(F.element_at(part, 1)) - _sum(holes, value)


def area(g: Column) -> Column:
    """Outer rings minus holes; 0 for points and lines."""
    return F.when(
        is_area(g), _sum(g["parts"], lambda part: _shell_minus_holes(part, lambda r: F.abs(signed_area(r))))
    ).when(g.isNotNull(), F.lit(0.0))


def segment_length(s: Column) -> Column:
    dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
    return F.sqrt(dx * dx + dy * dy)


def line_length(line: Column) -> Column:
    return _sum(segments(line), segment_length)


def length(g: Column) -> Column:
    """Sum of segment lengths of lines; 0 for points and polygons."""
    return F.when(is_line(g), _sum(lines(g), line_length)).otherwise(F.lit(0.0))


def envelope(g: Column) -> Column:
    """Bounding box as polygon, or as line or point where it is flat."""

    def shape(b):
        flat_x, flat_y = b["xmin"] == b["xmax"], b["ymin"] == b["ymax"]
        return (
            F.when(flat_x & flat_y, make_point(b["xmin"], b["ymin"]))
            .when(flat_x | flat_y, make_line(F.array(xy(b["xmin"], b["ymin"]), xy(b["xmax"], b["ymax"]))))
            .otherwise(box(b["xmin"], b["ymin"], b["xmax"], b["ymax"]))
        )

    return let(bounds(g), shape)


def bounding_diagonal(g: Column) -> Column:
    return let(bounds(g), lambda b: make_line(F.array(xy(b["xmin"], b["ymin"]), xy(b["xmax"], b["ymax"]))))


def bounding_circle_of_diagonal(g: Column) -> Column:
    """Centre and radius of the circle on the bounding diagonal."""
    return let(
        bounds(g),
        lambda b: F.struct(
            ((b["xmin"] + b["xmax"]) / 2).alias("cx"),
            ((b["ymin"] + b["ymax"]) / 2).alias("cy"),
            (F.hypot(b["xmax"] - b["xmin"], b["ymax"] - b["ymin"]) / 2).alias("r"),
        ),
    )


_MOMENTS = "struct<w:double,mx:double,my:double>"


def _moments(items: Column, value) -> Column:
    """Add up struct(w, mx, my) over items."""
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def add(acc, item):
        return let(
            value(item),
            lambda m: F.struct(
                (acc["w"] + m["w"]).alias("w"), (acc["mx"] + m["mx"]).alias("mx"), (acc["my"] + m["my"]).alias("my")
            ),
        )

    return F.aggregate(items, zero, add)


def _scaled(m: Column, k: Column) -> Column:
    return F.struct((m["w"] * k).alias("w"), (m["mx"] * k).alias("mx"), (m["my"] * k).alias("my"))


def _ring_moments(ring: Column) -> Column:
    """Area moments of a ring taken as counter-clockwise, about its first point, then moved back."""

    def about(o):
        def one(s):
            ax, ay = s["a"]["x"] - o["x"], s["a"]["y"] - o["y"]
            bx, by = s["b"]["x"] - o["x"], s["b"]["y"] - o["y"]
            return let(
                ax * by - bx * ay,
                lambda c: F.struct((c / 2).alias("w"), ((ax + bx) * c / 6).alias("mx"), ((ay + by) * c / 6).alias("my")),
            )

        return let(
            _moments(segments(ring), one),
            lambda m: _scaled(
                F.struct(
                    m["w"].alias("w"), (m["mx"] + m["w"] * o["x"]).alias("mx"), (m["my"] + m["w"] * o["y"]).alias("my")
                ),
                F.when(m["w"] < 0, F.lit(-1.0)).otherwise(F.lit(1.0)),
            ),
        )

    return let(F.element_at(ring, 1), about)


def _part_moments(part: Column) -> Column:
    numbered = F.transform(part, lambda ring, i: F.struct(ring.alias("ring"), i.alias("i")))
    return _moments(
        numbered,
        lambda r: _scaled(_ring_moments(r["ring"]), F.when(r["i"] == 0, F.lit(1.0)).otherwise(F.lit(-1.0))),
    )


def _segment_moments(s: Column) -> Column:
    return let(
        segment_length(s),
        lambda w: F.struct(
            w.alias("w"),
            (w * (s["a"]["x"] + s["b"]["x"]) / 2).alias("mx"),
            (w * (s["a"]["y"] + s["b"]["y"]) / 2).alias("my"),
        ),
    )


def centroid(g: Column) -> Column:
    """Centre of mass by area, by length or by count, after the dimension of the geometry."""
    by_point = _moments(
        points(g), lambda p: F.struct(F.lit(1.0).alias("w"), p["x"].alias("mx"), p["y"].alias("my"))
    )
    by_length = _moments(lines(g), lambda ln: _moments(segments(ln), _segment_moments))
    by_area = _moments(g["parts"], _part_moments)
    m = F.when(is_area(g), by_area).when(is_line(g), by_length).otherwise(by_point)
    return let(m, lambda m: F.when(m["w"] != 0, xy(m["mx"] / m["w"], m["my"] / m["w"])))


def _spread(p: Column, c: Column) -> Column:
    """Sum of the distances of points p to c."""
    return _sum(p, lambda q: F.hypot(q["x"] - c["x"], q["y"] - c["y"]))


def geometric_median(g: Column, rounds: int = 25) -> Column:
    """Point with the least sum of distances to all points, by a fixed number of rounds per row.

    Each round takes the better of a Weiszfeld step, which never goes astray, and a Newton step,
    which ends fast."""
    sums = ("w", "wx", "wy", "gx", "gy", "hxx", "hxy", "hyy")
    zero = F.struct(*[F.lit(0.0).alias(n) for n in sums])

    def pulls(p, c):
        def add(acc, q):
            dx, dy = c["x"] - q["x"], c["y"] - q["y"]
            return let(
                F.lit(1.0) / F.greatest(F.hypot(dx, dy), F.lit(1e-12)),
                lambda w: F.struct(
                    (acc["w"] + w).alias("w"),
                    (acc["wx"] + w * q["x"]).alias("wx"),
                    (acc["wy"] + w * q["y"]).alias("wy"),
                    (acc["gx"] + w * dx).alias("gx"),
                    (acc["gy"] + w * dy).alias("gy"),
                    (acc["hxx"] + w - w * w * w * dx * dx).alias("hxx"),
                    (acc["hxy"] - w * w * w * dx * dy).alias("hxy"),
                    (acc["hyy"] + w - w * w * w * dy * dy).alias("hyy"),
                ),
            )

        return F.aggregate(p, zero, add)

    def steps(c, s):
        det = F.nullif(s["hxx"] * s["hyy"] - s["hxy"] * s["hxy"], F.lit(0.0))
        return F.struct(
            xy(s["wx"] / s["w"], s["wy"] / s["w"]).alias("slow"),
            xy(
                F.coalesce(c["x"] - (s["hyy"] * s["gx"] - s["hxy"] * s["gy"]) / det, c["x"]),
                F.coalesce(c["y"] - (s["hxx"] * s["gy"] - s["hxy"] * s["gx"]) / det, c["y"]),
            ).alias("fast"),
        )

    def search(p):
        def round_(c, _):
            return let(
                let(pulls(p, c), lambda s: steps(c, s)),
                lambda t: F.when(_spread(p, t["fast"]) < _spread(p, t["slow"]), t["fast"]).otherwise(t["slow"]),
            )

        start = _moments(p, lambda q: F.struct(F.lit(1.0).alias("w"), q["x"].alias("mx"), q["y"].alias("my")))
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(rounds)), let(start, lambda m: xy(m["mx"] / m["w"], m["my"] / m["w"])), round_
        )

    return let(points(g), search)


def closest_on_segment(s: Column, p: Column) -> Column:
    """Nearest point of segment s to point p as struct(d, x, y)."""
    dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
    t_raw = ((p["x"] - s["a"]["x"]) * dx + (p["y"] - s["a"]["y"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    return let(
        F.least(F.greatest(F.coalesce(t_raw, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)),
        lambda t: let(
            xy(s["a"]["x"] + t * dx, s["a"]["y"] + t * dy),
            lambda q: F.struct(
                F.hypot(q["x"] - p["x"], q["y"] - p["y"]).alias("d"), q["x"].alias("x"), q["y"].alias("y")
            ),
        ),
    )


def contains_point(g: Column, p: Column) -> Column:
    """Crossing parity over all rings; half-open in y, so shared borders count once."""

    def crosses(s):
        ay, by = s["a"]["y"], s["b"]["y"]
        at = s["a"]["x"] + (p["y"] - ay) * (s["b"]["x"] - s["a"]["x"]) / F.nullif(by - ay, F.lit(0.0))
        return F.when(((ay > p["y"]) != (by > p["y"])) & (p["x"] < at), F.lit(1)).otherwise(F.lit(0))

    count = F.aggregate(
        lines(g),
        F.lit(0),
        lambda acc, ring: acc + F.aggregate(segments(ring), F.lit(0), lambda n, s: n + crosses(s)),
    )
    return is_area(g) & (count % 2 == 1)


def closest_point(g: Column, p: Column) -> Column:
    """Point of g nearest to p; p itself when it lies inside an area."""
    on_lines = F.array_min(
        F.flatten(F.transform(lines(g), lambda ln: F.transform(segments(ln), lambda s: closest_on_segment(s, p))))
    )
    on_points = F.array_min(
        F.transform(
            points(g),
            lambda q: F.struct(F.hypot(q["x"] - p["x"], q["y"] - p["y"]).alias("d"), q["x"].alias("x"), q["y"].alias("y")),
        )
    )
    nearest = F.when(is_point(g), on_points).otherwise(F.coalesce(on_lines, on_points))
    return F.when(contains_point(g, p), p).otherwise(let(nearest, lambda n: xy(n["x"], n["y"])))


def centrality(g: Column, metric: str = "centroid") -> Column:
    """Point of the geometry nearest to its centroid or median."""
    middle = centroid(g) if metric == "centroid" else geometric_median(g)
    return let(middle, lambda m: closest_point(g, m))


def point_on_surface(g: Column, largest: bool = False) -> Column:
    """Middle of the widest run on the middle scanline of an area's largest part; a middle point otherwise.

    largest: g is that part already."""
    if not largest:
        one = lambda p: geometry("Polygon", F.array(p))
        sized = F.transform(g["parts"], lambda p: F.struct(area(one(p)).alias("size"), p.alias("part")))
        inside = let(F.array_max(sized), lambda r: let(one(r["part"]), lambda part: point_on_surface(part, True)))
        middle = F.element_at(points(g), F.ceil(F.size(points(g)) / 2).cast("int"))
        return F.when(is_area(g), inside).otherwise(middle)

    def runs(b):
        y = (b["ymin"] + b["ymax"]) / 2

        def at(s):
            ay, by = s["a"]["y"], s["b"]["y"]
            return F.when((ay > y) != (by > y), s["a"]["x"] + (y - ay) * (s["b"]["x"] - s["a"]["x"]) / (by - ay))

        xs = F.array_sort(
            F.filter(
                F.flatten(F.transform(lines(g), lambda r: F.transform(segments(r), at))), lambda v: v.isNotNull()
            )
        )

        def widest(v):
            pairs = F.transform(
                F.sequence(F.lit(1), F.greatest(F.size(v) - 1, F.lit(1)), F.lit(2)),
                lambda i: F.struct(
                    (F.get(v, i) - F.get(v, i - 1)).alias("w"),
                    (-((F.get(v, i) + F.get(v, i - 1)) / 2)).alias("m"),
                ),
            )
            return let(F.array_max(pairs), lambda r: xy(-r["m"], y))

        return let(xs, widest)

    return let(bounds(g), runs)


def boundary(g: Column) -> Column:
    """Rings of a polygon as lines, end points of open lines; empty for points and closed lines."""
    rings = geometry(
        F.when(F.size(lines(g)) == 1, F.lit("LineString")).otherwise(F.lit("MultiLineString")),
        F.transform(lines(g), lambda r: F.array(r)),
    )
    open_lines = F.filter(lines(g), lambda ln: F.element_at(ln, 1) != F.element_at(ln, -1))
    ends = geometry(
        "MultiPoint",
        F.flatten(
            F.transform(
                open_lines,
                lambda ln: F.array(F.array(F.array(F.element_at(ln, 1))), F.array(F.array(F.element_at(ln, -1)))),
            )
        ),
    )
    return F.when(is_area(g), rings).when(is_line(g) & (F.size(open_lines) > 0), ends).otherwise(empty())


def is_closed(g: Column) -> Column:
    return is_line(g) & F.forall(lines(g), lambda ln: F.element_at(ln, 1) == F.element_at(ln, -1))


def azimuth(a: Column, b: Column) -> Column:
    """Degrees clockwise from north from point a to point b; null for equal points."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    return F.when((dx != 0) | (dy != 0), F.pmod(F.degrees(F.atan2(dx, dy)) + 360, F.lit(360.0)))


def distance_points(a: Column, b: Column) -> Column:
    return F.hypot(b["x"] - a["x"], b["y"] - a["y"])


def map_points(g: Column, fn) -> Column:
    return geometry(
        g["kind"],
        F.transform(g["parts"], lambda part: F.transform(part, lambda ln: F.transform(ln, fn))),
    )


def translate(g: Column, dx, dy) -> Column:
    return map_points(g, lambda p: xy(p["x"] + dx, p["y"] + dy))


def scale_about(g: Column, fx, fy, origin: Column) -> Column:
    return map_points(
        g, lambda p: xy(origin["x"] + fx * (p["x"] - origin["x"]), origin["y"] + fy * (p["y"] - origin["y"]))
    )


def scale(g: Column, factor, origin: Column | None = None) -> Column:
    """Scale about a point, by default about the centroid."""
    factor = F.lit(float(factor)) if not isinstance(factor, Column) else factor
    if origin is not None:
        return scale_about(g, factor, factor, origin)
    return let(centroid(g), lambda c: scale_about(g, factor, factor, c))


def rotate(g: Column, degrees) -> Column:
    """Rotate counter-clockwise about the centroid."""
    angle = F.radians(F.lit(float(degrees)) if not isinstance(degrees, Column) else degrees)
    return let(
        centroid(g),
        lambda c: map_points(
            g,
            lambda p: xy(
                c["x"] + (p["x"] - c["x"]) * F.cos(angle) - (p["y"] - c["y"]) * F.sin(angle),
                c["y"] + (p["x"] - c["x"]) * F.sin(angle) + (p["y"] - c["y"]) * F.cos(angle),
            ),
        ),
    )


def project(p: Column, distance, azimuth_degrees) -> Column:
    """Planar destination point; the azimuth is clockwise from north."""
    a = F.radians(azimuth_degrees)
    return xy(p["x"] + distance * F.sin(a), p["y"] + distance * F.cos(a))


# Spherical mercator radius in metres, points per buffer quarter.
EARTH_RADIUS = 6378137.0
QUARTER_SEGMENTS = 8


def mercator_x(lon: Column) -> Column:
    return F.radians(lon) * EARTH_RADIUS


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2)) * EARTH_RADIUS


def to_web_mercator(g: Column) -> Column:
    """Degrees (4326) to metres (3857)."""
    return map_points(g, lambda p: xy(mercator_x(p["x"]), mercator_y(p["y"])))


def buffer_point(p: Column, radius) -> Column:
    """Regular polygon of 4 * QUARTER_SEGMENTS corners around a point."""
    n = 4 * QUARTER_SEGMENTS
    ring = F.transform(
        F.sequence(F.lit(0), F.lit(n)),
        lambda i: xy(
            p["x"] + radius * F.cos(F.radians((i % n) * (-360.0 / n))),
            p["y"] + radius * F.sin(F.radians((i % n) * (-360.0 / n))),
        ),
    )
    return geometry("Polygon", F.array(F.array(ring)))


def to_km(value: Column, squared: bool = False) -> Column:
    return value / (1000000 if squared else 1000)
