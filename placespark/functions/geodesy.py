"""Distances and points on the WGS84 ellipsoid, and shapes made from them."""

from __future__ import annotations

from pyspark.sql import Column

from placespark.functions import exprs as F
from placespark.functions import geom as G

# WGS84 major axis and flattening, rounds of the iterations, step of arcs in degrees.
MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
MINOR = MAJOR * (1 - FLATTENING)
ROUNDS = 8
SETTLED = 1e-10
ARC_STEP = 10


def _tail(cos2_alpha):
    """Series terms A and B of the ellipsoid's deviation."""
    u2 = cos2_alpha * ((MAJOR**2 - MINOR**2) / MINOR**2)
    big_a = 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2)))
    big_b = u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))
    return big_a, big_b


def _delta(big_b, sin_s, cos_s, cos_2m):
    inner = cos_s * (2 * cos_2m * cos_2m - 1) - big_b / 6 * cos_2m * (4 * sin_s * sin_s - 3) * (4 * cos_2m * cos_2m - 3)
    return big_b * sin_s * (cos_2m + big_b / 4 * inner)


def _names(**values) -> Column:
    return F.struct(*[v.alias(k) for k, v in values.items()])


def geodesic_distance(a: Column, b: Column) -> Column:
    """Length in metres of the shortest way between two points; 0 for equal points, null for nearly opposite ones."""
    reduced = lambda lat: F.atan(F.tan(F.radians(lat)) * (1 - FLATTENING))

    def on(p):
        start = _names(
            s1=F.sin(p["u1"]), c1=F.cos(p["u1"]), s2=F.sin(p["u2"]), c2=F.cos(p["u2"]), l=p["l"],
        )

        def with_parts(k):
            def geometry_of(lam):
                x = k["c2"] * F.sin(lam)
                y = k["c1"] * k["s2"] - k["s1"] * k["c2"] * F.cos(lam)
                first = _names(
                    sin_s=F.sqrt(x * x + y * y), cos_s=k["s1"] * k["s2"] + k["c1"] * k["c2"] * F.cos(lam), sin_l=F.sin(lam)
                )
                return F.let(
                    first,
                    lambda t: F.let(
                        k["c1"] * k["c2"] * t["sin_l"] / F.nullif(t["sin_s"], F.lit(0.0)),
                        lambda sin_a: _names(
                            sin_s=t["sin_s"], cos_s=t["cos_s"], sin_a=sin_a, c2a=1 - sin_a * sin_a,
                            c2m=F.coalesce(
                                t["cos_s"] - 2 * k["s1"] * k["s2"] / F.nullif(1 - sin_a * sin_a, F.lit(0.0)), F.lit(0.0)
                            ),
                        ),
                    ),
                )

            def next_lambda(lam, _):
                def step(t):
                    c = t["c2a"] * (FLATTENING / 16) * (4 + FLATTENING * (4 - 3 * t["c2a"]))
                    return k["l"] + (1 - c) * FLATTENING * t["sin_a"] * (
                        F.atan2(t["sin_s"], t["cos_s"])
                        + c * t["sin_s"] * (t["c2m"] + c * t["cos_s"] * (2 * t["c2m"] * t["c2m"] - 1))
                    )

                return F.let(geometry_of(lam), step)

            def length(t):
                big_a, big_b = _tail(t["c2a"])
                return F.let(
                    big_b,
                    lambda bb: big_a * MINOR * (F.atan2(t["sin_s"], t["cos_s"]) - _delta(bb, t["sin_s"], t["cos_s"], t["c2m"])),
                )

            lam = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), k["l"], next_lambda)
            # One more round shows whether the rounds have settled; between nearly opposite points they do not.
            settled = lambda v, w: F.when(F.abs(w - v) < SETTLED, F.let(geometry_of(w), length))
            return F.let(lam, lambda v: F.let(next_lambda(v, None), lambda w: settled(v, w)))

        return F.let(start, with_parts)

    inputs = _names(u1=reduced(a["y"]), u2=reduced(b["y"]), l=F.radians(b["x"] - a["x"]))
    same = (a["x"] == b["x"]) & (a["y"] == b["y"])
    return F.when(same, F.lit(0.0)).otherwise(F.let(inputs, on))


def geodesic_destination(p: Column, distance: Column, azimuth: Column) -> Column:
    """Point reached from p after ``distance`` metres at ``azimuth`` degrees."""
    azimuth_r = F.radians(azimuth)
    u1 = F.atan(F.tan(F.radians(p["y"])) * (1 - FLATTENING))

    def on(k):
        sin_a = k["cu"] * k["sa"]
        rest = _names(
            su=k["su"], cu=k["cu"], sa=k["sa"], ca=k["ca"], d=k["d"], sin_a=sin_a, c2a=1 - sin_a * sin_a,
            s1=F.atan2(k["su"] / k["cu"], k["ca"]),
        )

        def solve(t):
            big_a, big_b = _tail(t["c2a"])
            fixed = _names(a=t["d"] / (MINOR * big_a), b=big_b)

            def with_series(w):
                def next_sigma(s, _):
                    return F.let(
                        F.cos(2 * t["s1"] + s), lambda c2m: w["a"] + _delta(w["b"], F.sin(s), F.cos(s), c2m)
                    )

                sigma = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), w["a"], next_sigma)

                def place(s):
                    ss, cs = F.sin(s), F.cos(s)
                    lat_y = t["su"] * cs + t["cu"] * ss * t["ca"]
                    off = t["su"] * ss - t["cu"] * cs * t["ca"]
                    lat = F.atan2(lat_y, (1 - FLATTENING) * F.sqrt(t["sin_a"] * t["sin_a"] + off * off))
                    lam = F.atan2(ss * t["sa"], t["cu"] * cs - t["su"] * ss * t["ca"])
                    c = t["c2a"] * (FLATTENING / 16) * (4 + FLATTENING * (4 - 3 * t["c2a"]))
                    c2m = F.cos(2 * t["s1"] + s)
                    turn = lam - (1 - c) * FLATTENING * t["sin_a"] * (s + c * ss * (c2m + c * cs * (2 * c2m * c2m - 1)))
                    return G.xy(p["x"] + F.degrees(turn), F.degrees(lat))

                return F.let(sigma, place)

            return F.let(fixed, with_series)

        return F.let(rest, solve)

    start = _names(su=F.sin(u1), cu=F.cos(u1), sa=F.sin(azimuth_r), ca=F.cos(azimuth_r), d=F.lit(distance).cast("double"))
    return F.let(start, on)


def arc_points(p: Column, distance: Column, azimuth: Column | None = None) -> Column:
    """Points at ``distance`` metres around p: the quarter about an azimuth, or the whole circle."""
    if azimuth is None:
        angles = F.transform(F.sequence(F.lit(0), F.lit(360), F.lit(ARC_STEP)), lambda a: a.cast("double"))
    else:
        angles = F.transform(F.sequence(F.lit(-45), F.lit(45), F.lit(ARC_STEP)), lambda a: azimuth + a)
    return F.transform(angles, lambda a: geodesic_destination(p, distance, a))


def diagonal(b: Column) -> Column:
    """Length in metres of the diagonal of struct(xmin, ymin, xmax, ymax); 0 for a flat one."""
    flat = (b["xmin"] == b["xmax"]) | (b["ymin"] == b["ymax"])
    return F.when(flat, F.lit(0.0)).otherwise(
        geodesic_distance(G.xy(b["xmin"], b["ymin"]), G.xy(b["xmax"], b["ymax"]))
    )


def buffer_radius(diagonal_: Column, factor: float) -> Column:
    """Radius in degrees that goes with a diagonal in metres."""
    return (diagonal_ * factor - diagonal_) / (4 * 100000)


def line_span(g: Column, o: Column, u: Column) -> Column:
    """struct(lo, hi): first and last place along the line o + t*u that lies in g; 0, 0 when none does."""

    def crossing(s):
        ax, ay = s["a"]["x"] - o["x"], s["a"]["y"] - o["y"]
        bx, by = s["b"]["x"] - o["x"], s["b"]["y"] - o["y"]
        sides = _names(sa=u["x"] * ay - u["y"] * ax, sb=u["x"] * by - u["y"] * bx, ta=u["x"] * ax + u["y"] * ay, tb=u["x"] * bx + u["y"] * by)
        return F.let(
            sides,
            lambda k: F.when(
                (k["sa"] * k["sb"] <= 0) & (k["sa"] != k["sb"]), k["ta"] + (k["tb"] - k["ta"]) * k["sa"] / (k["sa"] - k["sb"])
            ),
        )

    hits = F.flatten(F.transform(G.lines(g), lambda ln: F.transform(G.segments(ln), crossing)))
    return F.let(
        hits,
        lambda h: _names(lo=F.coalesce(F.array_min(h), F.lit(0.0)), hi=F.coalesce(F.array_max(h), F.lit(0.0))),
    )


def between_ring(a: Column, a_span: Column, b: Column, b_span: Column, u: Column) -> Column:
    """Ring through both ends of the two cuts, at centres a and b along direction u; a line when it has no width."""
    at = lambda p, t: G.xy(p["x"] + t * u["x"], p["y"] + t * u["y"])
    corners = F.array_distinct(F.array(at(a, a_span["lo"]), at(a, a_span["hi"]), at(b, b_span["hi"]), at(b, b_span["lo"])))
    return F.let(corners, lambda c: F.when(F.size(c) < 3, G.make_line(c)).otherwise(G.make_polygon(c)))


def direction(a: Column, b: Column) -> Column:
    """Unit vector across the way from a to b, turned counter-clockwise; null for equal points."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    size = F.nullif(F.sqrt(dx * dx + dy * dy), F.lit(0.0))
    return F.let(size, lambda n: F.when(n.isNotNull(), G.xy(-dy / n, dx / n)))


def between(a: Column, b: Column, a_center: Column | None = None, b_center: Column | None = None) -> Column:
    """Area between two geometries: from the cut across one centre to the cut across the other.

    Centres that are known already, as those of shapes in many pairs, need not be found again for each pair."""

    def joined(c):
        return F.let(
            direction(c["a"], c["b"]),
            lambda u: F.when(
                u.isNotNull(), between_ring(c["a"], line_span(a, c["a"], u), c["b"], line_span(b, c["b"], u), u)
            ),
        )

    centers = [G.centroid(g) if c is None else c for g, c in ((a, a_center), (b, b_center))]
    return F.let(_names(a=centers[0], b=centers[1]), joined)
