"""Exact overlay against a plain sweep that looks at every pair of edges, and closed forms off any grid."""

import random

import pytest
from pyspark.sql import functions as F

from placespark.functions import exprs as E
from placespark.operators import regions as R
from placespark.sources import wkt


def slabs(rings):
    """(y0, y1, [(x at middle, ring number)]) between all ends and crossings of the rings' edges."""
    edges = [(*sorted((a, b), key=lambda p: p[1]), k) for k, r in enumerate(rings) for a, b in zip(r, r[1:] + r[:1], strict=True) if a[1] != b[1]]
    at = lambda e, y: e[0][0] + (y - e[0][1]) * (e[1][0] - e[0][0]) / (e[1][1] - e[0][1])
    ys = {p[1] for e in edges for p in e[:2]}
    for i, e in enumerate(edges):
        for f in edges[:i]:
            lo, hi = max(e[0][1], f[0][1]), min(e[1][1], f[1][1])
            if lo < hi and (at(e, lo) - at(f, lo)) * (at(e, hi) - at(f, hi)) < 0:
                a, b = at(e, lo) - at(f, lo), at(e, hi) - at(f, hi)
                ys.add(lo + (hi - lo) * a / (a - b))
    ys = sorted(ys)
    for y0, y1 in zip(ys, ys[1:], strict=False):
        y = (y0 + y1) / 2
        yield y0, y1, sorted((at(e, y), e[2]) for e in edges if e[0][1] <= y <= e[1][1])


def area(rings, inside):
    """Area where inside(set of rings that cover it, by parity of each) holds."""
    total = 0.0
    for y0, y1, xs in slabs(rings):
        open_rings = set()
        for (x, k), (x2, _) in zip(xs, xs[1:], strict=False):
            open_rings ^= {k}
            total += (y1 - y0) * (x2 - x) * inside(open_rings)
    return total


def corners(r, n, size):
    """A ring with n corners at random places, mostly crossing itself."""
    x, y = r.uniform(-5, 5), r.uniform(-5, 5)
    return [(x + r.uniform(-size, size), y + r.uniform(-size, size)) for _ in range(n)]


def text(rings):
    return "MULTIPOLYGON(" + ", ".join("((" + ", ".join(f"{x!r} {y!r}" for x, y in [*r, r[0]]) + "))" for r in rings) + ")"


def members(spark, groups):
    """(group, member, edges) of {group: [ring, ...]}, one shape for each ring."""
    rows = [(g, f"{g}/{i}", text([ring])) for g, rings in groups.items() for i, ring in enumerate(rings)]
    df = spark.createDataFrame(rows, "g string, member string, wkt string")
    shapes = df.select("member", wkt.from_text(E.col("wkt")).alias("geom"))
    return R.member_edges(df.select("g", "member"), shapes, "member")


@pytest.mark.parametrize("fan", [32, 3])
def test_union_and_intersection(spark, monkeypatch, fan):
    monkeypatch.setattr(R, "FAN", fan)
    monkeypatch.setattr(R, "CELL", 16)
    r = random.Random(2)
    groups = {f"g{i}": [corners(r, r.choice([3, 3, 4, 5, 7]), 4) for _ in range(r.randint(1, 9))] for i in range(12)}
    groups["copies"] = [groups["g0"][0]] * 7
    groups["thin"] = [[(0, 0), (9, 0.0005), (9, 0.0015), (0, 0.001)], [(1, -1), (1.0001, -1), (1.0001, 1), (1, 1)]]
    groups["unequal"] = [[(0, 0), (60, 1), (61, 60), (1, 60)], [(5, 5), (5.0003, 5), (5.0003, 5.0002), (5, 5.0002)]]
    rows = members(spark, groups)
    union = {x["g"]: x["area"] for x in R.areas(R.united(rows, ["g"], "member"), ["g"]).collect()}
    both = {x["g"]: x["area"] for x in R.areas(R.common(rows, ["g"], "member"), ["g"]).collect()}
    for g, rings in groups.items():
        assert union[g] == pytest.approx(area(rings, bool), rel=1e-9, abs=1e-9), g
        assert both.get(g, 0.0) == pytest.approx(area(rings, lambda s, n=len(rings): len(s) == n), rel=1e-9, abs=1e-9), g
    assert both["unequal"] == pytest.approx(0.0003 * 0.0002, rel=1e-6)


def test_member_without_area(spark):
    rows = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1")], "g string, member string")
    shapes = spark.createDataFrame([("1", "POLYGON((0 0, 1 0, 1 1, 0 1, 0 0))"), ("2", "POINT(3 3)")], "member string, wkt string")
    edges = R.member_edges(rows, shapes.select("member", wkt.from_text(E.col("wkt")).alias("geom")), "member")
    assert {x["g"]: x["area"] for x in R.areas(R.united(edges, ["g"], "member"), ["g"]).collect()} == {"a": 1.0, "b": 1.0}
    assert {x["g"]: x["area"] for x in R.areas(R.common(edges, ["g"], "member"), ["g"]).collect()} == {"b": 1.0}


@pytest.mark.parametrize("given, want", [
    ("POLYGON((0 0, 2 2, 2 0, 0 2, 0 0))", 2.0),
    ("POLYGON((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 3 1, 3 3, 1 3, 1 1))", 12.0),
    ("POLYGON((0 0, 4 0, 4 4, 0 4, 0 0, 4 0, 4 4, 0 4, 0 0))", 0.0),
    ("MULTIPOLYGON(((0 0, 2 0, 2 2, 0 2, 0 0)), ((1 1, 3 1, 3 3, 1 3, 1 1)))", 7.0),
    ("POLYGON((0 0, 3 0, 3 3, 2 3, 2 1, 1 1, 1 3, 0 3, 0 0))", 7.0),
    ("POLYGON((0 0, 0 1, 1 1, 1 0, 0 0))", 1.0),
    ("LINESTRING(0 0, 1 1)", None),
])
def test_valid_areas(spark, given, want):
    df = spark.createDataFrame([(1, given)], "id int, wkt string").select("id", wkt.from_text(E.col("wkt")).alias("geom"))
    found = [x["area"] for x in R.areas(R.valid_edges(df, "id"), ["id"]).collect()]
    assert found == ([] if not want else [pytest.approx(want)])


def test_set_areas(spark):
    a, b = [(0.1, 0.1), (3.3, 0.2), (2.7, 2.9)], [(1.01, -1.0), (2.03, 4.0), (0.5, 2.2)]
    rows = members(spark, {"a": [a], "b": [b]}).select(F.lit(1).alias("k"), F.col("g").alias("side"), *R.EDGE)
    got = R.set_areas(rows, ["k"]).first()
    assert got["overlap"] == pytest.approx(area([a, b], lambda s: len(s) == 2)) and got["difference"] == pytest.approx(area([a, b], lambda s: s == {0}))
    assert got["area_a"] == pytest.approx(area([a], bool)) and got["union_area"] == pytest.approx(area([a, b], bool))


def test_convex(spark):
    texts = {"POLYGON((0 0, 1 0, 1 1, 0 1, 0 0))": True, "POLYGON((0 0, 2 2, 2 0, 0 2, 0 0))": False, "POLYGON((0 0, 0 1, 1 1, 0 0))": True}
    texts |= {"POLYGON((0 0, 4 0, 4 4, 0 4, 0 0, 4 0, 4 4, 0 4, 0 0))": False, "POLYGON((0 0, 2 0, 2 2, 1 1, 0 2, 0 0))": False}
    df = spark.createDataFrame(list(texts.items()), "wkt string, want boolean")
    assert all(x["want"] == x["got"] for x in df.select("want", R.is_convex(wkt.from_text(E.col("wkt"))).alias("got")).collect())


def test_overlap_with_parts_above_and_below(spark):
    from placespark.operators import overlay as O

    a = "POLYGON((0 0, 2 0, 2 2, 0 2, 0 0))"
    b = "MULTIPOLYGON(((1 1, 3 1, 3 3, 1 3, 1 1)), ((0 5, 2 5, 2 6, 0 6, 0 5)), ((0 -4, 2 -4, 2 -3, 0 -3, 0 -4)))"
    df = spark.createDataFrame([(1, a, b)], "k int, a string, b string")
    df = df.select("k", wkt.from_text(E.col("a")).alias("a"), wkt.from_text(E.col("b")).alias("b"))
    assert O.pair_overlap(df, ["k"], "a", "b").first()["overlap"] == pytest.approx(1.0)


def test_outlines(spark):
    """Boxes that touch in a corner stay two parts, a frame has a hole, and no border inside of a union is left."""
    boxes = lambda *at: [[(x, y), (x + w, y), (x + w, y + h), (x, y + h)] for x, y, w, h in at]
    groups = {"corner": boxes((0, 0, 1, 1), (1, 1, 1, 1)), "row": boxes((0, 0, 1, 1), (1, 0, 1, 1), (2, 0, 1, 2))}
    groups["frame"] = boxes((0, 0, 3, 1), (0, 2, 3, 1), (0, 0, 1, 3), (2, 0, 1, 3))
    rows = R.united(members(spark, groups), ["g"], "member", levels=True)
    got = {x["g"]: x["geom"] for x in R.outlines(rows, ["g"]).collect()}
    shape = lambda g: sorted([[len(r) for r in part] for part in got[g]["parts"]])
    assert shape("corner") == [[5], [5]] and shape("row") == [[7]] and shape("frame") == [[5, 5]]


def test_reasons(spark):
    from placespark.operators import resolve
    from placespark.operators.trees import operator_nodes

    texts = {
        "fine": "GeoLocation(1,None)", "apart": "Intersection(GeoLocation(1,None),GeoLocation(2,None))", "unbound": "GeoLocation(7,None)",
        "union": "Union(GeoLocation(1,None),GeoLocation(7,None))", "same": "Between(GeoLocation(1,None),GeoLocation(1,None))",
    }
    places = [(1, "POLYGON((0 0, 1 0, 1 1, 0 1, 0 0))"), (2, "POINT(5 5)")]
    rows = spark.createDataFrame(list(texts.items()), "expr_id string, operators string")
    shapes = spark.createDataFrame(places, "shp_id int, wkt string").select("shp_id", wkt.from_text(E.col("wkt")).alias("geom"))
    found, why = resolve.regions(operator_nodes(rows), shapes)
    assert {x["expr_id"]: x["reason"] for x in why.collect()} == {"apart": "nothing in common", "unbound": "no place", "union": "no place", "same": "same place"}
    assert {x["expr_id"]: x["area"] for x in R.areas(found, ["expr_id"]).collect()} == {"fine": pytest.approx(1.0)}
    with pytest.raises(ValueError):
        resolve.regions(operator_nodes(rows).withColumn("entity_id", F.lit("e")), shapes)
