"""Location operators against given target polygons (fixed values): shares of the result and of the target that agree."""

import pytest
from pyspark.sql import functions as F

from placespark.functions import exprs as E
from placespark.operators import locations as L
from placespark.operators import overlay as O
from placespark.sources import wkt

ONE = "POLYGON((1.0 1.0, 1.1 1.0, 1.1 1.1, 1.0 1.1, 1.0 1.0))"
TWO = "POLYGON((1.2 1.0, 1.3 1.0, 1.3 1.1, 1.2 1.1, 1.2 1.0))"
H = 2.0**-11

# Target polygons of the sides of ONE.
HALVES = {
    "W": "POLYGON((1.0 1.0, 1.05 1.0, 1.05 1.1, 1.0 1.1, 1.0 1.0))",
    "E": "POLYGON((1.05 1.0, 1.1 1.0, 1.1 1.1, 1.05 1.1, 1.05 1.0))",
    "S": "POLYGON((1.0 1.0, 1.1 1.0, 1.1 1.05, 1.0 1.05, 1.0 1.0))",
    "N": "POLYGON((1.0 1.05, 1.1 1.05, 1.1 1.1, 1.0 1.1, 1.0 1.05))",
    "SW": "POLYGON((1.0 1.0, 1.0 1.1, 1.1 1.0, 1.0 1.0))",
    "NW": "POLYGON((1.0 1.0, 1.1 1.1, 1.0 1.1, 1.0 1.0))",
    "SE": "POLYGON((1.0 1.0, 1.1 1.1, 1.1 1.0, 1.0 1.0))",
    "NE": "POLYGON((1.0 1.1, 1.1 1.1, 1.1 1.0, 1.0 1.1))",
}


def shapes(spark, texts: dict):
    rows = spark.createDataFrame(list(texts.items()), "key string, wkt string")
    return rows.select("key", F.lit(H).alias("h"), wkt.from_text(E.col("wkt")).alias("geom"))


def shares(spans, targets):
    """{key: (share of the result, share of the target)} that both cover."""
    own = O.span_events(spans.select("key", "h", "row", "x0", "x1")).withColumn("side", F.lit("a"))
    wanted = O.crossings(O.edges(targets), F.col("h")).withColumn("side", F.lit("b"))
    areas = O.set_areas(own.unionByName(wanted), ["key"], H)
    return {r["key"]: (r["overlap"] / r["area_a"], r["overlap"] / r["area_b"]) for r in areas.collect()}


def leaves(spark, keys, text):
    return L.cut_lineage(L.leaf_at(shapes(spark, {k: text for k in keys})))


def sides(spark, keys):
    return spark.createDataFrame([(k, k) for k in keys], "key string, cardinal string")


def test_halves_of_a_square(spark):
    part = L.simple(leaves(spark, HALVES, ONE), sides(spark, HALVES))
    found = shares(part, shapes(spark, HALVES))
    assert set(found) == set(HALVES)
    for key, (result, target) in found.items():
        assert result > 0.99 and target > 0.99, (key, result, target)


def test_next_to_a_square(spark):
    targets = {
        "W": "POLYGON((1.05 1.0, 0.805 0.826, 0.805 1.274, 1.05 1.1, 1.0 1.1, 1.0 1.0, 1.05 1.0))",
        "NE": "POLYGON((1.0 1.1, 1.064 1.383, 1.381 1.07, 1.1 1.0, 1.1 1.1, 1.0 1.1))",
    }
    found = shares(L.adjacent(leaves(spark, targets, ONE), sides(spark, targets)), shapes(spark, targets))
    assert found["W"][0] > 0.99 and found["W"][1] > 0.99, found
    assert found["NE"][0] > 0.99 and found["NE"][1] > 0.8, found


def test_between_two_squares(spark):
    target = "POLYGON((1.1 1.1, 1.2 1.1, 1.2 1, 1.1 1, 1.1 1.1))"
    found = shares(L.between(leaves(spark, ["x"], ONE), leaves(spark, ["x"], TWO)), shapes(spark, {"x": target}))
    assert min(found["x"]) > 0.99, found


def test_at_a_distance(spark):
    ten = spark.createDataFrame([("N", 10, "KM", "N")], "key string, distance int, unit string, cardinal string")
    middle = L.summary(L.at_distance(leaves(spark, ["N"], ONE), ten)).first()
    assert abs(middle["o"]["x"] - 1.05) < 0.01
    assert 1.05 + 0.05 < middle["o"]["y"] < 1.05 + 0.1


@pytest.mark.parametrize("cardinal", list(HALVES))
def test_opposites(spark, cardinal):
    row = spark.range(1).select(L.opposite_of(L.opposite_of(F.lit(cardinal))).alias("c")).first()
    assert row["c"] == cardinal


def test_center_of_a_square(spark):
    area = L.area_of(L.simple(leaves(spark, ["C"], ONE), sides(spark, ["C"]))).first()["area"]
    diagonal = L.summary(leaves(spark, ["C"], ONE)).first()["diagonal"]
    assert 0 < area <= 0.0101
    assert area > 0.6 * 3.14 * (diagonal / 3 / 111000) ** 2


def test_whole_expression(spark):
    from placespark.operators.trees import operator_nodes

    text = (
        "Intersection(SubLocation(SimpleLocation(GeoLocation(1,None),Some(GeoCardinal(N)))),"
        "SimpleLocation(SimpleLocation(GeoLocation(1,None),None),Some(GeoCardinal(E))))"
    )
    rows = spark.createDataFrame([("e1", text), ("e2", "Between(GeoLocation(1,None),GeoLocation(2,None))")], "expr_id string, operators string")
    both = shapes(spark, {"1": ONE, "2": TWO}).select(F.col("key").cast("int").alias("shp_id"), "geom")
    spans = L.evaluate(operator_nodes(rows), both, 128)
    areas = {r["expr_id"]: r["a"] for r in spans.groupBy("expr_id").agg(F.sum((F.col("x1") - F.col("x0")) * F.col("h")).alias("a")).collect()}
    assert areas["e1"] == pytest.approx(0.0025, rel=0.03)
    assert areas["e2"] == pytest.approx(0.01, rel=0.03)


def test_route_of_routes(spark):
    from placespark.operators.trees import operator_nodes

    rows = spark.createDataFrame([("r", "Route(GeoLocation(1,None),Route(GeoLocation(2,None),GeoLocation(1,None)))")], "expr_id string, operators string")
    both = shapes(spark, {"1": ONE, "2": TWO}).select(F.col("key").cast("int").alias("shp_id"), "geom")
    spans = L.evaluate(operator_nodes(rows), both, 32)
    row = spans.agg(F.sum((F.col("x1") - F.col("x0")) * F.col("h")).alias("a"), F.min("x0").alias("x0"), F.max("x1").alias("x1")).first()
    assert row["a"] == pytest.approx(0.2 * 0.002, rel=0.1)
    assert (row["x0"], row["x1"]) == (pytest.approx(1.049, abs=0.001), pytest.approx(1.251, abs=0.001))
