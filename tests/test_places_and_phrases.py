"""Shapes of very different sizes, places numbered per entity, phrases, order of lines."""

import pytest
from pyspark.sql import functions as F

from placespark.functions import exprs as E
from placespark.functions import geodesy
from placespark.functions import geom as G
from placespark.operators import locations as L
from placespark.operators import relations as R
from placespark.operators import trees
from placespark.sources import corpus, wkt


def box(x0, y0, x1, y1):
    return f"POLYGON(({x0} {y0},{x1} {y0},{x1} {y1},{x0} {y1},{x0} {y0}))"


def shapes(spark, rows, columns="shp_id int, wkt string"):
    return spark.createDataFrame(rows, columns).withColumn("geom", wkt.from_text(E.col("wkt"))).drop("wkt")


def test_flat_shape_is_kept(spark):
    found = L.area_of(L.leaf(shapes(spark, [("a", box(0, 0, 32, 0.01))], "key string, wkt string"))).collect()
    assert [r["area"] for r in found] == [pytest.approx(0.32, rel=0.01)]


def test_small_place_in_a_large_one(spark):
    nodes = trees.operator_nodes(spark.createDataFrame([("e", "Intersection(GeoLocation(2,None),GeoLocation(3,None))")], "expr_id string, operators string"))
    found = L.area_of(L.evaluate(nodes, shapes(spark, [(2, box(0, 0, 60, 40)), (3, box(10, 10, 10.01, 10.01))]))
                      .withColumnRenamed("expr_id", "key")).collect()
    assert [r["area"] for r in found] == [pytest.approx(0.0001, rel=0.01)]


def test_numbers_start_anew_in_each_entity(spark):
    rows = [("x", "GeoLocation(1,None)"), ("y", "GeoLocation(1,None)")]
    nodes = trees.operator_nodes(spark.createDataFrame(rows, "expr_id string, operators string")).withColumn("entity_id", F.col("expr_id"))
    places = shapes(spark, [("x", 1, box(0, 0, 1, 1)), ("y", 1, box(5, 5, 7, 6))], "entity_id string, shp_id int, wkt string")
    found = L.area_of(L.evaluate(nodes, places).withColumnRenamed("expr_id", "key")).collect()
    assert {r["key"]: round(r["area"], 6) for r in found} == {"x": 1.0, "y": 2.0}


@pytest.mark.parametrize(
    ("sentence", "expected"),
    [
        ("It lies 10 km to the north of SHP1.", [("Distance", [1], "N", 10)]),
        ("It is bordered to the north by SHP1, to the south by SHP2 and to the east by SHP3.",
         [("Adjacent", [1], "S", None), ("Adjacent", [2], "N", None), ("Adjacent", [3], "W", None)]),
        ("It is in SHP2 capital SHP1.", [("SubLocation", [1], None, None)]),
        ("It is located in SHP1.", [("SubLocation", [1], None, None)]),
    ],
)
def test_phrases(spark, sentence, expected):
    found = R.extract_relations(spark.createDataFrame([(sentence,)], "sentence string")).orderBy("n").collect()
    assert sorted((r["relation"], list(r["shp_ids"]), r["side"], r["distance"]) for r in found) == sorted(expected)


def test_order_by_place_in_the_sentence(spark):
    found = R.compose(spark.createDataFrame([("It is in SHP12 and near SHP1.",)], "sentence string")).first()["operators"]
    assert found.index("GeoLocation(12,") < found.index("GeoLocation(1,")


def test_own_cardinal_defines_what_lies_inside_only(spark):
    rows = [("It is near eastern SHP1.", False), ("It is in eastern SHP1.", True), ("It borders SHP1 to the north.", True)]
    found = R.extract_relations(spark.createDataFrame(rows, "sentence string, want boolean"))
    found = found.select("want", R.is_defined(F.col("relation"), F.col("side"), F.get("own_cardinals", F.lit(0))).alias("got"))
    assert [r["want"] for r in found.collect()] == [r["got"] for r in found.collect()]


def test_last_line_wins_over_several_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("".join(f"k{i % 7}\told{i}\n" for i in range(9000)))
    (tmp_path / "b.tsv").write_text("k1\tnew\n")
    found = {r["entity_id"]: r["operators"] for r in corpus.read_operator_rows(spark, str(tmp_path)).collect()}
    assert found["k1"] == "new" and found["k2"] == "old8997"


def test_point_on_surface_of_parts_above_each_other(spark):
    text = "MULTIPOLYGON(((0 0,4 0,4 1,0 1,0 0)),((0 5,1 5,1 6,0 6,0 5)))"
    row = shapes(spark, [("a", text)], "key string, wkt string").select(G.point_on_surface(E.col("geom")).alias("p")).first()
    assert (row["p"]["x"], row["p"]["y"]) == (2.0, 0.5)


def test_no_distance_where_the_rounds_do_not_settle(spark):
    df = spark.createDataFrame([(0.0, 0.0, 179.7, 0.5), (0.0, 0.0, 1.0, 0.0)], "a double, b double, c double, d double")
    found = df.select(geodesy.geodesic_distance(G.xy(E.col("a"), E.col("b")), G.xy(E.col("c"), E.col("d"))).alias("m")).collect()
    assert found[0]["m"] is None and found[1]["m"] == pytest.approx(111319.49, abs=0.01)
