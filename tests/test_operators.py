"""Fixed cases and properties of functions and operators."""

import math

import pytest
from pyspark.sql import functions as F

from placespark.functions import exprs as E
from placespark.functions import features, geodesy, relate, tiles
from placespark.functions import geom as G
from placespark.functions import hull as H
from placespark.functions import text as T
from placespark.operators import layout, relations, score, trees
from placespark.operators import overlay as O
from placespark.sources import corpus, wkt


def shapes(spark, **texts):
    rows = spark.createDataFrame(list(texts.items()), "key string, wkt string")
    return rows.select("key", wkt.from_text(E.col("wkt")).alias("geom"))


def pair(spark, a, b):
    row = spark.createDataFrame([(1, a, b)], "key int, a string, b string")
    return row.select("key", wkt.from_text(E.col("a")).alias("gold"), wkt.from_text(E.col("b")).alias("guess"))


SQUARE = "POLYGON((0 0,2 0,2 2,0 2,0 0))"
RIGHT = "POLYGON((1 0,3 0,3 2,1 2,1 0))"
DIAMOND = "POLYGON((1 1,2 0,3 1,2 2,1 1))"
HOLED = "POLYGON((0 0,4 0,4 4,0 4,0 0),(1 1,1 3,3 3,3 1,1 1))"


def test_wkt_round_trip(spark):
    texts = [SQUARE, HOLED, "POINT(1 2.5)", "MULTIPOINT(1 2,3 4)", "LINESTRING(0 0,1 1.25)", "MULTILINESTRING((0 0,1 1),(2 2,3 3))",
             "MULTIPOLYGON(((0 0,1 0,0 1,0 0)),((5 5,6 5,5 6,5 5),(5.1 5.1,5.2 5.1,5.1 5.2,5.1 5.1)))"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    back = [r["b"] for r in df.select(wkt.as_text(wkt.from_text(E.col("t"))).alias("b")).collect()]
    assert back == texts
    spaced = spark.createDataFrame([("polygon (( 0 0, 2 0 , 2 2, 0 2, 0 0 ))",), ("CIRCLE(1)",)], "t string")
    assert [r["b"] for r in spaced.select(wkt.as_text(wkt.from_text(E.col("t"))).alias("b")).collect()] == [SQUARE, None]


def test_measures(spark):
    row = shapes(spark, x=HOLED).select(
        G.area(E.col("geom")).alias("area"), G.centroid(E.col("geom")).alias("c"),
        G.contains_point(E.col("geom"), G.xy(2.0, 2.0)).alias("in_hole"), G.contains_point(E.col("geom"), G.xy(0.5, 2.0)).alias("in_body"),
        G.point_on_surface(E.col("geom")).alias("p"),
    ).first()
    assert row["area"] == 12 and (row["c"]["x"], row["c"]["y"]) == (2, 2)
    assert not row["in_hole"] and row["in_body"] and row["p"]["x"] in (0.5, 3.5)


def test_overlay_identities(spark):
    df = shapes(spark, a=SQUARE, b=DIAMOND).select(F.lit(1).alias("g"), F.col("key").alias("side"), "geom")
    for band in (None, 0.75):
        found = O.crossings(O.edges(df), 0.125)
        r = O.set_areas(found, ["g"], 0.125, band).first()
        assert (r["area_a"], r["area_b"], r["overlap"]) == (4, 2, 1)
        assert r["union_area"] == r["area_a"] + r["area_b"] - r["overlap"] and r["difference"] == 3


def test_copies_and_bands_agree(spark):
    boxes = spark.range(3000).select(
        (F.col("id") % 2).alias("g"), G.box(E.expr("id % 7 * 0.5D"), E.expr("id % 3 * 0.25D"), E.expr("id % 7 * 0.5D + 1"), E.expr("id % 3 * 0.25D + 1")).alias("geom")
    )
    found = O.crossings(O.edges(boxes), 0.25)
    plain = {r["g"]: r["area"] for r in O.union_areas(found, ["g"], 0.25).collect()}
    banded = {r["g"]: r["area"] for r in O.union_areas(found, ["g"], 0.25, 0.6).collect()}
    assert plain == banded == {0: 6.0, 1: 6.0}


def test_pair_overlap_of_crossing_edges(spark):
    found = O.pair_overlap(pair(spark, SQUARE, DIAMOND), ["key"], "gold", "guess").first()["overlap"]
    assert found == pytest.approx(1.0, abs=1e-9)
    turned = "POLYGON((0.3 -0.5,2.5 1.7,1.1 2.6,0.3 -0.5))"
    exact = O.pair_overlap(pair(spark, SQUARE, turned), ["key"], "gold", "guess", rows=4096).first()["overlap"]
    assert O.pair_overlap(pair(spark, SQUARE, turned), ["key"], "gold", "guess").first()["overlap"] == pytest.approx(exact, rel=1e-4)


def test_hand_worked_scores(spark):
    found = pair(spark, SQUARE, RIGHT)
    plane = found.select("key", "gold", "guess", G.area(E.col("gold")).alias("ga"), G.area(E.col("guess")).alias("pa"))
    overlap = O.pair_overlap(plane, ["key"], "gold", "guess").first()["overlap"]
    assert overlap / 4 == 0.5
    big = plane.select("key", score.enlarged(E.col("gold")).alias("g2"), score.enlarged(E.col("guess")).alias("p2"), "gold", "guess")
    assert O.pair_overlap(big, ["key"], "g2", "guess").first()["overlap"] / 4 == 1
    assert O.pair_overlap(big, ["key"], "gold", "p2").first()["overlap"] / 4 == 1


def test_scores_of_points_and_missing_predictions(spark):
    gold = pair(spark, SQUARE, SQUARE).select("key", "gold").unionByName(pair(spark, SQUARE, SQUARE).select((F.col("key") + 1).alias("key"), "gold"))
    guess = pair(spark, SQUARE, "POINT(1 1)").select("key", "guess")
    rows = {r["key"]: r for r in score.evaluate(gold, guess, "key").collect()}
    assert rows[1]["p"] == pytest.approx(1.0, abs=1e-6) and rows[1]["r"] < 1e-9
    assert rows[2]["p"] is None


def test_buffer_of_a_point(spark):
    df = shapes(spark, p="POINT(1 1)")
    area = O.buffer_areas(df, ["key"], 2.0**-9, F.lit(0.5)).first()["area"]
    assert area == pytest.approx(16 * 0.25 * math.sin(math.pi / 16), rel=1e-3)


def test_hull_shapes(spark):
    row = shapes(spark, d=DIAMOND).select(H.oriented_envelope(E.col("geom")).alias("e"), H.bounding_circle(E.col("geom")).alias("c")).select(
        G.area(E.col("e")).alias("a"), "c"
    ).first()
    assert row["a"] == pytest.approx(2) and row["c"]["r"] == pytest.approx(1)


@pytest.mark.parametrize("a, b, expected", [
    (SQUARE, SQUARE, "2FFF1FFF2"), (SQUARE, "POLYGON((5 5,6 5,6 6,5 5))", "FF2FF1212"), (SQUARE, RIGHT, "212111212"),
    (SQUARE, "POLYGON((2 0,3 0,3 2,2 2,2 0))", "FF2F11212"), ("POLYGON((-1 -1,3 -1,3 3,-1 3,-1 -1))", SQUARE, "212FF1FF2"),
])
def test_relate(spark, a, b, expected):
    assert pair(spark, a, b).select(relate.matrix(E.col("gold"), E.col("guess")).alias("m")).first()["m"] == expected


@pytest.mark.parametrize("matrix, name", [
    ("2FFF1FFF2", "Equals"), ("FF2FF1212", "Disjoint"), ("212FF1FF2", "Contains"), ("2FF1FF212", "Within"), ("FF2F11212", "Touches"), ("212101212", "Intersects"),
])
def test_relation_class(spark, matrix, name):
    assert spark.range(1).select(features.relation_class(E.lit(matrix)).alias("r")).first()["r"] == name


def test_geodesic_there_and_back(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 1000.0, 90.0), (10.0, 50.0, 250000.0, 33.0), (-70.0, -33.0, 10000.0, 200.0)], "x double, y double, d double, az double")
    p = G.xy(E.col("x"), E.col("y"))
    moved = rows.select("x", "y", "d", geodesy.geodesic_destination(p, E.col("d"), E.col("az")).alias("q"))
    for r in moved.select("d", geodesy.geodesic_distance(p, E.col("q")).alias("m")).collect():
        assert r["m"] == pytest.approx(r["d"], abs=1e-3)
    degree = spark.range(1).select(geodesy.geodesic_distance(G.xy(0.0, 0.0), G.xy(1.0, 0.0)).alias("m")).first()["m"]
    assert degree == pytest.approx(111319.4908, abs=1e-3)


def test_tiles(spark):
    x, y = E.col("x"), E.col("y")
    rows = spark.createDataFrame([(-180.0, 90.0), (180.0, -90.0), (0.0, 0.0), (181.0, 0.0)], "x double, y double")
    found = rows.select(tiles.tile_index_relative(x, y, 4).alias("t"), tiles.tile_index_relative(x, y, 4, compat=True).alias("c")).collect()
    assert [r["t"] for r in found] == [0, 15, 10, None]
    assert [r["c"] for r in found] == [0, None, 10, None]
    back = spark.range(16).select("id", tiles.tile_center(E.col("id"), 4).alias("p")).select("id", tiles.tile_index_relative(E.col("p.x"), E.col("p.y"), 4).alias("t"))
    assert all(r["id"] == r["t"] for r in back.collect())


# Expected relations of given phrases.
PHRASES = [
    ("in SHP1", "SubLocation", [1], None, None, None), ("a city in SHP1", "SubLocation", [1], None, None, None),
    ("in the city of SHP1", "SubLocation", [1], None, None, None), ("in the state of SHP1", "SubLocation", [1], None, None, None),
    ("belongs to SHP1", "SubLocation", [1], None, None, None), ("from SHP1", "SubLocation", [1], None, None, None),
    ("from the city of SHP1", "SubLocation", [1], None, None, None), ("in the east of SHP1", "SubLocation", [1], "E", None, None),
    ("in eastern SHP1", "SubLocation", [1], "E", None, None), ("in the eastern part of SHP1", "SubLocation", [1], "E", None, None),
    ("in the center of SHP1", "SubLocation", [1], "C", None, None), ("in central SHP1", "SubLocation", [1], "C", None, None),
    ("in the central part of SHP1", "SubLocation", [1], "C", None, None), ("between SHP1 and SHP2", "Between", [1, 2], None, None, None),
    ("from SHP1 to SHP2", "Between", [1, 2], None, None, None), ("close to the SHP1", "Proximate", [1], None, None, None),
    ("close to SHP1", "Proximate", [1], None, None, None), ("borders with SHP1", "Adjacent", [1], None, None, None),
    ("bordered by SHP1", "Adjacent", [1], None, None, None), ("borders SHP1 to the north", "Adjacent", [1], "S", None, None),
    ("to the south of SHP1", "Adjacent", [1], "S", None, None), ("100 km east of SHP1", "Distance", [1], "E", 100, "KM"),
    ("100 miles east of SHP1", "Distance", [1], "E", 100, "MI"), ("in SHP1, SHP2", "SubLocation", [1], None, None, None),
    ("in SHP1, SHP2, SHP3", "SubLocation", [1], None, None, None),
]


def test_phrases(spark):
    rows = spark.createDataFrame([(i, p[0]) for i, p in enumerate(PHRASES)], "i int, sentence string")
    found = relations.extract_relations(rows).orderBy("i", "n").collect()
    assert [(PHRASES[r["i"]][0], r["relation"], r["shp_ids"], r["cardinal"], r["distance"], r["unit"]) for r in found] == PHRASES


def test_lists_of_neighbours(spark):
    text = "It borders SHP1 to the north, SHP2 to the east and SHP3 to the south."
    found = relations.extract_relations(spark.createDataFrame([(text,)], "sentence string")).orderBy("n").collect()
    assert [(r["relation"], r["shp_ids"], r["cardinal"]) for r in found] == [("Adjacent", [1], "S"), ("Adjacent", [2], "W"), ("Adjacent", [3], "N")]


def test_operator_trees(spark):
    texts = [
        "SubLocation(SimpleLocation(SimpleLocation(GeoLocation(1001,None),None),None))",
        "SubLocation(SimpleLocation(GeoLocation(1001,None),Some(GeoCardinal(NE))))",
        "Intersection(SubLocation(SimpleLocation(GeoLocation(1001,None),None)),Between(SimpleLocation(GeoLocation(1002,None),None),SimpleLocation(SimpleLocation(GeoLocation(1003,None),None),None)))",
        "Intersection(SubLocation(SimpleLocation(SimpleLocation(GeoLocation(1001,None),None),None)),Adjacent(SimpleLocation(GeoLocation(1003,None),None),Some(GeoCardinal(N))))",
    ]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "expr_id string, operators string")
    nodes = trees.operator_nodes(rows).collect()
    assert [sum(n["expr_id"] == str(i) for n in nodes) for i in range(4)] == [4, 3, 10, 8]
    last = {n["node_id"]: n for n in nodes if n["expr_id"] == "3"}
    assert (last[5]["op"], last[5]["cardinal"], last[5]["parent_id"], last[5]["slot"]) == ("Adjacent", "N", 0, 1)
    assert last[7]["shp_id"] == 1003


def test_corpus_file(spark, tmp_path):
    body = '<data><entities><entity id="E1" wikipedia="W1" osm="O1" type="T1" status="5"><p id="E1_001" num_links="2">Description of entity includes <link id="E1_001_001" wikipedia="W2" osm="O2" type="T2">Alpha</link> and <link id="E1_001_002" wikipedia="W3" osm="O3 O4" type="T2 T3">Beta</link>.</p></entity></entities></data>'
    (tmp_path / "corpus.xml").write_text(body)
    entities = corpus.read_corpus(spark, str(tmp_path))
    assert entities.first()["entity_id"] == "E1"
    links = corpus.links(corpus.fragments(entities)).orderBy("shp_id").collect()
    assert [(r["shp_id"], r["toponym"], [k["id"] for k in r["osm"]]) for r in links] == [(1, "Alpha", ["O2"]), (2, "Beta", ["O3", "O4"])]
    pieces = corpus.fragments(entities)
    told = pieces.select("pos", F.when(F.col("kind") == "link", F.concat(F.lit("SHP"), T.link_number(F.col("link_id")))).otherwise(F.col("text")).alias("t"))
    assert "".join(r["t"] for r in told.orderBy("pos").collect()) == "Description of entity includes SHP1 and SHP2."


def test_running_total_and_salted_join(spark):
    rows = spark.range(1000).select((F.col("id") % 3 % 2).alias("k"), "id", F.lit(1).cast("bigint").alias("one"))
    assert layout.running_total(rows, ["k"], "id", "one", 64).where("k = 0").agg(F.max("total")).first()[0] == rows.where("k = 0").count()
    right = spark.range(2).select(F.col("id").alias("k"), F.col("id").alias("v"))
    assert layout.salted_join(rows, right, ["k"], salts=4).count() == 1000


def test_new_predictions_are_added_once(spark, tmp_path):
    from placespark.streaming.predictions import predict_new

    source, table, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.createDataFrame([("e1",), ("e2",)], "entity_id string").write.parquet(source)
    for _ in range(2):
        arriving = spark.readStream.schema("entity_id string").parquet(source)
        predict_new(arriving, lambda df: df.select("entity_id", F.lit("POINT(0 0)").alias("geom")), table, state, "m").awaitTermination()
        spark.createDataFrame([("e2",), ("e3",)], "entity_id string").write.mode("append").parquet(source)
    assert sorted(r["entity_id"] for r in spark.read.parquet(table).collect()) == ["e1", "e2", "e3"]
