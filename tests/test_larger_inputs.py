"""What keeps jobs in bounds on larger inputs, and that it changes no result."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from placespark.functions import exprs as E
from placespark.functions import geodesy as D
from placespark.functions import geom as G
from placespark.functions import hull as H
from placespark.functions import relate
from placespark.functions import text as T
from placespark.operators import baselines as B
from placespark.operators import layout
from placespark.operators import locations as L
from placespark.operators import overlay as O
from placespark.operators import regions as R
from placespark.operators import relations
from placespark.operators import resolve
from placespark.operators import spatial_join as J
from placespark.operators import trees
from placespark.plans.geometry_queries import geom_median
from placespark.plans.text_queries import extraction_report
from placespark.sources import corpus, wkt

SQUARE = "POLYGON((0 0,2 0,2 2,0 2,0 0))"
HOLED = "POLYGON((0 0,4 0,4 4,0 4,0 0),(1 1,1 3,3 3,3 1,1 1))"
DIAMOND = "POLYGON((3 1,4 0,5 1,4 2,3 1))"
TWO = "MULTIPOLYGON(((10 10,11 10,11 11,10 10)),((-3 -3,-2 -3,-2.5 -1,-3 -3)))"
LINE = "LINESTRING(0 5,3 6.5)"


def shapes(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "key int, wkt string")
    return rows.select("key", wkt.from_text(E.col("wkt")).alias("geom"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_spans_are_not_broadcast(spark):
    rows = shapes(spark, SQUARE, DIAMOND).withColumn("row_key", F.lit(1))
    a = O.spans(rows.select("row_key", "geom").limit(1), ["row_key"], 0.25)
    b = O.spans(rows, ["row_key", "key"], 0.25)
    met = O.span_interval_join(a, b, ["row_key"])
    assert "SortMergeJoin" in plan(met)
    assert met.where("key = 0").count() == 8 and met.where("x0 >= x1").count() == 0


def test_cells_of_rings_are_not_broadcast(spark):
    found = H.simple_rings(shapes(spark, SQUARE, "POLYGON((0 0,2 2,2 0,0 2,0 0))"), "key", 0.5)
    assert "SortMergeJoin [key" in plan(found)
    assert {r["key"]: r["simple"] for r in found.collect()} == {0: True, 1: False}


@pytest.mark.parametrize(
    ("b", "expected"),
    [("POLYGON((3 0,4 0,4 1,3 0))", "FF2FF1212"), ("POLYGON((2 0,4 0,4 2,2 2,2 0))", "FF2F11212"), (DIAMOND, "FF2FF1212"), ("POLYGON((1 3,3 1,3 3,1 3))", "FF2F01212")],
)
def test_boxes_tell_areas_that_lie_apart(spark, b, expected):
    row = shapes(spark, SQUARE).withColumnRenamed("geom", "a").crossJoin(shapes(spark, b).select(F.col("geom").alias("b")))
    told = relate.matrix(E.col("a"), E.col("b"))
    assert told.text.startswith("CASE WHEN")  # boxes come first
    assert row.select(told.alias("m")).first()["m"] == expected


def test_points_in_cells(spark):
    areas = shapes(spark, SQUARE, HOLED, DIAMOND, TWO, LINE)
    dealt = random.Random(5)
    spots = [(i, dealt.choice([dealt.uniform(-4, 12), float(dealt.randint(-4, 12)), dealt.randint(-16, 48) / 4]), dealt.uniform(-4, 12) if i % 2 else dealt.randint(-16, 48) / 4) for i in range(3000)]
    points = spark.createDataFrame(spots, "p int, x double, y double")
    every = points.crossJoin(areas).where(J.contains(E.col("geom"), G.xy(E.col("x"), E.col("y")))).select("p", "key")
    want = sorted(map(tuple, every.collect()))
    for cell in (4.0, 0.7, 100.0):
        got = J.contains_join(points, areas, cell).select("p", "key").collect()
        assert sorted(map(tuple, got)) == want
    cells = J.covered_cells(areas.where("key = 0"), 4.0)
    assert cells.where("_whole").count() > 0 and cells.select("_l", "_cx", "_cy").distinct().count() == cells.count()


def test_rectangles_meet_where_their_boxes_do(spark):
    texts = [SQUARE, HOLED, DIAMOND, TWO, LINE, "POLYGON((0 0,2 2,2 2,0 0,0 0))", "POLYGON((0 0,2 0,0 0,2 0,0 0))", "POLYGON((2 0,2 2,0 2,0 0,2 0))"]
    flags = shapes(spark, *texts).select("key", J.is_rectangle(E.col("geom")).alias("r"))
    assert [r["r"] for r in flags.orderBy("key").collect()] == [True, False, False, False, False, False, False, True]
    dealt = random.Random(7)
    boxes = []
    for _ in range(30):
        x, y, w, h = (dealt.randint(-8, 20) / 2, dealt.randint(-8, 20) / 2, dealt.randint(1, 6) / 2, dealt.randint(1, 6) / 2)
        boxes.append(f"POLYGON(({x} {y},{x + w} {y},{x + w} {y + h},{x} {y + h},{x} {y}))")
    left = shapes(spark, *texts[:5], *boxes)
    right = left.select(F.col("key").alias("other_key"), F.col("geom").alias("other"))
    every = left.crossJoin(right).where(H.intersects(E.col("geom"), E.col("other"))).select("key", "other_key")
    got = J.intersects_join(left, right, 4.0)
    assert sorted(map(tuple, got.select("key", "other_key").collect())) == sorted(map(tuple, every.collect()))
    assert got.columns == ["key", "geom", "other_key", "other"]


def test_joins_without_outlines_in_their_condition(spark):
    boxes = shapes(spark, SQUARE, HOLED, DIAMOND, "POLYGON((1 1,3 1,3 3,1 3,1 1))")
    points = spark.createDataFrame([(0, 1.5, 1.5), (1, 2.0, 1.5), (2, 3.5, 1.0), (3, 4.0, 1.5)], "p int, x double, y double")
    met = J.intersects_join(boxes, boxes.select(F.col("key").alias("o"), F.col("geom").alias("other")), 4.0)
    inside = J.contains_join(points, boxes, 4.0)
    for df in (met, inside):
        lines = [line for line in plan(df).splitlines() if "Join" in line and "_salt" in line]
        assert lines and all("SortMergeJoin" in line for line in lines) and any("lambda" not in line for line in lines)
    assert sorted(map(tuple, met.select("key", "o").collect())) == [(a, b) for a in range(4) for b in range(4) if (a, b) not in ((0, 2), (2, 0))]
    assert sorted(map(tuple, inside.select("p", "key").collect())) == [(0, 0), (0, 3), (1, 3), (2, 1), (2, 2), (3, 2)]


def test_distances_take_segments_once_for_each_pair(spark):
    a, b = E.col("a"), E.col("b")
    text = H.hausdorff_distance(a, b).text
    assert text.rindex("zip_with") < text.index("hypot")  # segments are not taken again for each point
    line, spots = [(0.0, 5.0), (3.0, 6.5), (3.0, 6.5), (4.0, 9.0)], [(1.0, 2.0), (3.0, 4.0)]
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    texts = ["LINESTRING(0 5,3 6.5,3 6.5,4 9)", "MULTIPOINT(1 2,3 4)", SQUARE, "MULTIPOINT(1 1,3 4)"]
    corners, lines = [line, spots, square, [(1.0, 1.0), (3.0, 4.0)]], [line, None, square, None]

    def to(p, i):
        if lines[i] is None:
            return min(math.dist(p, q) for q in corners[i])
        away = []
        for (ax, ay), (bx, by) in zip(lines[i], lines[i][1:], strict=False):
            n = (bx - ax) ** 2 + (by - ay) ** 2
            t = min(1.0, max(0.0, ((p[0] - ax) * (bx - ax) + (p[1] - ay) * (by - ay)) / n)) if n else 0.0
            away.append(math.dist(p, (ax + t * (bx - ax), ay + t * (by - ay))))
        return min(away)

    df = shapes(spark, *texts)
    pairs = df.select(F.col("key").alias("i"), F.col("geom").alias("a")).crossJoin(df.select(F.col("key").alias("j"), F.col("geom").alias("b")))
    got = pairs.select("i", "j", H.distance(a, b).alias("d"), H.hausdorff_distance(a, b).alias("h")).collect()
    assert len(got) == 16
    for r in got:
        there, back = ([to(p, k) for p in corners[m]] for m, k in ((r["i"], r["j"]), (r["j"], r["i"])))
        inside = {r["i"], r["j"]} == {2, 3}  # the first of the points lies in the square
        assert math.isclose(r["d"], 0.0 if inside else min(there + back)) and math.isclose(r["h"], max(there + back))
    none = shapes(spark, SQUARE).select(E.col("geom").alias("a"), F.lit(None).cast(df.schema["geom"].dataType).alias("b"))
    assert none.select(H.distance(a, b).alias("d"), H.hausdorff_distance(a, b).alias("h")).first() == (None, None)


def test_baselines_of_one_method(spark):
    places = shapes(spark, SQUARE, "POLYGON((1 1,3 1,3 3,1 3,1 1))").withColumnRenamed("key", "place")
    members = spark.createDataFrame([(1, 0), (1, 1), (2, 1)], "entity int, place int")
    gold = places.select((F.col("place") + 1).alias("entity"), F.col("geom").alias("gold"))
    order = ["entity", "method"]
    every = B.method_areas(gold, members, places, "entity", "place").orderBy(order).collect()
    assert len(every) == 8
    for method in B.METHODS:
        one = B.method_areas(gold, members, places, "entity", "place", (method,)).orderBy(order).collect()
        assert one == [r for r in every if r["method"] == method]


def test_only_nodes_that_need_them_get_sums_of_their_arguments(spark, monkeypatch):
    seen, summary = [], resolve.summary
    monkeypatch.setattr(resolve, "summary", lambda rows: seen.append(rows.select("key").distinct().count()) or summary(rows))
    told = [("a", "SubLocation(GeoLocation(0,None))"), ("b", "Intersection(SimpleLocation(GeoLocation(0,None),None),GeoLocation(1,None))")]
    nodes = trees.operator_nodes(spark.createDataFrame(told, "expr_id string, operators string"))
    places = shapes(spark, SQUARE, "POLYGON((1 1,3 1,3 3,1 3,1 1))").select(F.col("key").cast("string").alias("shp_id"), "geom")
    found, _ = resolve.regions(nodes, places)
    areas = {r["expr_id"]: r["area"] for r in R.areas(found, ["expr_id"]).collect()}
    assert areas == {"a": 4.0, "b": 1.0} and not any(seen)


def test_spans_of_one_geometry_are_joined_before_the_sweep(spark):
    h, r = 0.125, 0.3
    df = shapes(spark, SQUARE, HOLED, DIAMOND, TWO, LINE, "MULTIPOINT(1 2,3 4)", SQUARE)
    no_end = G.box(E.lit(0.0), E.lit(0.0), E.lit(None).cast("double"), E.lit(1.0))
    df = df.withColumn("geom", F.when(F.col("key") == 6, no_end).otherwise(F.col("geom")))
    rows = O.grown_rows(df, h, F.lit(r))
    assert rows.where("key = 0").groupBy("row").count().where("count > 1").count() == 0
    one = O.span_events(O.capsule_spans(O.outline_segments(df), h, F.lit(r)))
    events = one.select("key", "row", "x", "d").unionByName(O.crossings(O.edges(df), h).select("key", "row", "x", "d"))
    runs = O.sweep(O.slot_events(events, ["key"], {"all": F.lit(True)}), ["key"], ["all"])
    want = {a["key"]: a["area"] for a in O.span_area(O.merged_spans(runs, ["key"], F.col("n_all") > 0), ["key"], h).collect()}
    got = {a["key"]: a["area"] for a in O.span_area(rows, ["key"], h).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
    outline = {a["key"]: a["area"] for a in O.span_area(O.grown_rows(df, h, F.lit(r), interior=False), ["key"], h).collect()}
    assert outline[0] < got[0] and outline[4] == got[4]


def test_leaves_are_dealt_over_all_cores(spark):
    found = L.leaf(shapes(spark, SQUARE, LINE), 16)
    assert "REPARTITION_BY_NUM" in plan(found)
    assert math.isclose(L.area_of(found).where("key = 0").first()["area"], 4.0)


def test_operator_texts_are_read_without_a_shuffle(spark):
    texts = ["Distance(SimpleLocation(GeoLocation(3,None),Some(GeoCardinal(W))),10,KM,Some(GeoCardinal(N)))", "7", None, "Union(GeoLocation(1,None), GeoLocation(2 ,None))"]
    rows = spark.createDataFrame(list(enumerate(texts)), "expr_id int, operators string")
    nodes = trees.operator_nodes(rows)
    assert "Exchange" not in plan(nodes) and "Window" not in plan(nodes)
    assert sorted((tuple(r) for r in nodes.collect()), key=str) == [
        (0, 0, None, 0, "Distance", 0, None, 10, "KM", "N"), (0, 1, 0, 0, "SimpleLocation", 1, None, None, None, "W"), (0, 2, 1, 0, "GeoLocation", 2, 3, None, None, None),
        (1, None, None, 0, None, None, None, None, None, None),
        (3, 0, None, 0, "Union", 0, None, None, None, None), (3, 1, 0, 0, "GeoLocation", 1, 1, None, None, None), (3, 2, 0, 1, "GeoLocation", 1, 2, None, None, None),
    ]


def test_keys_of_complete_entities_parse_each_once(spark):
    link = '<link id="E_1_1" osm="O2 O3" type="way">A</link>'
    xml = [
        f'<entity id="E" osm="O1" type="way" status="5"><p>In {link}, <link id="E_1_2">B</link>.</p><p>No link.</p></entity>',
        f'<entity id="F" status="5"><p>{link.replace("O2", "O4")}</p></entity>', f'<entity id="G" osm="O9" type="way" status="4"><p>{link}</p></entity>', None,
    ]
    found = corpus.complete_keys(corpus.parse_corpus(spark.createDataFrame([(x,) for x in xml], "xml string").repartition(2), "xml"))
    assert plan(found).count("from_xml") == 1
    assert sorted(map(tuple, found.collect())) == [("", ""), ("O1", "way"), ("O2", "way"), ("O4", "way")]


def test_tightest_box_of_few_and_of_many_corners():
    few = [(0.0, 0.0), (3.0, 0.0), (3.0, 2.0), (1.5, 2.0), (1.5, 4.0), (0.0, 4.0), (0.0, 0.0)]
    assert H._tightest_box(*np.array(few).T) == [0.0, 0.0, 3.0, 0.0, 3.0, 4.0, 0.0, 4.0]
    turns = np.linspace(0, 2 * np.pi, 40, endpoint=False)
    hull = H._hull_points(2 * np.cos(turns), np.sin(turns))
    assert len(hull) > H._FEW
    assert np.allclose(H._boxes(np.array(hull)), H._boxes_of_few(hull))


def test_medians_are_dealt_over_all_cores(spark, tmp_path):
    parts = spark.range(8).selectExpr("id AS p_partkey", "cast(id AS int) AS p_size")
    parts.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert geom_median(spark, str(tmp_path)).rdd.getNumPartitions() >= 8


ODD_TEXTS = [
    "It borders SHP1 to the north, SHP2 on north - east and SHP3.", "10 km\n(SHP4),( SHP5 ;x_ é SHP SHP6a 12é", ", \u0085in SHP7,\u0085", "-\t(\x00SHP8 K", "", None,
]


def test_known_text_is_the_known_tokens(spark):
    rows = spark.createDataFrame([(t,) for t in ODD_TEXTS], "sentence string")
    got = rows.select(relations.known_text(E.col("sentence")).alias("a"), F.array_join(T.filter_tokens(T.tokenize(F.col("sentence"))), " ").alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got]
    assert got[0]["a"] == "borders SHP 1 to the north , SHP 2 on north - east and SHP 3"


def test_groups_of_a_phrase_take_one_pass():
    """One regex for each phrase, one more for the items of a list; none for each group."""
    lists = sum(p.clause != p.item for p in relations.PATTERNS)
    assert relations.matches(E.col("known")).text.lower().count("regexp_") == len(relations.PATTERNS) + lists


def test_report_parses_sentences_once(spark):
    report = extraction_report(spark, "/root/testdata/sf0.001")
    assert "regexp_" not in plan(report) and "RLIKE" not in plan(report)


def test_spread_stays_above_a_distinct(spark):
    rows = spark.range(100).selectExpr("id % 10 AS a", "id % 3 AS b").distinct()
    dealt = layout.spread(rows, "a", "b")
    assert "REPARTITION_BY_NUM" in plan(dealt)
    assert dealt.count() == 30


def test_between_takes_known_centres(spark):
    a, b = E.col("a.geom"), E.col("b.geom")
    pair = shapes(spark, SQUARE).alias("a").join(shapes(spark, DIAMOND).alias("b"), "key")
    row = pair.select(D.between(a, b).alias("found"), D.between(a, b, G.centroid(a), G.centroid(b)).alias("given")).first()
    assert row["found"] == row["given"]
