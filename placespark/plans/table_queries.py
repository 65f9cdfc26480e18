"""Gazetteer, corpus tables, annotation, joins, groups and baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from placespark import fixtures as X
from placespark.functions import exprs as E
from placespark.functions import geom as G
from placespark.functions import lexicon as L
from placespark.operators import annotation, baselines, groups
from placespark.operators import regions as R
from placespark.operators import score as S
from placespark.operators import spatial_join as J
from placespark.operators.layout import numbered, running_total, spread, stored
from placespark.plans.catalog import query, rounded
from placespark.plans.geometry_queries import _CELLS
from placespark.sources import corpus, gazetteer, wkt
from placespark.sources.tables import table

GEOM = E.col("geom")

# ---- WKT -----------------------------------------------------------------------------------------

_WKT = (
    "CASE form WHEN 0 THEN 'POLYGON((' || x0 || ' ' || y0 || ', ' || (x0 + w) || ' ' || y0 || ', ' || (x0 + w) || ' ' || (y0 + h) || ', ' || x0 || ' ' || y0 || '))'"
    " WHEN 1 THEN 'MULTIPOINT(' || x0 || ' ' || y0 || ', ' || (x0 + w) || ' ' || (y0 + h) || ')'"
    " WHEN 2 THEN 'MULTIPOLYGON(((' || x0 || ' ' || y0 || ',' || (x0 + w) || ' ' || y0 || ',' || x0 || ' ' || (y0 + h) || ',' || x0 || ' ' || y0 || ')),((0 0,1 0,0 1,0 0)))'"
    " ELSE 'MULTILINESTRING((' || x0 || ' ' || y0 || ', ' || (x0 + w) || ' ' || (y0 + h) || '),(0 0, 1 1))' END"
)


def _wkt_rows(spark, d):
    return table(spark, d, "part").selectExpr(*X.SHAPES).withColumn("wkt", F.expr(_WKT))


@query(
    "wkt_load",
    X.with_sql("shapes") + "SELECT shape_id, CASE form WHEN 0 THEN 'Polygon' WHEN 1 THEN 'MultiPoint' WHEN 2 THEN 'MultiPolygon' ELSE 'MultiLineString' END AS kind,"
    " CAST(CASE form WHEN 0 THEN 1 ELSE 2 END AS BIGINT) AS parts, CAST(CASE form WHEN 0 THEN 4 WHEN 1 THEN 2 WHEN 2 THEN 8 ELSE 4 END AS BIGINT) AS points,"
    " CASE form WHEN 0 THEN w * h / 2 WHEN 2 THEN w * h / 2 + 5e-1 ELSE 0e0 END AS area FROM shapes",
)
def wkt_load(spark, d):
    loaded = _wkt_rows(spark, d).select("shape_id", wkt.from_text(E.col("wkt")).alias("g"))
    g = E.col("g")
    return loaded.select("shape_id", "g.kind", F.size("g.parts").cast("bigint").alias("parts"), G.num_points(g).alias("points"), G.area(g).alias("area"))


@query(
    "wkt_format",
    X.with_sql("shapes")[:-1] + f", texts AS (SELECT shape_id, {_WKT} AS t FROM shapes) SELECT shape_id, regexp_replace(replace(t, ', ', ','), '\\.0([^0-9])', '\\1', 'g') AS wkt FROM texts",
)
def wkt_format(spark, d):
    loaded = _wkt_rows(spark, d).select("shape_id", wkt.from_text(E.col("wkt")).alias("g"))
    return loaded.select("shape_id", wkt.as_text(E.col("g")).alias("wkt"))


# ---- gazetteer -----------------------------------------------------------------------------------

_KEYS = "keys AS (SELECT place_id, unnest(['O' || place_id, 'O' || (place_id + 1)]) AS osm_id, unnest(['way', 'relation']) AS osm_type FROM places)"
_GAZETTEER = (
    "gazetteer AS (SELECT 'O' || place_id AS osm_id, 'way' AS osm_type, place_id AS box_id, xmin, ymin, xmax, ymax FROM places"
    " UNION ALL SELECT 'O' || place_id, 'relation', place_id, xmin, ymin, xmax, ymax FROM places WHERE cardinal IN ('N', 'E'))"
)


def _keys(spark, d):
    lists = X.places(spark, d).select(
        "place_id",
        corpus.osm_keys(F.expr("concat('O', place_id, ' O', place_id + 1)"), F.lit("way relation")).alias("osm"),
    )
    return lists.select("place_id", F.explode("osm").alias("k")).select(
        "place_id", F.col("k.id").alias("osm_id"), F.col("k.type").alias("osm_type")
    )


def _gazetteer(spark, d):
    places = X.place_shapes(spark, d).withColumn("osm_id", F.concat(F.lit("O"), "place_id"))
    ways = places.select("osm_id", F.lit("way").alias("osm_type"), F.col("place_id").alias("box_id"), "geom", "cardinal")
    relations = ways.where("cardinal IN ('N', 'E')").withColumn("osm_type", F.lit("relation"))
    return ways.unionByName(relations).drop("cardinal")


@query("explode_osm_keys", X.with_sql("places")[:-1] + f", {_KEYS} SELECT * FROM keys")
def explode_osm_keys(spark, d):
    return _keys(spark, d)


@query("gazetteer_lookup", X.with_sql("places")[:-1] + f", {_KEYS}, {_GAZETTEER} SELECT osm_id, osm_type, box_id FROM gazetteer WHERE (osm_id, osm_type) IN (SELECT (osm_id, osm_type) FROM keys)")
def gazetteer_lookup(spark, d):
    return gazetteer.lookup(_keys(spark, d), _gazetteer(spark, d)).select("osm_id", "osm_type", "box_id")


@query(
    "entity_reference_geometry",
    X.with_sql("places")[:-1] + f", {_KEYS}, {_GAZETTEER}, found AS (SELECT place_id, g.xmin, g.ymin, g.xmax, g.ymax FROM keys JOIN gazetteer g USING (osm_id, osm_type)),"
    " cells AS (SELECT DISTINCT * FROM " + _CELLS.format(keys="place_id", p="", source="found") + ") SELECT place_id, count(*) * 0.0625 AS area FROM cells GROUP BY ALL",
)
def entity_reference_geometry(spark, d):
    """Area of all gazetteer rows that a place's key list names, united."""
    found = _keys(spark, d).join(_gazetteer(spark, d), ["osm_id", "osm_type"]).select("place_id", F.monotonically_increasing_id().alias("n"), "geom")
    found = stored(found, "found")
    united = R.united(R.member_edges(found.select("place_id", "n"), found, "n"), ["place_id"], "n")
    return R.areas(united, ["place_id"]).select("place_id", rounded(F.col("area")).alias("area"))


_WANTED = "SELECT DISTINCT 'O' || l_partkey AS osm_id, CASE l_linestatus WHEN 'O' THEN 'way' ELSE 'relation' END AS osm_type FROM lineitem"


@query("missing_shape_keys", X.with_sql("places")[:-1] + f", {_GAZETTEER}, wanted AS ({_WANTED}), skipped AS (SELECT 'O' || p_partkey AS osm_id, 'way' AS osm_type FROM part WHERE p_size > 40) SELECT * FROM wanted WHERE (osm_id, osm_type) NOT IN (SELECT (osm_id, osm_type) FROM gazetteer) AND (osm_id, osm_type) NOT IN (SELECT (osm_id, osm_type) FROM skipped)")
def missing_shape_keys(spark, d):
    wanted = table(spark, d, "lineitem").select(
        F.concat(F.lit("O"), "l_partkey").alias("osm_id"),
        F.when(F.col("l_linestatus") == "O", "way").otherwise("relation").alias("osm_type"),
    )
    skipped = table(spark, d, "part").where("p_size > 40").select(F.concat(F.lit("O"), "p_partkey").alias("osm_id"), F.lit("way").alias("osm_type"))
    return gazetteer.missing_keys(wanted, _gazetteer(spark, d), skipped)


def _ingest(spark, d):
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("O"), "l_suppkey").alias("osm_id"),
        F.when(F.col("l_linestatus") == "O", "way").otherwise("relation").alias("osm_type"),
        F.when(F.col("l_returnflag") != "R", F.col("l_partkey")).alias("shape"),
        F.expr("l_orderkey * 100000000 + l_partkey * 10 + l_linenumber").alias("ingest"),
    )


_INGEST = "ingest AS (SELECT 'O' || l_suppkey AS osm_id, CASE l_linestatus WHEN 'O' THEN 'way' ELSE 'relation' END AS osm_type, CASE WHEN l_returnflag <> 'R' THEN l_partkey END AS shape, l_orderkey * 100000000 + l_partkey * 10 + l_linenumber AS ingest FROM lineitem)"


@query("latest_shape", f"WITH {_INGEST} SELECT osm_id, osm_type, max(ingest) AS ingest FROM ingest GROUP BY ALL")
def latest_shape(spark, d):
    return gazetteer.latest(_ingest(spark, d), "ingest").select("osm_id", "osm_type", "ingest")


@query("insert_if_absent", f"WITH {_INGEST}, known AS (SELECT DISTINCT 'O' || s_suppkey AS osm_id FROM supplier WHERE s_acctbal < 5000) SELECT osm_id, osm_type, arg_min(shape, ingest) AS shape FROM ingest WHERE shape IS NOT NULL AND NOT (osm_type = 'way' AND osm_id IN (SELECT osm_id FROM known)) GROUP BY ALL")
def insert_if_absent(spark, d):
    known = table(spark, d, "supplier").where("s_acctbal < 5000").select(F.concat(F.lit("O"), "s_suppkey").alias("osm_id"), F.lit("way").alias("osm_type"))
    return gazetteer.insert_if_absent(_ingest(spark, d), known, "ingest", "shape").select("osm_id", "osm_type", "shape")


@query("pending_entities", X.with_sql("entities", "predictions") + "SELECT entity_id, status FROM entities WHERE entity_id NOT IN (SELECT entity_id FROM predictions)")
def pending_entities(spark, d):
    return gazetteer.pending(X.entities(spark, d).select("entity_id", "status"), X.predictions(spark, d))


@query("dense_numbers", X.with_sql("entities") + "SELECT entity_id, status, row_number() OVER (ORDER BY status, entity_id) AS number FROM entities")
def dense_numbers(spark, d):
    """Numbers of all entities in the order of status and id."""
    rows = X.entities(spark, d).select("entity_id", "status")
    return numbered(rows, F.col("status"), F.col("entity_id"))


@query(
    "predicted_geometry",
    X.with_sql("entities", "predictions")[:-1] + ", stored AS (SELECT entity_id, pxmin, pymin, pxmax, pymax FROM predictions UNION ALL SELECT entity_id, pxmin + 1, pymin, pxmax + 1, pymax FROM predictions WHERE entity_id IN (SELECT entity_id FROM entities WHERE status = '2')),"
    " cells AS (SELECT DISTINCT * FROM " + _CELLS.format(keys="entity_id", p="p", source="stored") + "), found AS (SELECT entity_id, count(*) * 0.0625 AS area FROM cells GROUP BY ALL)"
    " SELECT entity_id, round(coalesce(area, 0), 6) + 0 AS area FROM entities LEFT JOIN found USING (entity_id)",
)
def predicted_geometry(spark, d):
    """Stored predictions of every entity, united when there are several, empty when there are none."""
    first = X.predictions(spark, d)
    second = first.join(X.entities(spark, d).where("status = '2'").select("entity_id"), "entity_id", "left_semi").withColumns(
        {"pxmin": F.col("pxmin") + 1, "pxmax": F.col("pxmax") + 1}
    )
    both = first.unionByName(second).select("entity_id", X.predicted_box().alias("geom"))
    edges = R.edges(both.withColumn("n", F.xxhash64("geom")))
    areas = R.areas(R.united(edges, ["entity_id"], "n"), ["entity_id"])
    return X.entities(spark, d).select("entity_id").join(areas, "entity_id", "left").select(
        "entity_id", rounded(F.coalesce("area", F.lit(0.0))).alias("area")
    )


@query(
    "assemble_shapes",
    "WITH members AS (SELECT l_orderkey AS o, l_suppkey AS node, count(*) AS n FROM lineitem GROUP BY ALL), t AS (SELECT o, o_orderstatus AS s, count(*) AS points, count(DISTINCT node % 3) AS ways"
    " FROM members JOIN orders ON o = o_orderkey GROUP BY ALL)"
    " SELECT o AS osm_key, CASE s WHEN 'O' THEN 'MultiLineString' WHEN 'P' THEN 'MultiPoint' ELSE 'LineString' END AS kind, CASE s WHEN 'O' THEN ways WHEN 'P' THEN points ELSE 1 END AS parts, points FROM t",
)
def assemble_shapes(spark, d):
    """Orders as mapped objects: places are nodes; open orders are relations of ways, pending ones of nodes, others ways."""
    status = F.col("o_orderstatus")
    members = (
        X.links(spark, d)
        .join(table(spark, d, "orders"), F.col("entity_id") == F.col("o_orderkey"))
        .select(
            F.col("entity_id").cast("string").alias("osm_id"),
            F.when(status == "F", "way").otherwise("relation").alias("osm_type"),
            F.when(status == "O", F.col("place_id") % 3).when(status == "F", F.lit(0)).cast("int").alias("way_no"),
            F.col("place_id").alias("node_no"),
            F.col("place_id").alias("node_id"),
        )
    )
    nodes = X.places(spark, d).select(F.col("place_id").alias("node_id"), F.col("xmin").alias("x"), F.col("ymin").alias("y"))
    shaped = gazetteer.assemble(members, nodes)
    return shaped.select(
        F.col("osm_id").cast("bigint").alias("osm_key"), "geom.kind", F.size("geom.parts").cast("bigint").alias("parts"),
        F.size(F.flatten(F.flatten("geom.parts"))).cast("bigint").alias("points"),
    )


# ---- filters and corpus tables -------------------------------------------------------------------


@query("filter_status", X.with_sql("entities") + "SELECT entity_id, gxmin, gymin FROM entities WHERE status = '5'")
def filter_status(spark, d):
    return X.entities(spark, d).where("status = '5'").select("entity_id", "gxmin", "gymin")


@query("filter_in_operators", X.with_sql("entities") + "SELECT entity_id, status FROM entities WHERE entity_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')")
def filter_in_operators(spark, d):
    """Entities that have operator rows, whatever their status."""
    rows = table(spark, d, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("entity_id"))
    return X.entities(spark, d).select("entity_id", "status").join(rows, "entity_id", "left_semi")


_TYPED = "CASE l_returnflag WHEN 'A' THEN 'node' WHEN 'N' THEN 'way' ELSE 'relation' END"


@query("filter_non_node", f"SELECT l_orderkey, l_partkey, l_linenumber, {_TYPED} AS osm_type FROM lineitem WHERE {_TYPED} <> 'node'")
def filter_non_node(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.expr(_TYPED).alias("osm_type")).where("osm_type <> 'node'")


_STATUS = "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE substr(o_orderpriority, 1, 1) END"


@query("status_statistics", "SELECT count(*) AS total, count(s) AS annotated, " + ", ".join(f"CAST(count_if(s = '{s}') AS BIGINT) AS status_{s}" for s in L.STATUSES) + f" FROM (SELECT {_STATUS} AS s FROM orders)")
def status_statistics(spark, d):
    return annotation.status_statistics(table(spark, d, "orders").select(F.expr(_STATUS).alias("status")))


_BODY = "'In <link id=\"E_1_1\" osm=\"O' || o_custkey || '\">Place ' || o_custkey || '</link> near <link id=\"E_1_2\" class=\"removed\">Old ' || o_orderkey || '</link> and <link id=\"E_1_3\">x</link>.'"


@query(
    "annotation_upsert",
    f"SELECT o_orderkey AS entity_id, CASE WHEN o_orderstatus = 'F' THEN '5' ELSE substr(o_orderpriority, 1, 1) END AS status, CASE WHEN o_orderstatus = 'F' THEN 'In <link id=\"E_1_1\" osm=\"O' || o_custkey || '\">Place ' || o_custkey || '</link> near Old ' || o_orderkey || ' and <link id=\"E_1_3\">x</link>.' ELSE 'before' END AS body,"
    " CAST(CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 0 END AS BIGINT) AS num_links FROM orders",
)
def annotation_upsert(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_orderkey", "entity_id")
    base = orders.select("entity_id", F.expr("substr(o_orderpriority, 1, 1)").alias("status"), F.lit("before").alias("body"))
    changed = orders.where("o_orderstatus = 'F'").select("entity_id", F.lit("5").alias("status"), F.expr(_BODY.replace("o_orderkey", "entity_id")).alias("body"))
    return annotation.upsert(base, changed)


@query(
    "osm_query_list",
    X.with_sql("links")[:-1] + ", refs AS (SELECT entity_id, CAST(-1 AS BIGINT) AS place_id, 'relation' AS t, 'E' || entity_id AS ref FROM (SELECT DISTINCT entity_id FROM links) UNION ALL SELECT entity_id, place_id, 'way', 'O' || place_id FROM links)"
    " SELECT entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY place_id) AS pos, '<id-query type=\"' || t || '\" ref=\"' || ref || '\"/>' AS line FROM refs",
)
def osm_query_list(spark, d):
    """Query lines of an entity and its links in reading order, as rows: no entity's text is gathered."""
    links = X.links(spark, d)
    refs = links.select("entity_id", F.lit(-1).cast("bigint").alias("place_id"), F.lit("relation").alias("type"), F.concat(F.lit("E"), "entity_id").alias("ref")).distinct()
    refs = refs.unionByName(links.select("entity_id", "place_id", F.lit("way").alias("type"), F.concat(F.lit("O"), "place_id").alias("ref")))
    return annotation.query_lines(refs, "entity_id", "place_id").select("entity_id", "pos", "line")


# ---- joins ---------------------------------------------------------------------------------------


@query("spatial_join_contains", X.with_sql("places", "pings") + "SELECT ping_id, place_id FROM pings JOIN places ON x > xmin AND x < xmax AND y > ymin AND y < ymax")
def spatial_join_contains(spark, d):
    points = spread(X.pings(spark, d), "ping_id")
    return J.contains_join(points, X.place_shapes(spark, d).select("place_id", "geom"), 4.0).select("ping_id", "place_id")


@query("spatial_join_intersects", X.with_sql("places", "entities") + "SELECT entity_id, place_id FROM entities JOIN places ON gxmin <= xmax AND xmin <= gxmax AND gymin <= ymax AND ymin <= gymax")
def spatial_join_intersects(spark, d):
    gold = spread(X.entities(spark, d).select("entity_id", X.gold_box().alias("geom")), "entity_id")
    places = X.place_shapes(spark, d).select("place_id", E.col("geom").alias("other"))
    return J.intersects_join(gold, places, 4.0).select("entity_id", "place_id")


# ---- groups --------------------------------------------------------------------------------------

_PLACED = X.with_sql("places", "links")[:-1] + ", placed AS (SELECT * FROM links JOIN places USING (place_id))"


def _placed(spark, d):
    return X.links(spark, d).join(X.place_shapes(spark, d), "place_id").select("entity_id", "place_id", "geom")


@query("group_extent", _PLACED + " SELECT entity_id, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM placed GROUP BY ALL")
def group_extent(spark, d):
    return groups.extent(_placed(spark, d), ["entity_id"])


_SQ = "sqrt((max(xmax) - min(xmin)) ^ 2 + (max(ymax) - min(ymin)) ^ 2) / 2"


@query("group_bounds", _PLACED + f" SELECT entity_id, round((min(xmin) + max(xmax)) / 2 - {_SQ}, 6) + 0 AS xmin, round((min(ymin) + max(ymax)) / 2 - {_SQ}, 6) + 0 AS ymin, round((min(xmin) + max(xmax)) / 2 + {_SQ}, 6) + 0 AS xmax, round((min(ymin) + max(ymax)) / 2 + {_SQ}, 6) + 0 AS ymax FROM placed GROUP BY ALL")
def group_bounds(spark, d):
    found = groups.bounds(_placed(spark, d), ["entity_id"], squared=True)
    return found.select("entity_id", *[rounded(F.col(c)).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


_PAD = "(greatest(max(xmax) - min(xmin), max(ymax) - min(ymin)) - ({b} - {a})) / 2"
_PADX, _PADY = _PAD.format(a="min(xmin)", b="max(xmax)"), _PAD.format(a="min(ymin)", b="max(ymax)")


@query("square_bounds", _PLACED + f" SELECT entity_id, min(xmin) - {_PADX} AS xmin, min(ymin) - {_PADY} AS ymin, max(xmax) + {_PADX} AS xmax, max(ymax) + {_PADY} AS ymax FROM placed GROUP BY ALL")
def square_bounds(spark, d):
    return groups.padded_to_square(groups.extent(_placed(spark, d), ["entity_id"]), ["entity_id"])


_LARGEST = "largest AS (SELECT entity_id, arg_max(place_id, ((xmax - xmin) * (ymax - ymin)) * 1000000 - place_id) AS place_id, max((xmax - xmin) * (ymax - ymin)) AS area FROM placed GROUP BY ALL)"


@query("largest_of_group", _PLACED + f", {_LARGEST} SELECT * FROM largest")
def largest_of_group(spark, d):
    return groups.largest(_placed(spark, d), "entity_id", "place_id")


@query(
    "limit_to_inner",
    _PLACED + f", {_LARGEST}, rest AS (SELECT p.entity_id, min(xmin) AS rx0, min(ymin) AS ry0, max(xmax) AS rx1, max(ymax) AS ry1 FROM placed p JOIN largest l ON p.entity_id = l.entity_id AND p.place_id <> l.place_id GROUP BY ALL),"
    " joined AS (SELECT p.*, l.place_id = p.place_id AND rx0 >= xmin AND rx1 <= xmax AND ry0 >= ymin AND ry1 <= ymax AS cut, rx0, ry0, rx1, ry1 FROM placed p JOIN largest l USING (entity_id) LEFT JOIN rest USING (entity_id))"
    " SELECT entity_id, place_id, CASE WHEN cut THEN rx0 ELSE xmin END AS xmin, CASE WHEN cut THEN ry0 ELSE ymin END AS ymin, CASE WHEN cut THEN rx1 ELSE xmax END AS xmax, CASE WHEN cut THEN ry1 ELSE ymax END AS ymax FROM joined",
)
def limit_to_inner(spark, d):
    inner = groups.limit_to_inner(_placed(spark, d), "entity_id", "place_id")
    return inner.select("entity_id", "place_id", G.bounds(GEOM).alias("b")).select("entity_id", "place_id", "b.*")


@query(
    "pick_reference_part",
    X.with_sql("shapes") + "SELECT shape_id, CAST(CASE form WHEN 3 THEN 33 ELSE 5 END AS BIGINT) AS points, CASE form WHEN 3 THEN x0 - 1 ELSE least(x0 - 1, x0) END AS xmin, y0 - 1 AS ymin,"
    " CASE form WHEN 3 THEN x0 + 1 ELSE greatest(x0 + 1, x0 + w) END AS xmax, CASE form WHEN 3 THEN y0 + 1 ELSE greatest(y0 + 1, y0 + h) END AS ymax FROM shapes",
)
def pick_reference_part(spark, d):
    """A disc of 33 points and a shape: two points are an outlier, five or seven are not."""
    disc = G.buffer_point(G.xy(E.col("x0"), E.col("y0")), E.lit(1.0))
    both = G.geometry("MultiPolygon", E.concat(disc["parts"], GEOM["parts"]))
    picked = X.shapes(spark, d).select("shape_id", groups.pick_reference(both).alias("g"))
    return picked.select("shape_id", G.num_points(E.col("g")).alias("points"), G.bounds(E.col("g")).alias("b")).select(
        "shape_id", "points", *[rounded(F.col(f"b.{c}")).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")]
    )


@query(
    "combine_entity_shapes",
    _PLACED + ", counts AS (SELECT entity_id, count(*) AS inputs, sum((xmax - xmin) * (ymax - ymin)) AS parts_area FROM placed GROUP BY ALL), covered AS (SELECT entity_id, i, j, count(*) AS inputs FROM "
    + _CELLS.format(keys="entity_id", p="", source="placed") + " GROUP BY ALL), common AS (SELECT entity_id, count(*) * 0.0625 AS area FROM covered JOIN counts USING (entity_id, inputs) GROUP BY ALL)"
    " SELECT entity_id, inputs, CASE WHEN area IS NULL THEN 'collection' WHEN inputs = 1 THEN 'single' ELSE 'intersection' END AS form, round(coalesce(area, parts_area), 6) + 0 AS area FROM counts LEFT JOIN common USING (entity_id)",
)
def combine_entity_shapes(spark, d):
    """One shape as it is, several as their intersection, or as a collection when they have none."""
    shapes = X.place_shapes(spark, d)
    members = X.links(spark, d)
    return groups.combine(members, shapes, ["entity_id"], "place_id").select(
        "entity_id", "inputs", "form", rounded(F.col("area")).alias("area")
    )


# ---- baselines -----------------------------------------------------------------------------------


def _extreme_sql(pick: str, sign: str) -> str:
    return _PLACED + f" SELECT entity_id, {pick}(place_id, (xmax - xmin) * (ymax - ymin) * 1000000 + 2e-2 * (xmax - xmin + ymax - ymin) {sign} place_id * 1e-6) AS place_id FROM placed GROUP BY ALL"


def _extremes(spark, d):
    return baselines.extremes(X.links(spark, d), X.place_shapes(spark, d), ["entity_id"], "place_id")


@query("baseline_max_area", _extreme_sql("arg_max", "-"))
def baseline_max_area(spark, d):
    return _extremes(spark, d).select("entity_id", F.col("max_key").alias("place_id"))


@query("baseline_min_area", _extreme_sql("arg_min", "+"))
def baseline_min_area(spark, d):
    return _extremes(spark, d).select("entity_id", F.col("min_key").alias("place_id"))


def _method_areas(spark, d, methods=baselines.METHODS):
    gold = X.entities(spark, d).where("status = '5'").select("entity_id", X.gold_box().alias("gold"))
    return baselines.method_areas(gold, X.links(spark, d), X.place_shapes(spark, d), "entity_id", "place_id", methods)


_CELL_AREA = "6378137e0 * radians(25e-2) * 6378137e0 * (ln(tan(pi() / 4 + radians((j + 1) * 25e-2) / 2)) - ln(tan(pi() / 4 + radians(j * 25e-2) / 2)))"
_METHOD_SQL = X.with_sql("places", "entities", "links")[:-1] + (
    ", scored AS (SELECT entity_id, gxmin, gymin, gxmax, gymax FROM entities WHERE status = '5'), placed AS (SELECT * FROM links JOIN places USING (place_id) WHERE entity_id IN (SELECT entity_id FROM scored)),"
    " picks AS (SELECT entity_id, arg_max(place_id, (xmax - xmin) * (ymax - ymin) * 1000000 + 2e-2 * (xmax - xmin + ymax - ymin) - place_id * 1e-6) AS mx, arg_min(place_id, (xmax - xmin) * (ymax - ymin) * 1000000 + 2e-2 * (xmax - xmin + ymax - ymin) + place_id * 1e-6) AS mn, count(*) AS inputs FROM placed GROUP BY ALL),"
    " flagged AS (SELECT placed.*, place_id = mx AS is_max, place_id = mn AS is_min FROM placed JOIN picks USING (entity_id)),"
    " covered AS (SELECT entity_id, i, j, count(*) AS depth, bool_or(is_max) AS in_max, bool_or(is_min) AS in_min FROM " + _CELLS.format(keys="entity_id, is_max, is_min", p="", source="flagged") + " GROUP BY ALL),"
    " own AS (SELECT entity_id, i, j, true AS in_gold FROM " + _CELLS.format(keys="entity_id", p="g", source="scored") + "),"
    f" cells AS (SELECT *, coalesce(depth = inputs, false) AS in_all, {_CELL_AREA} AS a FROM covered FULL JOIN own USING (entity_id, i, j) JOIN picks USING (entity_id)),"
    " areas AS (SELECT entity_id, coalesce(sum(a) FILTER (in_gold), 0) AS gold_area, " + ", ".join(
        f"coalesce(sum(a) FILTER ({c}), 0) AS {m}_area, coalesce(sum(a) FILTER ({c} AND in_gold), 0) AS {m}_overlap"
        for m, c in (("max", "in_max"), ("min", "in_min"), ("union", "depth > 0"), ("intersection", "in_all"))
    ) + " FROM cells GROUP BY ALL),"
    " methods AS (" + " UNION ALL ".join(f"SELECT entity_id, '{m}' AS method, gold_area, {m}_area AS guess_area, {m}_overlap AS overlap FROM areas" for m in baselines.METHODS) + ")"
)


def _method_sql(method: str) -> str:
    return _METHOD_SQL + f" SELECT entity_id, round(guess_area / 1e6, 3) + 0 AS area_km2, round(overlap / 1e6, 3) + 0 AS overlap_km2 FROM methods WHERE method = '{method}'"


def _one_method(spark, d, method):
    return _method_areas(spark, d, (method,)).select(
        "entity_id", rounded(G.to_km(F.col("guess_area"), True), 3).alias("area_km2"), rounded(G.to_km(F.col("overlap"), True), 3).alias("overlap_km2")
    )


@query("baseline_union", _method_sql("union"))
def baseline_union(spark, d):
    return _one_method(spark, d, "union")


@query("baseline_intersection", _method_sql("intersection"))
def baseline_intersection(spark, d):
    return _one_method(spark, d, "intersection")


_P, _R = "sum(p) / count(p)", "sum(r) / count(*)"


@query(
    "score_baselines",
    _METHOD_SQL + ", scores AS (SELECT method, CASE WHEN guess_area > 0 THEN overlap / guess_area END AS p, CASE WHEN guess_area > 0 THEN overlap / gold_area END AS r FROM methods)"
    f" SELECT method, count(*) AS total_gold, count(p) AS total_predicted, round({_P}, 6) + 0 AS p, round({_R}, 6) + 0 AS r, round(2 * {_P} * {_R} / ({_P} + {_R}), 6) + 0 AS f, round(count(p) / count(*), 6) + 0 AS coverage FROM scores GROUP BY ALL",
)
def score_baselines(spark, d):
    """P, R, F of the four baselines over all complete entities."""
    scores = baselines.method_scores(_method_areas(spark, d), "entity_id")
    totals = S.sum_scores(scores, ["method"], F.count(F.lit(1)), {"": True})
    return totals.select("method", "total_gold", "total_predicted", *[rounded(F.col(c)).alias(c) for c in ("p", "r", "f", "coverage")])
