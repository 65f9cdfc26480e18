"""Place data derived from the driver tables.

Each fixture is a list of SQL expressions over one table. Spark takes them through ``selectExpr``;
the check engine gets the same text as a CTE. Coordinates are multiples of 0.25, so that box areas
are exact in doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from placespark.functions import exprs as F
from placespark.functions import geom as G
from placespark.sources.tables import table

_PLACE_X = "CAST((s_suppkey * 37) % 64 AS DOUBLE) * 5e-1"
_PLACE_Y = "CAST((s_suppkey * 53) % 40 AS DOUBLE) * 5e-1"
PLACES = [
    "s_suppkey AS place_id",
    f"{_PLACE_X} - 25e-2 * (1 + s_suppkey % 8) AS xmin",
    f"{_PLACE_Y} - 25e-2 * (1 + s_suppkey % 5) AS ymin",
    f"{_PLACE_X} + 25e-2 * (1 + s_suppkey % 8) AS xmax",
    f"{_PLACE_Y} + 25e-2 * (1 + s_suppkey % 5) AS ymax",
    "CASE WHEN s_nationkey < 8 THEN 'N' WHEN s_nationkey < 14 THEN 'E'"
    " WHEN s_nationkey < 20 THEN 'S' ELSE 'W' END AS cardinal",
]

_GOLD_X = "CAST((o_custkey * 29) % 64 AS DOUBLE) * 5e-1"
_GOLD_Y = "CAST((o_custkey * 31) % 40 AS DOUBLE) * 5e-1"
ENTITIES = [
    "o_orderkey AS entity_id",
    "substr(o_orderpriority, 1, 1) AS status",
    f"{_GOLD_X} AS gxmin",
    f"{_GOLD_Y} AS gymin",
    f"{_GOLD_X} + 1 + o_custkey % 3 AS gxmax",
    f"{_GOLD_Y} + 1 + o_custkey % 4 AS gymax",
    "o_orderstatus",
]

# Gold moved by a key-dependent step; pending orders have no prediction.
PREDICTIONS = [
    "entity_id",
    "gxmin + 5e-1 * (entity_id % 4) AS pxmin",
    "gymin + 5e-1 * (entity_id % 3) AS pymin",
    "gxmax + 5e-1 * (entity_id % 4) AS pxmax",
    "gymax + 5e-1 * (entity_id % 3) AS pymax",
]
PREDICTED = "o_orderstatus <> 'P'"

# One shape per part: 0 box, 1 diamond, 2 box without its upper right quarter, 3 diagonal line.
SHAPES = [
    "p_partkey AS shape_id",
    "CAST(p_partkey % 4 AS INT) AS form",
    "CAST((p_partkey * 37) % 64 AS DOUBLE) * 5e-1 AS x0",
    "CAST((p_partkey * 53) % 40 AS DOUBLE) * 5e-1 AS y0",
    "5e-1 * (1 + p_size % 8) AS w",
    "5e-1 * (1 + p_partkey % 5) AS h",
]

PINGS = [
    "event_id AS ping_id",
    "CAST((user_id * 17) % 128 AS DOUBLE) * 25e-2 AS x",
    "CAST((event_id * 13) % 80 AS DOUBLE) * 25e-2 AS y",
]


def _cte(name: str, columns: list[str], source: str, where: str = "") -> str:
    return f"{name} AS (SELECT {', '.join(columns)} FROM {source}{' WHERE ' + where if where else ''})"


LINKS_SQL = "links AS (SELECT DISTINCT l_orderkey AS entity_id, l_suppkey AS place_id FROM lineitem)"
PAIRS_SQL = "pairs AS (SELECT DISTINCT l_partkey AS shape_id, l_suppkey AS place_id FROM lineitem)"

CTES = {
    "places": _cte("places", PLACES, "supplier"),
    "entities": _cte("entities", ENTITIES, "orders"),
    "predictions": _cte("predictions", PREDICTIONS, "entities", PREDICTED),
    "shapes": _cte("shapes", SHAPES, "part"),
    "pings": _cte("pings", PINGS, "events"),
    "links": LINKS_SQL,
    "pairs": PAIRS_SQL,
    # Corner lists as [x, y] lists, closed for areas.
    "corners": (
        "corners AS (SELECT *, CASE form"
        " WHEN 0 THEN [[x0, y0], [x0 + w, y0], [x0 + w, y0 + h], [x0, y0 + h], [x0, y0]]"
        " WHEN 1 THEN [[x0 + w / 2, y0], [x0 + w, y0 + h / 2], [x0 + w / 2, y0 + h], [x0, y0 + h / 2], [x0 + w / 2, y0]]"
        " WHEN 2 THEN [[x0, y0], [x0 + w, y0], [x0 + w, y0 + h / 2], [x0 + w / 2, y0 + h / 2],"
        " [x0 + w / 2, y0 + h], [x0, y0 + h], [x0, y0]]"
        " ELSE [[x0, y0], [x0 + w, y0 + h]] END AS pts FROM shapes)"
    ),
    "corner_points": (
        "corner_points AS (SELECT shape_id, form, i AS pos, pts[i][1] AS x, pts[i][2] AS y, len(pts) AS n"
        " FROM (SELECT *, unnest(range(1, len(pts) + 1)) AS i FROM corners))"
    ),
    "corner_edges": (
        "corner_edges AS (SELECT shape_id, form, i AS pos, pts[i][1] AS x1, pts[i][2] AS y1,"
        " pts[i + 1][1] AS x2, pts[i + 1][2] AS y2"
        " FROM (SELECT *, unnest(range(1, len(pts))) AS i FROM corners))"
    ),
}
_NEEDS = {
    "predictions": ["entities"],
    "corners": ["shapes"],
    "corner_points": ["shapes", "corners"],
    "corner_edges": ["shapes", "corners"],
}


def with_sql(*names: str) -> str:
    """WITH clause that defines the named fixtures and what they need."""
    order: list[str] = []
    for name in names:
        for needed in [*_NEEDS.get(name, []), name]:
            if needed not in order:
                order.append(needed)
    return "WITH " + ", ".join(CTES[name] for name in order) + " "


def places(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").selectExpr(*PLACES)


def entities(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").selectExpr(*ENTITIES)


def links(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "lineitem")
        .select(F.col("l_orderkey").alias("entity_id"), F.col("l_suppkey").alias("place_id"))
        .distinct()
    )


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "lineitem")
        .select(F.col("l_partkey").alias("shape_id"), F.col("l_suppkey").alias("place_id"))
        .distinct()
    )


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    return entities(spark, folder).where(PREDICTED).selectExpr(*PREDICTIONS)


def pings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(*PINGS)


def shape_geometry():
    """Geometry of a shape row from form, x0, y0, w, h."""
    x0, y0, w, h = F.col("x0"), F.col("y0"), F.col("w"), F.col("h")
    box = F.array(G.xy(x0, y0), G.xy(x0 + w, y0), G.xy(x0 + w, y0 + h), G.xy(x0, y0 + h), G.xy(x0, y0))
    diamond = F.array(
        G.xy(x0 + w / 2, y0), G.xy(x0 + w, y0 + h / 2), G.xy(x0 + w / 2, y0 + h), G.xy(x0, y0 + h / 2), G.xy(x0 + w / 2, y0)
    )
    ell = F.array(
        G.xy(x0, y0), G.xy(x0 + w, y0), G.xy(x0 + w, y0 + h / 2), G.xy(x0 + w / 2, y0 + h / 2),
        G.xy(x0 + w / 2, y0 + h), G.xy(x0, y0 + h), G.xy(x0, y0),
    )
    line = F.array(G.xy(x0, y0), G.xy(x0 + w, y0 + h))
    form = F.col("form")
    ring = F.when(form == 0, box).when(form == 1, diamond).when(form == 2, ell).otherwise(line)
    return G.geometry(F.when(form < 3, F.lit("Polygon")).otherwise(F.lit("LineString")), F.array(F.array(ring)))


def shapes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").selectExpr(*SHAPES).withColumn("geom", shape_geometry())


def place_shapes(spark: SparkSession, folder: str) -> DataFrame:
    box = G.box(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"))
    return places(spark, folder).withColumn("geom", box)


def gold_box():
    return G.box(F.col("gxmin"), F.col("gymin"), F.col("gxmax"), F.col("gymax"))


def predicted_box():
    return G.box(F.col("pxmin"), F.col("pymin"), F.col("pxmax"), F.col("pymax"))
