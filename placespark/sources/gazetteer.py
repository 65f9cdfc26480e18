"""Gazetteer and prediction tables: lookup, upkeep and append."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["osm_id", "osm_type"]


def lookup(keys: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Gazetteer rows of a set of keys, each once."""
    return gazetteer.join(keys.select(*KEY), KEY, "left_semi")


def missing_keys(wanted: DataFrame, known: DataFrame, skipped: DataFrame) -> DataFrame:
    """Distinct wanted keys that are neither known nor to be skipped."""
    return wanted.select(*KEY).distinct().join(known, KEY, "left_anti").join(skipped, KEY, "left_anti")


def latest(rows: DataFrame, order: str) -> DataFrame:
    """Last row per key; a partial maximum before the shuffle, so repeated keys stay cheap."""
    rest = [c for c in rows.columns if c not in KEY]
    best = rows.groupBy(*KEY).agg(F.max_by(F.struct(*rest), order).alias("row"))
    return best.select(*KEY, "row.*")


def insert_if_absent(new: DataFrame, existing: DataFrame, order: str, geom: str = "geom") -> DataFrame:
    """Rows to append: first non-null geometry of every key the table does not hold yet."""
    usable = new.where(F.col(geom).isNotNull())
    rest = [c for c in usable.columns if c not in KEY]
    first = usable.groupBy(*KEY).agg(F.min_by(F.struct(*rest), order).alias("row")).select(*KEY, "row.*")
    return first.join(existing.select(*KEY), KEY, "left_anti")


def pending(entities: DataFrame, stored: DataFrame, key: str = "entity_id") -> DataFrame:
    """Entities that have no stored prediction yet."""
    return entities.join(stored.select(key), key, "left_anti")


def append_predictions(predictions: DataFrame, path: str) -> None:
    """Add predictions (entity_id, geom, method) to a table partitioned by method."""
    predictions.write.mode("append").partitionBy("method").parquet(path)


def assemble(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Geometry per (osm_id, osm_type) from member ways and nodes.

    members: (osm_id, osm_type, way_no, node_no, node_id); relations become lines of their ways or, without
    ways, their points; ways become one line; nodes a point. One object's points are ordered together,
    as one geometry value has to hold them."""
    placed = members.join(nodes, "node_id")
    lines = placed.groupBy(*KEY, "way_no").agg(
        F.sort_array(F.collect_list(F.struct("node_no", "x", "y"))).alias("line")
    )
    point = lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))
    shaped = lines.withColumn("line", F.transform("line", point))
    objects = shaped.groupBy(*KEY).agg(
        F.sort_array(F.collect_list(F.when(F.col("way_no").isNotNull(), F.struct("way_no", "line")))).alias("ways"),
        F.first(F.when(F.col("way_no").isNull(), F.col("line")), ignorenulls=True).alias("loose"),
    )
    has_ways = F.size("ways") > 0
    kind = (
        F.when(F.col("osm_type") == "relation", F.when(has_ways, "MultiLineString").otherwise("MultiPoint"))
        .when((F.col("osm_type") == "way") & has_ways, "LineString")
        .when((F.col("osm_type") == "node") & F.col("loose").isNotNull(), "Point")
    )
    parts = (
        F.when((F.col("osm_type") != "node") & has_ways, F.transform("ways", lambda w: F.array(w["line"])))
        .otherwise(F.transform("loose", lambda p: F.array(F.array(p))))
    )
    return objects.select(*KEY, F.when(kind.isNotNull(), F.struct(kind.alias("kind"), parts.alias("parts"))).alias("geom"))
