"""Annotation tables: saving edits, counting states, query lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placespark.functions import lexicon as X
from placespark.operators.layout import running_total

REMOVED_LINK = r'(?s)<link\b[^>]*\bclass="removed"[^>]*>(.*?)</link>'


def upsert(base: DataFrame, changed: DataFrame, key: str = "entity_id") -> DataFrame:
    """Entities with the status and body of their edit where there is one.

    Removed links leave their text; num_links counts the links that stay."""
    edited = changed.select(
        key, F.col("status").alias("_status"), F.regexp_replace("body", REMOVED_LINK, "$1").alias("_body")
    )
    merged = base.join(edited, key, "left").select(
        key, F.coalesce("_status", "status").alias("status"), F.coalesce("_body", "body").alias("body")
    )
    return merged.withColumn("num_links", F.regexp_count("body", F.lit(r"<link\b")).cast("bigint"))


def status_statistics(entities: DataFrame) -> DataFrame:
    """One row: all entities, those with a status, and a count per status; an unknown status is an error."""
    unknown = F.count_if(F.col("status").isNotNull() & ~F.col("status").isin(*X.STATUSES))
    counts = entities.agg(
        F.count(F.lit(1)).alias("total"),
        F.count("status").alias("annotated"),
        *[F.count_if(F.col("status") == s).alias(f"status_{s}") for s in X.STATUSES],
        unknown.alias("_unknown"),
    )
    checked = F.when(F.col("_unknown") > 0, F.raise_error(F.lit("unknown status"))).otherwise(F.col("total"))
    return counts.withColumn("total", checked.cast("bigint")).drop("_unknown")


def query_lines(refs: DataFrame, group: str, order: str) -> DataFrame:
    """Numbered query lines from (group, order, type, ref)."""
    line = F.concat(F.lit('<id-query type="'), "type", F.lit('" ref="'), "ref", F.lit('"/>'))
    rows = refs.select(group, order, line.alias("line"), F.lit(1).cast("bigint").alias("_one"))
    return running_total(rows, [group], order, "_one", 4096).withColumnRenamed("total", "pos")
