"""Predictions for entities that arrive over time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from placespark.sources.gazetteer import append_predictions, pending


def predict_new(
    arriving: DataFrame, predict: Callable[[DataFrame], DataFrame], table: str, checkpoint: str, method: str
) -> StreamingQuery:
    """Append a prediction for every arriving entity that has none in the table yet.

    ``predict`` turns (entity_id, ...) rows into (entity_id, geom) rows. Entities already stored are left
    out of each batch and one that comes twice in it is taken once, so a batch that is run again after a failure adds nothing twice."""
    from pyspark.sql import functions as F

    schema = "entity_id string, geom string, method string"

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            stored = spark.read.schema(schema).parquet(table).where(F.col("method") == method)
        except Exception as error:  # no table before the first batch
            if "PATH_NOT_FOUND" not in str(error):
                raise
            stored = spark.createDataFrame([], schema)
        fresh = predict(pending(batch.dropDuplicates(["entity_id"]), stored)).withColumn("method", F.lit(method))
        append_predictions(fresh, table)

    return arriving.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
