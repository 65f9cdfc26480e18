"""The sentence that leads to each link, from the fragments since the last break only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placespark.functions import text as T
from placespark.operators.layout import running_total

#: A break that lies within one fragment: after it begins a sentence that is not blank.
BREAK = r"\.\s+[A-Z]"


def leading_sentences(fragments: DataFrame, key: str, order: str, bucket: int = 256) -> DataFrame:
    """(key, order, sentence) of each link, with the link itself as LOCATION, from fragments (key, order, text, is_link).

    Fragments are numbered by the breaks before them, with running sums over buckets, and a link only reads those of its own
    number: work grows with the length of sentences, not with that of paragraphs."""
    marked = fragments.withColumn("_breaks", F.coalesce(F.col("text"), F.lit("")).rlike(BREAK).cast("long"))
    numbered = running_total(marked, [key], order, "_breaks", bucket)
    told = numbered.select(key, order, F.col("total").alias("_part"), F.lit(1).alias("_turn"), "text", F.lit(False).alias("_asks"))
    asked = numbered.where("is_link").select(
        key, order, (F.col("total") - F.col("_breaks")).alias("_part"), F.lit(0).alias("_turn"), F.lit(None).cast("string").alias("text"), F.lit(True).alias("_asks")
    )
    upto = Window.partitionBy(key, "_part").orderBy(order, "_turn").rowsBetween(Window.unboundedPreceding, -1)
    before = told.unionByName(asked).withColumn("_before", F.array_join(F.collect_list("text").over(upto), ""))
    return before.where("_asks").select(key, order, T.last_sentence(F.concat("_before", F.lit("LOCATION"))).alias("sentence"))
