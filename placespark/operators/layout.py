"""How rows are laid out over tasks: spreading small inputs and splitting hot keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Shuffle files go at the end of a job whose rows are stored, rather than when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of shapes and texts are heavy in work and light in bytes: partitions are joined until each core has one, but not below that.
SMALLEST = "spark.sql.adaptive.coalescePartitions.minPartitionSize"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors all see: in spark.checkpoint.dir, or in the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    base = base or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, for what several steps read: cuts lineage, later plans know its size."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    own = {CLEANUP: "true", SMALLEST: "16KB"}
    before = {name: spark.conf.get(name, None) for name in own}
    for name, value in own.items():
        spark.conf.set(name, value)
    try:
        df.write.parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give every core a share of an input that is heavy in work per row, whatever its size in bytes.

    The number of tasks is given, as adaptive execution would join small partitions by their bytes. It is not that of other
    shuffles: Spark drops a repartition that equals the shuffle of a distinct below it, whose partitions are joined then."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(max(cores, int(spark.conf.get("spark.sql.shuffle.partitions")) + 1), *keys)


def hot_keys(df: DataFrame, keys: list[str], share: float = 0.005) -> DataFrame:
    """Keys that hold more than ``share`` of all rows: at most 1 / share of them."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    limit = df.agg(F.count(F.lit(1)) * share).scalar()
    return counts.where(F.col("_n") > limit).select(*keys, F.lit(True).alias("_hot"))


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], salts: int = 32, share: float = 0.005) -> DataFrame:
    """Inner join that deals the left rows of hot keys over ``salts`` tasks.

    Only the right rows of hot keys are repeated, once per salt. The list of hot keys has at most
    1 / share rows, so it may be broadcast. The repeated side is not: all rows of a key that has many lie side by side in a
    merge, and far apart in a hash table."""
    hot = F.broadcast(hot_keys(left, keys, share))
    salted = left.join(hot, keys, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(salts))).otherwise(0)
    )
    repeated = right.join(hot, keys, "left").withColumn(
        "_salt",
        F.explode(
            F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")).otherwise(
                F.array(F.lit(0).cast("bigint"))
            )
        ),
    )
    return salted.drop("_hot").join(repeated.drop("_hot").hint("merge"), [*keys, "_salt"]).drop("_salt")


def numbered(df: DataFrame, *order: Column, name: str = "number") -> DataFrame:
    """Rows with numbers from 1 on in the given order, without a task that sees all of them: they are sorted in ranges, and each
    range starts after the rows of those before it."""
    ranges = stored(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # one row a range
    before = F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")
    counts = F.broadcast(counts.select("_range", before.alias("_before")))
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranges.withColumn("_nth", nth).join(counts, "_range").withColumn(name, F.col("_before") + F.col("_nth")).drop("_range", "_nth", "_before")


def cell_of(value: Column, size: float) -> Column:
    return F.floor(value / size)


def running_total(df: DataFrame, keys: list[str], order: str, value: str, bucket: int) -> DataFrame:
    """Running sum of ``value`` along ``order`` within keys, as column ``total``.

    Sums are taken inside buckets of ``order`` and over the buckets' sums, so the rows of one key
    are dealt over many tasks."""
    cut = df.withColumn("_bucket", F.floor(F.col(order) / bucket))
    sums = cut.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    along = Window.partitionBy(*keys, "_bucket").orderBy(order)
    return (
        cut.join(offsets, [*keys, "_bucket"])
        .withColumn("total", F.sum(value).over(along) + F.col("_before"))
        .drop("_bucket", "_before")
    )
