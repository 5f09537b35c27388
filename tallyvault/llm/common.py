"""What the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyvault.storage import settle


__all__ = ["bounded", "fold", "parts", "placed", "settle", "short_batches", "table"]

#: A table of at most so many short rows may be broadcast.
BROADCAST_ROWS = 250_000
#: Of the rows of a task, so much goes to its Python worker at once.
BATCH = "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def parts(df: DataFrame) -> int:
    """Shuffle partitions of the session, for explicit repartitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bounded(small: DataFrame) -> DataFrame:
    """`small`, a table of short rows, to be broadcast if it has at most BROADCAST_ROWS; else to be joined by shuffling."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def short_batches(spark: SparkSession) -> None:
    """From now on the session hands rows to Python workers by BATCH, unless it has a bound of its own; a longer row goes by itself.

    Spark's bound is 64 MB or 10,000 rows.  The JVM holds a batch more than once, outside
    its heap, and the worker as Arrow and as Python's strings; what both took for one stage
    they keep for those that follow.  Only memory hangs on the bound, no result does.
    """
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(bound, spark.conf.get(bound, BATCH))


def placed(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """`df` with each row's place (__tv_place, from 0) in the order of some columns within its group, and the group's size (__tv_size).

    Rows are sorted by range over all groups, so a group may lie in many tasks; the counts
    of each task and group then give every task its groups' first places.  `group` is not
    null.  Rows that are equal in all of `order` meet in one task.
    """
    ordered = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    marked = settle(ordered.withColumn("__tv_part", F.spark_partition_id()).withColumn("__tv_row", F.monotonically_increasing_id()))
    runs = marked.groupBy("__tv_part", group).agg(F.count("*").alias("__tv_n"), F.min("__tv_row").alias("__tv_first"))
    every = Window.partitionBy(group)  # a row a task that holds some of the group
    before = F.sum("__tv_n").over(every.orderBy("__tv_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__tv_n")
    firsts = settle(runs.select("__tv_part", group, (before - F.col("__tv_first")).alias("__tv_before"), F.sum("__tv_n").over(every).alias("__tv_size")))
    return marked.join(bounded(firsts), ["__tv_part", group]).withColumn("__tv_place", F.col("__tv_row") + F.col("__tv_before")).drop("__tv_part", "__tv_row", "__tv_before")
