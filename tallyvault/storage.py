"""Checkpoints that outlive a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared(spark: SparkSession) -> str:
    """The folder that all executors and the driver see: `spark.checkpoint.dir`.

    Only a local session without that setting gets a folder of its own; a cluster without
    it is refused, since its executors could not see each other's files.
    """
    context, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if not named and context.getCheckpointDir() is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tallyvault-"))
    return (named or context.getCheckpointDir()).rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    """The name of a folder in the shared one that nothing else uses."""
    return f"{shared(spark)}/{kind}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and cut its lineage."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, folder: str) -> DataFrame:
    """`df` as it is read back from Parquet files in a folder; one job, where a checkpoint takes two."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def numbered(df: DataFrame, order: list[str | Column], name: str = "sequence") -> DataFrame:
    """`df` with its rows' places from 1 in the order of some columns, which are sorted by range.

    Counts by partition come first, so no task sees all rows, as one window over all would have it.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = settle(ordered.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    before, offsets = 0, []
    for r in marked.groupBy("_part").agg(F.count("*").alias("n"), F.min("_row").alias("first")).orderBy("_part").collect():  # a row a partition
        offsets.append((r["_part"], before - r["first"] + 1))
        before += r["n"]
    table = df.sparkSession.createDataFrame(offsets, "_part int, _offset long")
    return marked.join(F.broadcast(table), "_part").withColumn(name, F.col("_row") + F.col("_offset")).drop("_part", "_row", "_offset")
