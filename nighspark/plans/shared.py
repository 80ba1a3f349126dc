"""Tables written to the cluster's shared folder, to give rows an identity that survives recomputation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where none is set and the master is local, a temporary one of our own."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="nighspark-"))
    return shared_folder(spark)


def own_folder(spark: SparkSession, tag: str) -> str:
    """A new path within the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df by checkpoint() in the shared folder.

    Spark deletes checkpoints that nothing refers to any more if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """df with a unique long per row, fixed by a checkpoint."""
    return checkpointed(df.withColumn(name, F.monotonically_increasing_id()))


#: Rows of a kind, on the mean, from which rows go through a join together, and how many of them at most, about.
COPIES, TOGETHER = 4, 256


def together(df: DataFrame, keys: list[str], carried: Column, rows: str, most: int = TOGETHER) -> tuple[DataFrame, bool]:
    """df with what rows of equal keys carry in arrays, and whether one has several arrays."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("__ns_n"))
    held = F.collect_list(carried).alias(rows)
    if counts.agg(F.max("__ns_n")).first()[0] <= most:
        return df.groupBy(*keys).agg(held), False
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.ceil(F.col("__ns_n") / most)).alias("__ns_part")
    # merged, as what Spark takes for small may be too much for a broadcast
    return df.join(counts.hint("merge"), keys).select(*df.columns, part).groupBy(*keys, "__ns_part").agg(held).drop("__ns_part"), True
