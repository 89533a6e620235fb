"""Cutting lineage so that a lost executor costs no more than the tasks it ran."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; where it is unset a temporary one, in local mode alone, as in tests."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return context._jsc.sc().getCheckpointDir().get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set; it must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(folder)
    return folder


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Tables:
    """Tables written to the shared checkpoint folder, for loops: unlike a checkpoint, a table that is read again has its files' size and not
    one multiplied by each join before it, which in a loop soon has more digits than the planner can handle.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths = spark, f"{checkpoint_dir(spark)}/tables-{uuid.uuid4().hex}", []

    def written(self, df: DataFrame) -> DataFrame:
        self.paths.append(f"{self.folder}/{len(self.paths)}")
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def drop_all_but(self, last: int) -> None:
        """Deletes all tables but the `last` ones."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        for path in self.paths[:-last]:
            hadoop(path).getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop(path), True)


def gathered(df: DataFrame, *keys: str, partitions: int | None = None) -> DataFrame:
    """df with rows of equal keys in one partition, next to each other.

    Dealt by a hash of the keys: where a join has already dealt rows by the plain keys, the planner leaves out another
    repartition by them, and adaptive execution may then read that join's partitions in pieces, which parts equal keys.
    """
    dealt = F.xxhash64(*keys)
    return (df.repartition(dealt) if partitions is None else df.repartition(partitions, dealt)).sortWithinPartitions(*keys)
