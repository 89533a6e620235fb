"""Reading and writing the store's tables as Parquet, laid out for the store's scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_index(blob: DataFrame, path: str) -> None:
    """The index by group, each file sorted by shard and blob, so that scans by shard skip row groups."""
    blob.repartitionByRange("pg_id", "shard_id").sortWithinPartitions("pg_id", "shard_id", "blob_id").write.partitionBy("pg_id").parquet(path)


def read_index(spark: SparkSession, path: str, pg_id: int | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if pg_id is None else rows.where(F.col("pg_id") == pg_id)


def stream_log(spark: SparkSession, path: str, schema: str, files_a_batch: int = 1) -> DataFrame:
    """The log as a stream of Parquet files, in order of their time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)
