"""The live log: the index fold as a stateful stream.

State is one row a key, in RocksDB on the executors' disks, and stays until compaction, as tombstones must be remembered: the least
sound put and the places of all sound deletes. It does not depend on the order of arrival: a put that comes late can bring back
a delete that was before the puts known so far. A key's state grows with its deletes, of which each place counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def fold_stream(oplog: DataFrame) -> DataFrame:
    """Updates of the index (see `operators.oplog.fold_index`) for each key that a batch touches; use output mode update."""
    put = F.when(F.col("msg_type") == "PUT_BLOB", F.struct("lsn", "blk_count"))
    deleted = F.when((F.col("msg_type") == "DEL_BLOB") & F.col("shard_id").isNotNull() & F.col("blob_id").isNotNull(), F.col("lsn"))
    keyed = oplog.where("NOT header_corrupted AND msg_type IN ('PUT_BLOB', 'DEL_BLOB')").groupBy("shard_id", "blob_id")
    folded = keyed.agg(F.min(put).alias("put"), F.collect_set(deleted).alias("deletes")).where("put IS NOT NULL")
    first = F.array_min(F.filter("deletes", lambda lsn: lsn > F.col("put.lsn")))
    return folded.select("shard_id", "blob_id", F.col("put.lsn").alias("put_lsn"), first.alias("del_lsn"), F.col("put.blk_count").alias("blk_count"), first.isNotNull().alias("is_tombstone"))


def fold_files(spark: SparkSession, oplog: DataFrame, folder: str) -> DataFrame:
    """The folded index of a streamed log: runs `fold_stream` over all of it, keeps each batch's updates under `folder`, and returns the last state of each key."""
    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/updates/batch={number}")

    before = {name: spark.conf.get(name, None) for name in _STATE_STORE}
    for name, value in _STATE_STORE.items():
        spark.conf.set(name, value)
    try:  # a query keeps the settings that it starts with
        running = fold_stream(oplog).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(keep).start()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    running.awaitTermination()
    updates = spark.read.parquet(f"{folder}/updates")
    return updates.groupBy("shard_id", "blob_id").agg(*(F.max_by(c, "batch").alias(c) for c in ("put_lsn", "del_lsn", "blk_count", "is_tombstone")))
