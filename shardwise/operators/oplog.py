"""The commit log folded into state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fold_index(oplog: DataFrame) -> DataFrame:
    """The index that the log leaves: a key is live from its first sound put, and deleted by the first delete after that, for good. One grouped aggregation for each step, no ordering of a key's rows."""
    kept = oplog.where("NOT header_corrupted")
    puts = kept.where("msg_type = 'PUT_BLOB'").groupBy("shard_id", "blob_id").agg(F.min("lsn").alias("put_lsn"), F.min_by("blk_count", "lsn").alias("blk_count"), F.min_by("pg_id", "lsn").alias("pg_id"))
    deletes = kept.where("msg_type = 'DEL_BLOB'").select("shard_id", "blob_id", F.col("lsn").alias("del_lsn"))
    later = puts.select("shard_id", "blob_id", "put_lsn").join(deletes, ["shard_id", "blob_id"]).where("del_lsn > put_lsn").groupBy("shard_id", "blob_id").agg(F.min("del_lsn").alias("del_lsn"))
    return puts.join(later, ["shard_id", "blob_id"], "left").select("shard_id", "blob_id", "pg_id", "put_lsn", "del_lsn", "blk_count", F.col("del_lsn").isNotNull().alias("is_tombstone"))


def delete_outcomes(oplog: DataFrame) -> DataFrame:
    """Each delete succeeds; it moves the counters only if it is the one that deletes a live key."""
    folded = fold_index(oplog).select("shard_id", "blob_id", "del_lsn")
    deletes = oplog.where("msg_type = 'DEL_BLOB' AND NOT header_corrupted").select("lsn", "shard_id", "blob_id")
    return deletes.join(folded, ["shard_id", "blob_id"], "left").select("lsn", "shard_id", "blob_id", F.lit("OK").alias("status"), F.coalesce(F.col("lsn") == F.col("del_lsn"), F.lit(False)).alias("counted"))


def dispatch(oplog: DataFrame) -> DataFrame:
    return oplog.groupBy("msg_type").agg(F.count("*").alias("n"), F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"))


def after_seal(oplog: DataFrame) -> DataFrame:
    """Puts that come after their shard's first seal, which fail."""
    seals = oplog.where("msg_type = 'SEAL_SHARD'").groupBy("shard_id").agg(F.min("lsn").alias("seal_lsn"))
    return oplog.where("msg_type = 'PUT_BLOB'").join(seals, "shard_id").where("lsn > seal_lsn").select("lsn", "shard_id", "blob_id", F.lit("SEALED_SHARD").alias("status"))


def rolled_back(oplog: DataFrame, lsns: DataFrame) -> DataFrame:
    """The log without the entries that were rolled back."""
    return oplog.join(lsns, "lsn", "left_anti")


def deferred_no_space(errors: DataFrame, committed: DataFrame) -> DataFrame:
    """No-space errors (pg_id, lsn) that may be handled: the entry before them is committed (pg_id, last_lsn)."""
    return errors.join(committed, "pg_id", "left").select("pg_id", "lsn", F.coalesce(F.col("last_lsn") >= F.col("lsn") - 1, F.lit(False)).alias("ready"))


def replay_duplicates(oplog: DataFrame) -> DataFrame:
    """Entries of the log that repeat an earlier entry's type and key."""
    nth = F.row_number().over(Window.partitionBy("msg_type", "shard_id", "blob_id").orderBy("lsn"))
    return oplog.where("msg_type <> 'SEAL_SHARD'").withColumn("nth", nth).where("nth > 1").select("lsn", "msg_type", "shard_id", "blob_id")
