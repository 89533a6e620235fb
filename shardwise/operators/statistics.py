"""Statistics of groups, shards and the whole service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardwise.functions import scalars as S


def index_counts(blob: DataFrame) -> DataFrame:
    """By group: live and deleted entries, and the blocks of all of them."""
    return blob.groupBy("pg_id").agg(F.count_if(~F.col("is_tombstone")).alias("active_blobs"), F.count_if("is_tombstone").alias("tombstones"), F.sum("blk_count").alias("blob_blks"))


def open_shards(shard: DataFrame) -> DataFrame:
    return shard.groupBy("pg_id").agg(F.count("*").alias("total_shards"), F.count_if(F.col("state") == S.OPEN).alias("open_shards"))


def group_stats(shard: DataFrame, blob: DataFrame) -> DataFrame:
    """Shards, blobs and used bytes by group. Deleted blobs count as used until compaction."""
    joined = open_shards(shard).join(index_counts(blob), "pg_id", "left")
    blocks = F.coalesce("blob_blks", F.lit(0)) + F.col("total_shards") + (F.col("total_shards") - F.col("open_shards"))
    return joined.select("pg_id", "total_shards", "open_shards", F.coalesce("active_blobs", F.lit(0)).alias("active_blobs"), F.coalesce("tombstones", F.lit(0)).alias("tombstones"), (blocks * S.BLOCK_BYTES).alias("used_bytes"))


def service_stats(chunk: DataFrame, shard: DataFrame, chunk_blks: int, reserved: int = 6) -> DataFrame:
    """One row for the service; capacity is less by the chunks that each device reserves for compaction; shards that could still be opened count all chunks but those of open shards."""
    space = chunk.agg(
        ((F.sum("total_blks") - F.count_distinct("pdev_id") * (reserved * chunk_blks)) * S.BLOCK_BYTES).alias("total_bytes"),
        (F.sum(F.when(F.col("state") != S.GC, F.col("used_blks")).otherwise(0)) * S.BLOCK_BYTES).alias("used_bytes"),
        F.count("*").alias("chunks"),
        F.count_distinct("pdev_id").alias("disks"),
        F.lit(1).alias("one"),
    )
    opened = shard.agg(F.count_if(F.col("state") == S.OPEN).alias("open_shards"), F.lit(1).alias("one"))
    return space.join(opened, "one").select("total_bytes", "used_bytes", "open_shards", (F.col("chunks") - F.col("open_shards")).alias("avail_open_shards"), "disks")


def refreshed_counters(blob: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored counters (pg_id, active, tombstones, occupied) next to those of a scan, and whether they need repair."""
    scanned = index_counts(blob)
    return scanned.join(stored, "pg_id", "left").select(
        "pg_id", "active_blobs", "tombstones", "blob_blks", (~(F.col("active").eqNullSafe(F.col("active_blobs")) & F.col("dead").eqNullSafe(F.col("tombstones")) & F.col("occupied").eqNullSafe(F.col("blob_blks")))).alias("repair")
    )


def job_status(task: DataFrame) -> DataFrame:
    """Counts of each compaction job's tasks, and its status: failed if any task failed."""
    counts = task.groupBy("job_id").agg(F.count("*").alias("total"), F.count_if("succeeded").alias("success"), F.count_if(~F.col("succeeded")).alias("failed"))
    return counts.withColumn("status", F.when(F.col("failed") > 0, "FAILED").otherwise("COMPLETED"))


def reclaimed(task: DataFrame) -> DataFrame:
    """Blocks that successful tasks gave back, and their share in thousandths."""
    done = task.where("succeeded")
    return done.groupBy("priority").agg(F.sum(F.col("used_from") - F.col("used_to")).alias("reclaimed_blks"), F.floor(F.sum(F.col("used_from") - F.col("used_to")) * 1000 / F.sum("used_from")).cast("long").alias("per_mille"))


def task_counts(task: DataFrame) -> DataFrame:
    return task.groupBy("priority", "succeeded").agg(F.count("*").alias("tasks"))


def next_sequences(shard: DataFrame, blob: DataFrame) -> DataFrame:
    """The next shard and blob number of each group."""
    shards = shard.groupBy("pg_id").agg((F.max("seq") + 1).alias("next_shard_seq"))
    blobs = blob.groupBy("pg_id").agg((F.max("blob_id") + 1).alias("next_blob_id"))
    return shards.join(blobs, "pg_id", "left").select("pg_id", "next_shard_seq", F.coalesce("next_blob_id", F.lit(0)).alias("next_blob_id"))


def index_size(blob: DataFrame) -> DataFrame:
    """Index nodes and bytes by group, at the fixed fan-outs."""
    leaves, inner = S.index_nodes(F.col("entries"))
    counted = blob.groupBy("pg_id").agg(F.count("*").alias("entries"))
    return counted.select("pg_id", "entries", leaves.alias("leaves"), inner.alias("inner_nodes"), ((leaves + inner) * S.BLOCK_BYTES).alias("bytes"))


def scrub_bound(replica: DataFrame, cap: int, replicas: int = 3) -> DataFrame:
    """Blobs to be scrubbed by shard: the most of any replica, the cap if a replica has none of the shard, at least 1. (A proposed design.)"""
    counts = replica.groupBy("shard_id", "replica").agg(F.count("*").alias("n"))
    return counts.groupBy("shard_id").agg(F.greatest(F.when(F.count("*") < replicas, F.lit(cap)).otherwise(F.max("n")), F.lit(1)).cast("long").alias("bound"))


def histogram(df: DataFrame, value: Column, low: float, high: float, buckets: int) -> DataFrame:
    """Counts in equal buckets; 0 and buckets + 1 hold what lies outside."""
    return df.groupBy(F.width_bucket(value.cast("double"), F.lit(low), F.lit(high), F.lit(buckets)).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def group_gauges(shard: DataFrame, blob: DataFrame, chunk: DataFrame) -> DataFrame:
    """Gauges of each group as they are published: shares in thousandths of deleted blobs, garbage blocks and used space."""
    dead = F.count_if("is_tombstone")
    blobs = blob.groupBy("pg_id").agg(F.floor(dead * 1000 / F.count("*")).alias("deleted_per_mille"))
    space = chunk.groupBy("pg_id").agg(F.floor(F.sum("defrag_blks") * 1000 / F.sum("total_blks")).alias("garbage_per_mille"), F.floor(F.sum("used_blks") * 1000 / F.sum("total_blks")).alias("used_per_mille"))
    return open_shards(shard).join(blobs, "pg_id", "left").join(space, "pg_id", "left").select("pg_id", "open_shards", F.coalesce("deleted_per_mille", F.lit(0)).alias("deleted_per_mille"), "garbage_per_mille", "used_per_mille")


def quorum(stats: DataFrame, members: DataFrame) -> DataFrame:
    """Group statistics next to the least and greatest commit of members that may vote."""
    seen = members.where("can_vote").groupBy("pg_id").agg(F.min("last_commit_lsn").alias("least_lsn"), F.max("last_commit_lsn").alias("greatest_lsn"), F.count("*").alias("voters"))
    return stats.join(seen, "pg_id", "left")
