"""Compaction: which chunks, in what order, and what each would move."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardwise.functions import scalars as S


def eligible(chunk: DataFrame, threshold: int = 50) -> DataFrame:
    """Chunks at rest with garbage on more than `threshold` percent of their blocks, as of this scan."""
    return chunk.where((F.col("defrag_blks") > 0) & (F.col("state") == S.AVAILABLE) & (F.col("defrag_blks") * 100 > F.col("total_blks") * threshold))


def scan(chunk: DataFrame, threshold: int = 50, reserved: int = 6, emergent: int = 2) -> DataFrame:
    """The tasks that one scan submits: by device at most twice its pool of reserved chunks, in order of chunk id."""
    nth = F.row_number().over(Window.partitionBy("pdev_id").orderBy("chunk_id"))
    return eligible(chunk, threshold).withColumn("nth", nth).where(F.col("nth") <= 2 * (reserved - emergent)).select("pdev_id", "chunk_id", "defrag_blks")


def submit_status(known: Column, defrag: Column, state: Column, priority: Column) -> Column:
    """What submitting one task gives: rejected for an unknown chunk, done at once if there is nothing to do."""
    return (
        F.when(~known, "rejected")
        .when((priority == "normal") & (defrag == 0), "done")
        .when((state == S.GC) | ((state == S.IN_USE) & (priority == "normal")), "rejected")
        .otherwise("queued")
    )


def submissions(task: DataFrame, chunk: DataFrame) -> DataFrame:
    joined = task.join(chunk.select("chunk_id", "defrag_blks", "state"), "chunk_id", "left")
    return joined.select("task_id", "chunk_id", "priority", submit_status(F.col("state").isNotNull(), F.col("defrag_blks"), F.col("state"), F.col("priority")).alias("status"))


def last_shards(shard: DataFrame) -> DataFrame:
    """The last shard of each chunk."""
    return shard.groupBy("chunk_id").agg(F.max("shard_id").alias("last_shard"))


def plan(shard: DataFrame, blob: DataFrame) -> DataFrame:
    """By chunk what compaction copies: live blocks, a header for each shard with live blobs and always for an open last shard, a footer for each of them but an open last shard."""
    last = F.max("shard_id").over(Window.partitionBy("chunk_id"))
    shards = shard.select("chunk_id", "shard_id", "state", (F.col("shard_id") == last).alias("is_last"))
    alive = blob.where(~F.col("is_tombstone")).groupBy("shard_id").agg(F.sum("blk_count").alias("live_blks"), F.count("*").alias("live_blobs"))
    joined = shards.join(alive, "shard_id", "left")
    open_last = F.col("is_last") & (F.col("state") == S.OPEN)
    kept = F.col("live_blobs").isNotNull() | open_last
    return joined.groupBy("chunk_id").agg(
        F.sum(F.coalesce("live_blobs", F.lit(0))).alias("blobs"),
        F.sum(F.coalesce("live_blks", F.lit(0))).alias("live_blks"),
        F.count_if(kept).alias("headers"),
        F.count_if(kept & ~open_last).alias("footers"),
        (F.sum(F.coalesce("live_blks", F.lit(0))) + F.count_if(kept) + F.count_if(kept & ~open_last)).alias("copied_blks"),
    )


def outcome(chunk: DataFrame, planned: DataFrame, threshold: int = 50) -> DataFrame:
    """Blocks of eligible chunks before and after compaction."""
    return eligible(chunk, threshold).join(planned, "chunk_id").select("chunk_id", F.col("used_blks").alias("used_from"), F.col("copied_blks").alias("used_to"), "defrag_blks")


def group_update(task: DataFrame, chunk: DataFrame) -> DataFrame:
    """By group the blocks that its chunks' successful tasks gave back."""
    done = task.where("succeeded").groupBy("chunk_id").agg(F.sum(F.col("used_from") - F.col("used_to")).alias("reclaimed"))
    return chunk.select("pg_id", "chunk_id").join(done, "chunk_id").groupBy("pg_id").agg(F.sum("reclaimed").alias("reclaimed_blks"), F.count("*").alias("chunks"))


def recovered_tasks(task: DataFrame, reserved: DataFrame) -> DataFrame:
    """Tasks to be done again after a restart: those whose replacement chunk is still reserved."""
    return task.join(reserved, F.col("to_chunk_id") == F.col("reserved_chunk"), "left_semi")


def purged(gc_index: DataFrame, chunk_ids: DataFrame) -> DataFrame:
    """The compaction index without the entries of purged chunks."""
    return gc_index.join(chunk_ids, "to_chunk_id", "left_anti")


def triggered(chunk: DataFrame, pg_id: int | None = None, chunk_id: int | None = None) -> DataFrame:
    """Chunks that a manual trigger submits: one, a group's, or all, with garbage."""
    rows = chunk.where("defrag_blks > 0")
    rows = rows if pg_id is None else rows.where(F.col("pg_id") == pg_id)
    return rows if chunk_id is None else rows.where(F.col("chunk_id") == chunk_id)


def latest_jobs(task: DataFrame, keep: int = 100) -> DataFrame:
    """The last jobs, newest first; keeping a fixed number is the feature."""
    return task.groupBy("job_id").agg(F.max("task_id").alias("last_task")).orderBy(F.desc("last_task"), "job_id").limit(keep)
