"""Chunks: space, ranking and the choice of chunks for groups and shards.

At equal space the lowest id is chosen everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardwise.functions import scalars as S

TOTAL_BLOCKS = 2000


def chunk_table(shard: DataFrame, blob: DataFrame) -> DataFrame:
    """Chunks with a shard, with their space by the blobs in them, and in use while one of their shards is open."""
    use = blob.groupBy("chunk_id").agg(F.sum("blk_count").alias("used_blks"), F.sum(F.when(F.col("is_tombstone"), F.col("blk_count")).otherwise(0)).alias("defrag_blks"))
    owned = shard.groupBy("pg_id", "chunk_id").agg(F.count_if(F.col("state") == S.OPEN).alias("open_shards"))
    used = F.coalesce("used_blks", F.lit(0))
    return owned.join(use, "chunk_id", "left").select(
        "pg_id",
        "chunk_id",
        ((F.col("pg_id") - 1) % 3 + 1).cast("int").alias("pdev_id"),
        (F.row_number().over(Window.partitionBy("pg_id").orderBy("chunk_id")) - 1).cast("long").alias("v_chunk_id"),
        F.lit(TOTAL_BLOCKS).cast("long").alias("total_blks"),
        used.alias("used_blks"),
        F.coalesce("defrag_blks", F.lit(0)).alias("defrag_blks"),
        (F.lit(TOTAL_BLOCKS) - used).alias("available_blks"),
        F.when(F.col("open_shards") > 0, S.IN_USE).otherwise(S.AVAILABLE).alias("state"),
    )


def used_blocks(chunk: DataFrame) -> DataFrame:
    """Used blocks of all chunks that compaction does not hold."""
    return chunk.agg(F.sum(F.when(F.col("state") != S.GC, F.col("used_blks")).otherwise(0)).alias("used_blks"))


def device_space(chunk: DataFrame) -> DataFrame:
    return chunk.groupBy("pdev_id").agg(F.sum("total_blks").alias("total_blks"), F.count("*").alias("chunks"))


def group_space(chunk: DataFrame) -> DataFrame:
    """Available chunks and their blocks by group; open chunks count for neither."""
    free = F.col("state") == S.AVAILABLE
    return chunk.groupBy("pg_id").agg(F.count_if(free).alias("avail_chunks"), F.sum(F.when(free, F.col("available_blks")).otherwise(0)).alias("avail_blks"), F.count("*").alias("total_chunks"))


def most_available_chunks(chunk: DataFrame) -> DataFrame:
    """The number of available chunks of the device that has most."""
    return chunk.where(F.col("state") == S.AVAILABLE).groupBy("pdev_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("most_avail_chunks"))


def chunk_heap(chunk: DataFrame) -> DataFrame:
    """Available chunks of each device by free blocks, most first."""
    by = Window.partitionBy("pdev_id").orderBy(F.desc("available_blks"), "chunk_id")
    return chunk.where(F.col("state") == S.AVAILABLE).select("pdev_id", "chunk_id", "available_blks", F.row_number().over(by).cast("long").alias("rank"))


def chunks_for_group(chunk: DataFrame, wanted: int) -> DataFrame:
    """The `wanted` chunks with most free blocks on the device with most available chunks; none if it has too few."""
    device = chunk.where(F.col("state") == S.AVAILABLE).groupBy("pdev_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pdev_id").limit(1).where(F.col("n") >= wanted)
    return chunk_heap(chunk).join(F.broadcast(device.select("pdev_id")), "pdev_id", "left_semi").where(F.col("rank") <= wanted)


def chunk_for_shard(chunk: DataFrame) -> DataFrame:
    """By group the available chunk with most free blocks; NO_SPACE_LEFT where there is none."""
    free = F.when((F.col("state") == S.AVAILABLE) & (F.col("available_blks") > 0), F.struct(F.col("available_blks"), (-F.col("v_chunk_id")).alias("first")))
    best = chunk.groupBy("pg_id").agg(F.max(free).alias("best"))
    return best.select("pg_id", (-F.col("best.first")).alias("v_chunk_id"), F.col("best.available_blks").alias("available_blks"), F.when(F.col("best").isNull(), "NO_SPACE_LEFT").otherwise("OK").alias("status"))


def select_chunk(chunk: DataFrame, pg_id: int, v_chunk: int) -> DataFrame:
    """One chunk of a group by its place; also taken while open, but not while compaction holds it."""
    return chunk.where((F.col("pg_id") == pg_id) & (F.col("v_chunk_id") == v_chunk) & (F.col("state") != S.GC))


def recovered_states(chunk: DataFrame, shard: DataFrame) -> DataFrame:
    """State of each chunk after a restart: in use where a shard is open, else available."""
    open_chunks = shard.where(F.col("state") == S.OPEN).select("pg_id", "chunk_id").distinct().withColumn("open", F.lit(True))
    return chunk.select("pg_id", "chunk_id").join(open_chunks, ["pg_id", "chunk_id"], "left").select("pg_id", "chunk_id", F.when(F.col("open"), S.IN_USE).otherwise(S.AVAILABLE).alias("state"))


def check_group_chunks(listed: DataFrame, chunk: DataFrame) -> DataFrame:
    """Whether the stored chunk list of each group is sound: all chunks exist, on one device."""
    known = chunk.select("chunk_id", "pdev_id")
    return listed.join(known, "chunk_id", "left").groupBy("pg_id").agg(
        F.count_if(F.col("pdev_id").isNull()).alias("missing"), F.count_distinct("pdev_id").alias("devices"), ((F.count_if(F.col("pdev_id").isNull()) == 0) & (F.count_distinct("pdev_id") == 1)).alias("valid")
    )


def mark_gc(state: Column, forced: Column) -> Column:
    """State after an attempt to hand a chunk to compaction; unchanged if it fails."""
    return F.when(state == S.GC, state).when((state == S.IN_USE) & ~forced, state).otherwise(F.lit(S.GC))


def switch_chunks(chunk: DataFrame, task: DataFrame) -> DataFrame:
    """Chunks of finished compactions with their replacements: the new chunk takes the old one's group and place."""
    done = task.where("succeeded").groupBy("chunk_id").agg(F.max_by("to_chunk_id", "task_id").alias("new_chunk_id"))
    return chunk.join(done, "chunk_id").select("pg_id", "v_chunk_id", F.col("chunk_id").alias("old_chunk_id"), "new_chunk_id", F.when(F.col("state") == S.IN_USE, S.IN_USE).otherwise(S.AVAILABLE).alias("state"))


def released(chunk: DataFrame, pg_id: int) -> DataFrame:
    """A group's chunks after it is destroyed: free and without a group."""
    return chunk.where(F.col("pg_id") == pg_id).select("chunk_id", "pdev_id", F.lit(S.AVAILABLE).alias("state"), F.lit(None).cast("int").alias("pg_id"))
