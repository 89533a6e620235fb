"""Lookups, scans and verified reads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardwise.functions import scalars as S


def lookup(blob: DataFrame, keys: DataFrame) -> DataFrame:
    """(shard_id, blob_id, status, blk_num) of each key: OK with its address, or UNKNOWN_BLOB if absent or deleted."""
    live = blob.where(~F.col("is_tombstone")).select("shard_id", "blob_id", "blk_num")
    return keys.join(live, ["shard_id", "blob_id"], "left").select("shard_id", "blob_id", F.when(F.col("blk_num").isNull(), "UNKNOWN_BLOB").otherwise("OK").alias("status"), "blk_num")


def shard_scan(blob: DataFrame, shard_id: Column, start: int, limit: int | None = None) -> DataFrame:
    """A shard's index entries from a blob id on, in order, deleted ones included."""
    rows = blob.where((F.col("shard_id") == shard_id) & (F.col("blob_id") >= start)).orderBy("blob_id")
    return rows if limit is None else rows.limit(limit)


def range_scan(blob: DataFrame, ranges: DataFrame) -> DataFrame:
    """Entries of the shards from `first` to `last` of each group (pg_id, first, last), deleted ones included."""
    return blob.join(F.broadcast(ranges), "pg_id").where(F.col("shard_id").between(F.col("first"), F.col("last")))  # a row for each group


def live(blob: DataFrame) -> DataFrame:
    return blob.where(~F.col("is_tombstone"))


def sweep(blob: DataFrame) -> DataFrame:
    """Counts of each group's index entries."""
    return blob.groupBy("pg_id").agg(F.count("*").alias("entries"), F.count_if("is_tombstone").alias("tombstones"))


def read_range(payload: DataFrame, requests: DataFrame) -> DataFrame:
    """Answers of ranged reads. `requests` has shard_id, blob_id, off, len; len 0 reads to the end; a range beyond the body is INVALID_ARG.

    The body is cut after its column is read; a partial read (see `partial_read_allowed`) hides key and offset.
    """
    joined = requests.join(payload, ["shard_id", "blob_id"], "left")
    size = F.octet_length("body").cast("long")
    status = F.when(F.col("body").isNull(), "UNKNOWN_BLOB").when(F.col("off") + F.col("len") > size, "INVALID_ARG").otherwise("OK")
    take = F.when(F.col("len") == 0, size - F.col("off")).otherwise(F.col("len")).cast("int")
    partial = F.coalesce(partial_read_allowed(F.col("skip_verify"), F.col("off"), F.col("len"), stored_bytes(size)), F.lit(False))
    ok = F.col("status") == "OK"
    return joined.withColumn("status", status).select(
        "shard_id",
        "blob_id",
        "status",
        F.when(ok, F.col("body").substr((F.col("off") + 1).cast("int"), take)).alias("body"),
        F.when(ok & ~partial, F.col("user_key")).alias("user_key"),
        F.when(ok, F.when(partial, F.lit(0)).otherwise(F.col("object_off"))).alias("object_off"),
        (ok & partial).alias("partial"),
    )


def stored_bytes(size: Column) -> Column:
    """Bytes on disk of a body: header, body, padding to a block."""
    return S.round_up(size + S.HEADER_BYTES, S.BLOCK_BYTES)


def partial_read_allowed(skip: Column, off: Column, length: Column, stored: Column) -> Column:
    return skip & (length > 0) & ((off >= S.BLOCK_BYTES) | (off + length + S.BLOCK_BYTES <= stored - S.HEADER_BYTES))


def shards_of(shard: DataFrame, pg_id: int) -> DataFrame:
    return shard.where(F.col("pg_id") == pg_id)


def shard_by_id(shard: DataFrame, ids: DataFrame) -> DataFrame:
    """Each id's shard, or UNKNOWN_SHARD."""
    known = shard.select("shard_id", "pg_id", "state", "lsn")
    return ids.join(known, "shard_id", "left").withColumn("status", F.when(F.col("pg_id").isNull(), "UNKNOWN_SHARD").otherwise("OK"))


def group_chunks(chunk: DataFrame) -> DataFrame:
    """Each group's physical chunks in virtual order, as text."""
    ordered = F.array_sort(F.collect_list(F.struct("v_chunk_id", "chunk_id")))
    return chunk.groupBy("pg_id").agg(F.array_join(F.transform(ordered, lambda x: x["chunk_id"].cast("string")), ",").alias("chunks"))


def device_chunks(chunk: DataFrame) -> DataFrame:
    return chunk.groupBy("pdev_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("chunk_id")), lambda x: x.cast("string")), ",").alias("chunks"))


def chunk_dump(chunk: DataFrame) -> DataFrame:
    """Chunks of each group as JSON, in virtual order."""
    fields = F.struct("v_chunk_id", "available_blks", "state", F.col("chunk_id").alias("p_chunk_id"))
    return chunk.groupBy("pg_id").agg(F.to_json(F.array_sort(F.collect_list(fields))).alias("chunks"))


def recovered_groups(pg: DataFrame, listed: DataFrame, chunk: DataFrame) -> DataFrame:
    """Group states after a restart: the disk-down bit where a listed chunk is missing."""
    missing = listed.join(chunk.select("chunk_id"), "chunk_id", "left_anti").groupBy("pg_id").agg(F.count("*").alias("missing"))
    return pg.select("pg_id").join(missing, "pg_id", "left").select("pg_id", F.coalesce("missing", F.lit(0)).alias("missing"), F.when(F.col("missing") > 0, S.DISK_DOWN).otherwise(S.ALIVE).alias("state"))


def read_any_version(parts: list[DataFrame]) -> DataFrame:
    """Shard records of both versions: the first has no meta, which reads as empty."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return merged.withColumn("meta", F.coalesce("meta", F.lit("")))


def fetch_for_replica(wanted: DataFrame, local: DataFrame, blob: DataFrame) -> DataFrame:
    """What a replica is sent for each wanted key: the local block if it verifies, else the indexed one, else a delete marker."""
    own = local.where("verified").select("shard_id", "blob_id", F.col("blk_num").alias("local_blk"))
    indexed = live(blob).select("shard_id", "blob_id", F.col("blk_num").alias("index_blk"))
    joined = wanted.join(own, ["shard_id", "blob_id"], "left").join(indexed, ["shard_id", "blob_id"], "left")
    source = F.when(F.col("local_blk").isNotNull(), "local").when(F.col("index_blk").isNotNull(), "index").otherwise("delete_marker")
    return joined.select("shard_id", "blob_id", source.alias("source"), F.coalesce("local_blk", "index_blk").alias("blk_num"))


def gc_index_prefix(chunk: DataFrame, blob: DataFrame, task: DataFrame) -> DataFrame:
    """Entries of the compaction index of the latest successful task by chunk: live blobs under their new chunk."""
    by = Window.partitionBy("chunk_id").orderBy(F.desc("task_id"))
    latest = task.where("succeeded").withColumn("nth", F.row_number().over(by)).where("nth = 1").select("chunk_id", "to_chunk_id")
    return live(blob).join(latest, "chunk_id").select("to_chunk_id", "shard_id", "blob_id", "blk_num")
