"""Outcomes of writes: validation of requests and the state that a log of commits leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardwise.functions import scalars as S


def put_status(found: Column, state: Column, size: Column) -> Column:
    return F.when(~found, "UNKNOWN_SHARD").when(state != S.OPEN, "SEALED_SHARD").when(size <= 0, "INVALID_ARG").otherwise("OK")


def validate_puts(puts: DataFrame, shard: DataFrame) -> DataFrame:
    """(…, status) of each put (shard_id, blob_id, size)."""
    known = shard.select("shard_id", "state")
    joined = puts.join(known, "shard_id", "left")
    return joined.select("shard_id", "blob_id", "size", put_status(F.col("state").isNotNull(), F.col("state"), F.col("size")).alias("status"))


def create_shard_status(size: Column, meta_bytes: Column, has_group: Column, has_chunk: Column) -> Column:
    return (
        F.when((size <= 0) | (size > S.MAX_SHARD_BYTES) | (meta_bytes > S.MAX_META_BYTES), "INVALID_ARG").when(~has_group, "UNKNOWN_PG").when(~has_chunk, "NO_SPACE_LEFT").otherwise("OK")
    )


def create_group_status(size: Column, chunks_free: Column, has_leader: Column, has_self: Column) -> Column:
    needed = F.floor(size / F.lit(S.CHUNK_BYTES))
    return F.when(~has_leader | ~has_self | (size < S.CHUNK_BYTES), "INVALID_ARG").when(needed > chunks_free, "NO_SPACE_LEFT").otherwise("OK")


def group_creation(pg: DataFrame, member: DataFrame, chunk: DataFrame) -> DataFrame:
    """Whether each group could be created anew: a member of positive priority, and room for its chunks."""
    leaders = member.groupBy("pg_id").agg((F.max("priority") > 0).alias("has_leader"))
    free = chunk.where(F.col("state") == S.AVAILABLE).groupBy("pg_id").agg(F.count("*").alias("free"))
    joined = pg.join(leaders, "pg_id", "left").join(free, "pg_id", "left")
    return joined.select("pg_id", create_group_status(F.col("pg_size"), F.coalesce("free", F.lit(0)), F.coalesce("has_leader", F.lit(False)), F.col("has_leader").isNotNull()).alias("status"))


def shard_creation(requests: DataFrame, pg: DataFrame, chunk: DataFrame) -> DataFrame:
    """(request_id, pg_id, status) of requests (request_id, pg_id, size, meta)."""
    free = chunk.where(F.col("state") == S.AVAILABLE).select("pg_id").distinct().withColumn("free", F.lit(True))
    joined = requests.join(pg.select("pg_id", F.lit(True).alias("known")), "pg_id", "left").join(free, "pg_id", "left")
    return joined.select("request_id", "pg_id", create_shard_status(F.col("size"), F.octet_length("meta"), F.col("known").isNotNull(), F.col("free").isNotNull()).alias("status"))


#: Log positions numbered together by `shard_numbers`.
STRIDE = 1 << 16


def shard_numbers(shard: DataFrame) -> DataFrame:
    """Sequence numbers in order of creation: from 1 in the persistent store, from 0 in memory. Numbers are counted within strides of the log and shifted by the shards before, so no task sees all shards of a group."""
    rows = shard.select("pg_id", "shard_id", "lsn", F.floor(F.col("lsn") / STRIDE).alias("stride"))
    counts = rows.groupBy("pg_id", "stride").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("pg_id").orderBy("stride").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nth = F.row_number().over(Window.partitionBy("pg_id", "stride").orderBy("lsn"))
    number = F.col("before") + nth
    return rows.join(counts.select("pg_id", "stride", before.alias("before")), ["pg_id", "stride"]).select("pg_id", "shard_id", number.alias("persistent_seq"), (number - 1).alias("memory_seq"))


def seal(oplog: DataFrame) -> DataFrame:
    """State of each shard of the log: sealed from its first seal on, however often it is sealed."""
    sealed_at = F.min(F.when(F.col("msg_type") == "SEAL_SHARD", F.col("lsn")))
    return oplog.groupBy("shard_id").agg(sealed_at.alias("seal_lsn")).select("shard_id", "seal_lsn", F.when(F.col("seal_lsn").isNotNull(), S.SEALED).otherwise(S.OPEN).alias("state"))


def shard_commits(shard: DataFrame) -> DataFrame:
    """Blocks that shards' own records occupy: a header each, and a footer once sealed."""
    return shard.groupBy("pg_id").agg(F.count("*").alias("header_blks"), F.count_if(F.col("state") == S.SEALED).alias("footer_blks"))


def put_commits(oplog: DataFrame) -> DataFrame:
    """Result of each committed put: a corrupted header; a first write; or a key that is taken, which is no error if the entry has the same address or is deleted by then."""
    rows = oplog.where("msg_type IN ('PUT_BLOB', 'DEL_BLOB')")
    key, sound = Window.partitionBy("shard_id", "blob_id"), ~F.col("header_corrupted")
    first = F.min(F.when(sound & (F.col("msg_type") == "PUT_BLOB"), F.struct("lsn", "blk_num"))).over(key)
    rows = rows.withColumn("first", first)
    rows = rows.withColumn("del_lsn", F.min(F.when(sound & (F.col("msg_type") == "DEL_BLOB") & (F.col("lsn") > F.col("first.lsn")), F.col("lsn"))).over(key))
    same = (F.col("blk_num") == F.col("first.blk_num")) | F.coalesce(F.col("del_lsn") < F.col("lsn"), F.lit(False))
    existed = sound & (F.col("lsn") > F.col("first.lsn"))
    status = F.when(~sound, "CHECKSUM_MISMATCH").when(existed & ~same, "CONFLICT").otherwise("OK")
    return rows.where("msg_type = 'PUT_BLOB'").select("lsn", "shard_id", "blob_id", status.alias("status"), F.coalesce(existed, F.lit(False)).alias("existed"))


def group_counters(index: DataFrame) -> DataFrame:
    """Counters of each group by its folded index (pg_id, blob_id, blk_count, is_tombstone)."""
    return index.groupBy("pg_id").agg(
        (F.max("blob_id") + 1).alias("blob_sequence_num"), F.count_if(~F.col("is_tombstone")).alias("active_blobs"), F.count_if("is_tombstone").alias("tombstones"), F.sum("blk_count").alias("occupied_blks")
    )


def without_groups(table: DataFrame, destroyed: DataFrame) -> DataFrame:
    """Rows whose group is not among the destroyed ones."""
    return table.join(destroyed, "pg_id", "left_anti")


def group_record(pg: DataFrame, member: DataFrame, chunk: DataFrame) -> DataFrame:
    """A group's stored record: members by id and chunks in virtual order, as JSON."""
    members = member.groupBy("pg_id").agg(F.array_sort(F.collect_list(F.struct(F.col("member_id").alias("id"), "name", "priority"))).alias("members"))
    chunks = chunk.groupBy("pg_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("v_chunk_id", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunk_ids"))
    joined = pg.join(members, "pg_id", "left").join(chunks, "pg_id", "left")
    return joined.select("pg_id", F.to_json(F.struct("pg_id", "pg_size", "members", "chunk_ids")).alias("record"))


def put_records(puts: DataFrame, counters: DataFrame) -> DataFrame:
    """Log records of new puts (pg_id, shard_id, request_id, size): ids follow each group's next number in order of request; with blocks and padding. Numbered within strides of requests, as `shard_numbers`."""
    rows = puts.withColumn("stride", F.floor(F.col("request_id") / STRIDE))
    counts = rows.groupBy("pg_id", "stride").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("pg_id").orderBy("stride").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nth = F.row_number().over(Window.partitionBy("pg_id", "stride").orderBy("request_id"))
    numbered = rows.join(counts.select("pg_id", "stride", before.alias("before")), ["pg_id", "stride"]).join(counters, "pg_id", "left")
    stored = S.round_up(F.col("size") + S.HEADER_BYTES, S.BLOCK_BYTES)
    return numbered.select(
        "pg_id", "shard_id", "request_id", (F.coalesce("blob_sequence_num", F.lit(0)) + F.col("before") + nth - 1).alias("blob_id"), S.blob_blocks(F.col("size")).alias("blk_count"), (stored - S.HEADER_BYTES - F.col("size")).alias("padding")
    )


def delete_records(blob: DataFrame, wanted: DataFrame) -> DataFrame:
    """Log records of deletes: one for each wanted key, whether the blob is there or not."""
    return wanted.join(blob.select("shard_id", "blob_id", "is_tombstone"), ["shard_id", "blob_id"], "left").select("shard_id", "blob_id", F.lit("DEL_BLOB").alias("msg_type"), (~F.coalesce("is_tombstone", F.lit(True))).alias("was_live"))


def parsed_group_records(records: DataFrame, chunk_bytes: int = S.CHUNK_BYTES) -> DataFrame:
    """Group records (pg_id, record, crc) read back from JSON, and whether checksum, size and members are sound."""
    shape = "pg_id int, pg_size bigint, members array<struct<id:string,name:string,priority:int>>, chunk_ids array<bigint>"
    parsed = records.withColumn("r", F.from_json("record", shape))
    sound = (F.crc32(F.col("record").cast("binary")) == F.col("crc")) & (F.col("r.pg_size") >= chunk_bytes) & F.exists("r.members", lambda m: m["priority"] > 0)
    return parsed.select("pg_id", F.size("r.members").alias("members"), F.size("r.chunk_ids").alias("chunks"), F.coalesce(sound, F.lit(False)).alias("sound"))
