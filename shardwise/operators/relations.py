"""Joins and set operations of the store: members, quorum, replicas, indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwise.functions import scalars as S


def member_status(member: DataFrame, peer: DataFrame) -> DataFrame:
    """Members with their replication status; without one, lsn 0 and able to vote."""
    joined = member.join(peer, "member_id", "left")
    return joined.select(
        "pg_id", "member_id", "name", F.coalesce("last_commit_lsn", F.lit(0)).alias("last_commit_lsn"), F.coalesce("last_response_us", F.lit(0)).alias("last_response_us"), F.coalesce("can_vote", F.lit(True)).alias("can_vote")
    )


def chunk_entries(chunk: DataFrame, shard: DataFrame, blob: DataFrame) -> DataFrame:
    """Index entries under each chunk's shards."""
    shards = chunk.select("chunk_id", "v_chunk_id").join(shard.select("chunk_id", "shard_id"), "chunk_id")
    return shards.join(blob.select("shard_id", "blob_id", "blk_count", "is_tombstone"), "shard_id").groupBy("chunk_id", "v_chunk_id").agg(
        F.count_distinct("shard_id").alias("shards"), F.count("*").alias("entries"), F.sum(F.when(F.col("is_tombstone"), 0).otherwise(F.col("blk_count"))).alias("live_blks")
    )


def shard_overview(shard: DataFrame, blob: DataFrame, chunk: DataFrame) -> DataFrame:
    """Shards with their chunk's places and blobs; the total count includes deleted ones."""
    counts = blob.groupBy("shard_id").agg(F.count("*").alias("total_blob_count"), F.count_if(~F.col("is_tombstone")).alias("live_blob_count"))
    placed = shard.join(chunk.select("pg_id", "chunk_id", "v_chunk_id"), ["pg_id", "chunk_id"]).join(counts, "shard_id", "left")
    return placed.select("shard_id", "pg_id", "state", "chunk_id", "v_chunk_id", F.coalesce("total_blob_count", F.lit(0)).alias("total_blob_count"), F.coalesce("live_blob_count", F.lit(0)).alias("live_blob_count"))


def index_owners(index_uuid: DataFrame, pg_uuid: DataFrame) -> DataFrame:
    """Index tables found on restart, by the group of their uuid; one without a group is an orphan."""
    return index_uuid.join(pg_uuid, "uuid", "left").select("uuid", "pg_id", F.col("pg_id").isNull().alias("orphan"))


def not_yet_stored(batch: DataFrame, blob: DataFrame) -> DataFrame:
    """Rows of an incoming batch whose key the index does not have."""
    return batch.join(blob.select("shard_id", "blob_id"), ["shard_id", "blob_id"], "left_anti")


def already_stored(batch: DataFrame, blob: DataFrame) -> DataFrame:
    return batch.join(blob.select("shard_id", "blob_id"), ["shard_id", "blob_id"], "left_semi")


def membership_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """Members that left and came, by (pg_id, member_id)."""
    gone = before.join(after, ["pg_id", "member_id"], "left_anti").select("pg_id", "member_id", F.lit("removed").alias("change"))
    new = after.join(before, ["pg_id", "member_id"], "left_anti").select("pg_id", "member_id", F.lit("added").alias("change"))
    return gone.unionByName(new)


def index_difference(copied: DataFrame, indexed: DataFrame) -> DataFrame:
    """Keys on which a copied set and the compaction index differ, in being there or in address."""
    a, b = copied.withColumnRenamed("blk_num", "copied_blk"), indexed.withColumnRenamed("blk_num", "indexed_blk")
    return a.join(b, ["shard_id", "blob_id"], "full").where(~F.col("copied_blk").eqNullSafe(F.col("indexed_blk")))


def replace_index(blob: DataFrame, moved: DataFrame, from_chunk: DataFrame) -> DataFrame:
    """The index after compaction: deleted entries of a moved chunk go, its live ones get their new address, all others stay. `moved` has shard_id, blob_id, new_blk."""
    source = blob.join(from_chunk.select("chunk_id", F.lit(True).alias("compacted")), "chunk_id", "left")
    joined = source.join(moved, ["shard_id", "blob_id"], "left").where(~(F.col("compacted").isNotNull() & F.col("is_tombstone")))
    return joined.select("shard_id", "blob_id", "is_tombstone", F.when(F.col("compacted").isNotNull(), F.coalesce("new_blk", "blk_num")).otherwise(F.col("blk_num")).alias("blk_num"))


def replica_mismatches(replica: DataFrame, replicas: int = 3) -> DataFrame:
    """Blobs that some replica lacks or has with another checksum. (A proposed design.)"""
    seen = replica.groupBy("shard_id", "blob_id").agg(F.count("*").alias("copies"), F.count_distinct("hash").alias("hashes"))
    return seen.where((F.col("copies") < replicas) | (F.col("hashes") > 1)).withColumn("problem", F.when(F.col("copies") < replicas, "missing").otherwise("mismatch"))


def equal_groups(member: DataFrame, other: DataFrame) -> DataFrame:
    """Whether groups have the same members by id and priority; names do not matter."""
    def key(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("pg_id").agg(F.array_sort(F.collect_list(F.struct("member_id", "priority"))).alias(name))

    return key(member, "a").join(key(other, "b"), "pg_id", "full").select("pg_id", F.coalesce(F.col("a").eqNullSafe(F.col("b")), F.lit(False)).alias("equal"))


def replacement(member: DataFrame, pg_id: int, out_id: str, in_id: str) -> DataFrame:
    """Member ids of a group at the start of a replacement, at its completion, and after a removal, as text."""
    now = member.where(F.col("pg_id") == pg_id).groupBy("pg_id").agg(F.collect_set("member_id").alias("m"))
    change = F.array(F.lit(out_id), F.lit(in_id))

    def listed(ids):
        return F.array_join(F.array_sort(ids), ",")

    gone = F.array_except("m", F.array(F.lit(out_id)))
    return now.select("pg_id", listed(F.array_union("m", change)).alias("at_start"), listed(F.array_union(gone, F.array(F.lit(in_id)))).alias("completed"), listed(gone).alias("removed"))


def merged_shards(shard: DataFrame, task: DataFrame) -> DataFrame:
    """Shards of each replacement chunk after compaction: its own and those of the chunk that it replaces."""
    own = shard.select("chunk_id", "shard_id")
    moved = task.where("succeeded").select("chunk_id", "to_chunk_id").distinct().join(own, "chunk_id").select(F.col("to_chunk_id").alias("chunk_id"), "shard_id")
    return own.unionByName(moved).distinct().groupBy("chunk_id").agg(F.count("*").alias("shards"))


def reconciled(actual: DataFrame, known: DataFrame) -> DataFrame:
    """Members by the actual quorum, with name and priority where they are known."""
    return actual.join(known.select("pg_id", "member_id", "name", "priority"), ["pg_id", "member_id"], "left").select("pg_id", "member_id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("priority", F.lit(0)).alias("priority"))


def yield_target(member: DataFrame) -> DataFrame:
    """By group the member of highest positive priority that is not the leader; the least id of equals."""
    fit = member.where("priority > 0 AND NOT is_leader")
    return fit.groupBy("pg_id").agg(F.max("priority").alias("priority"), F.min_by("member_id", F.struct(-F.col("priority"), "member_id")).alias("member_id"))


def groups_alive(chunk: DataFrame, state: DataFrame) -> DataFrame:
    """Chunks whose group may be compacted."""
    return chunk.join(state.where(F.col("state") == S.ALIVE).select("pg_id"), "pg_id", "left_semi")
