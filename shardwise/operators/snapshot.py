"""Resumable export of a group's shards and blobs, and its import."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardwise.functions import scalars as S


def snapshot_cuts(shard: DataFrame) -> DataFrame:
    """(pg_id, upto): the log position of each group's snapshot, right before its last open shard, or its last shard if none is open."""
    return shard.groupBy("pg_id").agg(F.coalesce(F.max(F.when(F.col("state") == S.OPEN, F.col("lsn"))) - 1, F.max("lsn")).alias("upto"))


def exported_shards(shard: DataFrame, places: DataFrame, cuts: DataFrame) -> DataFrame:
    """Shards of each group up to its log position (none at 0), numbered by virtual chunk (`places`: pg_id, chunk_id, v_chunk_id), then lsn: within the chunk, after the number of shards in earlier chunks, so only one row a chunk is ever in one task."""
    rows = shard.join(F.broadcast(cuts), "pg_id").where((F.col("lsn") <= F.col("upto")) & (F.col("upto") != 0))  # a row for each group
    rows = rows.join(places.select("pg_id", "chunk_id", "v_chunk_id"), ["pg_id", "chunk_id"]).select("pg_id", "shard_id", "v_chunk_id", "lsn")
    counts = rows.groupBy("pg_id", "v_chunk_id").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("pg_id").orderBy("v_chunk_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nth = F.row_number().over(Window.partitionBy("pg_id", "v_chunk_id").orderBy("lsn"))
    return rows.join(counts.select("pg_id", "v_chunk_id", before.alias("before")), ["pg_id", "v_chunk_id"]).select("pg_id", "shard_id", "v_chunk_id", "lsn", (F.col("before") + nth).alias("position"))


def read_order(blob: DataFrame) -> DataFrame:
    """Rows for reading: each task's in order of address."""
    return blob.sortWithinPartitions("chunk_id", "blk_num")


def batches(blob: DataFrame, max_bytes: int) -> DataFrame:
    """(shard_id, blob_id, size, batch): a shard's blobs in order, cut after the blob that makes a batch reach max_bytes. The cut depends on the running total since the last one, so each shard is walked once; a shard holds at most 1 GiB."""

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, batch, total = None, 0, 0
        for rows in parts:
            out = []
            for s, size in zip(rows["shard_id"], rows["size"], strict=True):
                if s != shard:
                    shard, batch, total = s, 0, 0
                out.append(batch)
                total += size
                if total >= max_bytes:
                    batch, total = batch + 1, 0
            yield rows.assign(batch=out)

    dealt = blob.select("shard_id", "blob_id", "size").repartition(F.col("shard_id")).sortWithinPartitions("shard_id", "blob_id")
    return dealt.mapInPandas(cut, "shard_id bigint, blob_id bigint, size bigint, batch bigint")


def export_batches(blob: DataFrame, max_bytes: int) -> DataFrame:
    """Batches of live blobs by shard, with their message numbers (from 1) and whether they are the last."""
    cut = batches(blob.where(~F.col("is_tombstone")), max_bytes)
    grouped = cut.groupBy("shard_id", "batch").agg(F.count("*").alias("blobs"), F.sum("size").alias("bytes"))
    last = F.max("batch").over(Window.partitionBy("shard_id"))
    return grouped.select("shard_id", (F.col("batch") + 1).alias("batch_id"), "blobs", "bytes", (F.col("batch") == last).alias("is_last_batch"))


def bins(df: DataFrame, group: str, item: str, size: str, capacity: int) -> DataFrame:
    """(group, item, size, bin): next-fit packing in order of items; an item over the capacity gets a bin of its own. (A proposed design.)"""

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, number, total = None, -1, 0
        for rows in parts:
            out = []
            for g, s in zip(rows["group"], rows["size"], strict=True):
                if g != now:
                    now, number, total = g, -1, capacity + 1
                if total + s > capacity:
                    number, total = number + 1, 0
                total = capacity + 1 if s > capacity else total + s
                out.append(number)
            yield rows.assign(bin=out)

    rows = df.select(F.col(group).cast("long").alias("group"), F.col(item).cast("long").alias("item"), F.col(size).cast("long").alias("size"))
    return rows.repartition(F.col("group")).sortWithinPartitions("group", "item").mapInPandas(pack, "group bigint, item bigint, size bigint, bin bigint")


def cursor_valid(now_seq: Column, now_batch: Column, next_seq: Column, seq: Column, batch: Column) -> Column:
    """Whether a message (seq, batch) may follow the cursor: the group's, always; the next shard's first; or of the current shard the first, the current or the next batch. Without a cursor (null) only the group's."""
    same = (seq == now_seq) & ((batch == 0) | (batch == now_batch) | (batch == now_batch + 1))
    return (seq == 0) | F.coalesce(now_seq.isNotNull() & (((seq == next_seq) & (batch == 0)) | same), F.lit(False))


def progress(received: DataFrame) -> DataFrame:
    """Totals by shard of received batches (shard_id, batch_id, attempt, blobs, bytes, corrupted); of a repeated batch the last attempt counts."""
    last = received.groupBy("shard_id", "batch_id").agg(*(F.max_by(c, "attempt").alias(c) for c in ("blobs", "bytes", "corrupted")))
    return last.groupBy("shard_id").agg(F.count("*").alias("batches"), F.sum("blobs").alias("blobs"), F.sum("bytes").alias("bytes"), F.sum("corrupted").alias("corrupted"))


def complete_percent(done: Column, total: Column) -> Column:
    return S.percent(done, total)


def group_meta(shard: DataFrame, blob: DataFrame) -> DataFrame:
    """The first message of each group's export: sequences, live blobs and occupied bytes."""
    blobs = blob.groupBy("pg_id").agg((F.max("blob_id") + 1).alias("blob_seq_num"), F.count_if(~F.col("is_tombstone")).alias("total_blobs"), (F.sum("blk_count") * S.BLOCK_BYTES).alias("total_bytes"))
    shards = shard.groupBy("pg_id").agg((F.max("seq") + 1).alias("shard_seq_num"), F.count("*").alias("shards"))
    return shards.join(blobs, "pg_id", "left")


def resume(exported: DataFrame, finished: DataFrame) -> DataFrame:
    """Shards still to be sent after an interruption: those not recorded as finished."""
    return exported.join(finished, "shard_id", "left_anti")


def messages(exported: DataFrame, batched: DataFrame) -> DataFrame:
    """All messages of each group's export in order: the group's first, then each shard's record and batches. `kind` tells them apart; the id of a message is that of its shard's position and batch."""
    zero = F.lit(0).cast("long")
    first = exported.select("pg_id").distinct().select("pg_id", zero.alias("position"), zero.alias("batch_id"), F.lit("group").alias("kind"))
    records = exported.select("pg_id", "position", zero.alias("batch_id"), F.lit("shard").alias("kind"))
    parts = exported.join(batched, "shard_id").select("pg_id", "position", "batch_id", F.lit("blobs").alias("kind"))
    return first.unionByName(records).unionByName(parts).withColumn("message_id", S.object_id(F.col("position"), F.col("batch_id")).cast("string"))


def prefetch_state(verified: Column) -> Column:
    """State under which a blob is sent: one that does not verify, or is a delete marker, is sent as corrupted."""
    return F.when(F.coalesce(verified, F.lit(False)), "NORMAL").otherwise("CORRUPTED")


def receive(rows: DataFrame) -> DataFrame:
    """Outcome of received batches (shard_id, batch_id, state, sound): a normal blob that does not verify fails its batch, corrupted ones are kept and counted."""
    return rows.groupBy("shard_id", "batch_id").agg(
        F.count("*").alias("blobs"), F.count_if(F.col("state") == "CORRUPTED").alias("corrupted"), F.when(F.count_if((F.col("state") == "NORMAL") & ~F.col("sound")) > 0, "FAILED").otherwise("OK").alias("status")
    )
