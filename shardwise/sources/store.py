"""The store's tables, derived from the relational test tables; `TABLES_SQL` is the same derivation in SQL."""

from __future__ import annotations

import tempfile
import uuid
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardwise.functions import scalars as S

#: Blob numbers a shard can have in the derived index.
BLOBS_PER_SHARD = 256

_LINE = ("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def log_of(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("lsn"),
        (F.col("user_id") % 5 + 1).cast("int").alias("pg_id"),
        F.col("user_id").alias("shard_id"),
        (F.col("event_id") % 60).alias("blob_id"),
        F.when(kind.isin("click", "purchase", "view"), "PUT_BLOB").when(kind == "error", "DEL_BLOB").otherwise("SEAL_SHARD").alias("msg_type"),
        (F.col("event_id") % 7 + 2).cast("int").alias("blk_count"),
        (F.col("event_id") % 97 == 0).alias("header_corrupted"),
        (F.col("event_id") % 3).alias("blk_num"),
    )


class Store:
    """Each table is a property and nothing is read before it is used.

    pg, member, shard, blob, chunk, oplog, payload, replica, peer and task follow the store's records: placement groups are
    regions, shards are orders, blobs are order lines (a returned line is a tombstone), chunks are customers, the log is
    the events table, payloads are documents, compaction tasks are parts.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def pg(self) -> DataFrame:
        pg_id = (F.col("r_regionkey") + 1).cast("int")
        return self.read("region").select(pg_id.alias("pg_id"), F.col("r_name").alias("group_name"), (F.lit(5) * S.CHUNK_BYTES).cast("long").alias("pg_size"), F.lit(3).alias("expected_members"))

    @cached_property
    def member(self) -> DataFrame:
        key = F.col("n_nationkey")
        return self.read("nation").select(
            (F.col("n_regionkey") + 1).cast("int").alias("pg_id"),
            F.format_string("%04d0123456789abcdef0123456789ab", key).alias("member_id"),
            F.col("n_name").alias("name"),
            F.when(key % 3 == 0, 1).when(key % 3 == 1, 0).otherwise(-1).alias("priority"),
            (key % 2 == 0).alias("is_leader"),
        )

    @cached_property
    def peer(self) -> DataFrame:
        key = F.col("n_nationkey")
        return (
            self.read("nation")
            .where("n_nationkey % 4 <> 0")
            .select(
                F.format_string("%04d0123456789abcdef0123456789ab", key).alias("member_id"),
                (key * 1000).cast("long").alias("last_commit_lsn"),
                (key * 7000000).cast("long").alias("last_response_us"),
                (key % 5 != 0).alias("can_vote"),
            )
        )

    @cached_property
    def shard(self) -> DataFrame:
        nations, customers = self.read("nation").select("n_nationkey", "n_regionkey"), self.read("customer").select("c_custkey", "c_nationkey")
        owners = customers.join(nations, customers["c_nationkey"] == nations["n_nationkey"]).select("c_custkey", (F.col("n_regionkey") + 1).cast("int").alias("pg_id"))
        return (
            self.read("orders")
            .join(owners, F.col("o_custkey") == F.col("c_custkey"))
            .select(
                S.make_shard_id(F.col("pg_id"), F.col("o_orderkey")).alias("shard_id"),
                "pg_id",
                F.col("o_orderkey").alias("seq"),
                F.col("o_orderkey").alias("lsn"),
                F.when(F.col("o_orderstatus") == "O", S.OPEN).otherwise(S.SEALED).alias("state"),
                F.col("o_custkey").alias("chunk_id"),
                (F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86400000).alias("created_ms"),
                F.col("o_orderpriority").alias("meta"),
            )
        )

    @cached_property
    def blob(self) -> DataFrame:
        number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_LINE)) - 1
        size = (F.col("l_quantity") * 1024).cast("long")
        lines = self.read("lineitem").select(
            "l_orderkey",
            (F.col("l_orderkey") * BLOBS_PER_SHARD + number).alias("blob_id"),
            size.alias("size"),
            S.blob_blocks(size).alias("blk_count"),
            (F.col("l_partkey") * 64 + F.col("l_linenumber")).alias("blk_num"),
            (F.col("l_returnflag") == "R").alias("is_tombstone"),
        )
        shards = self.shard.select("shard_id", "pg_id", "seq", "chunk_id")
        return lines.join(shards, lines["l_orderkey"] == shards["seq"]).select("shard_id", "pg_id", "seq", "chunk_id", "blob_id", "size", "blk_count", "blk_num", "is_tombstone")

    @cached_property
    def chunk(self) -> DataFrame:
        """Chunks with a shard: 2,000 blocks each, used by all blobs, garbage where those are deleted, in use while a shard is open."""
        from shardwise.operators.placement import chunk_table

        return chunk_table(self.shard, self.blob)

    @cached_property
    def oplog(self) -> DataFrame:
        return log_of(self.read("events"))

    @cached_property
    def oplog_stream(self) -> DataFrame:
        """The log as a stream of the same files: those in the table's folder, or the one file that the table is."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/events.parquet")
        stream = self.spark.readStream.schema(self.read("events").schema).option("maxFilesPerTrigger", 1)
        if path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
            return log_of(stream.parquet(f"{self.folder}/events.parquet"))
        return log_of(stream.option("pathGlobFilter", "events.parquet").parquet(self.folder))

    @cached_property
    def payload(self) -> DataFrame:
        return self.read("documents").select((F.col("doc_id") % 40).alias("shard_id"), F.col("doc_id").alias("blob_id"), F.encode("text", "UTF-8").alias("body"), F.col("source").alias("user_key"), (F.col("doc_id") * 4096).alias("object_off"))

    @cached_property
    def replica(self) -> DataFrame:
        """Three copies of the live index; the second lacks some blobs, the third has some bad checksums."""
        live = self.blob.where(~F.col("is_tombstone")).select("shard_id", "blob_id", (F.col("blk_num") * 31 + F.col("size")).alias("hash"))
        copies = live.withColumn("replica", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
        hashed = F.when((F.col("replica") == 2) & (F.col("blob_id") % 211 == 0), F.col("hash") + 1).otherwise(F.col("hash"))
        return copies.where("NOT (replica = 1 AND blob_id % 101 = 0)").select("replica", "shard_id", "blob_id", hashed.alias("hash"))

    @cached_property
    def task(self) -> DataFrame:
        return self.read("part").select(
            F.col("p_partkey").alias("task_id"),
            (F.col("p_partkey") * 7 % 150).alias("chunk_id"),
            (F.col("p_partkey") * 7 % 150 + 1000).alias("to_chunk_id"),
            F.when(F.col("p_size") % 2 == 0, "normal").otherwise("emergent").alias("priority"),
            (F.col("p_size") % 7 != 0).alias("succeeded"),
            (F.col("p_size") * 40).cast("long").alias("used_from"),
            (F.col("p_size") * 25).cast("long").alias("used_to"),
            (F.col("p_partkey") % 150).alias("job_id"),
        )

    def scratch(self) -> str:
        """A new folder in the shared folder of spark.checkpoint.dir; where that is unset, in a temporary one, in local mode alone, as in tests."""
        folder, master = self.spark.conf.get("spark.checkpoint.dir", None), self.spark.sparkContext.master
        if folder is None:
            if master != "local" and not master.startswith("local["):
                raise ValueError("spark.checkpoint.dir is not set; it must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        return f"{folder}/{uuid.uuid4().hex}"


TABLES_SQL = """WITH pg AS (
    SELECT (r_regionkey + 1)::INT AS pg_id, r_name AS group_name, (5 * 2147483648)::BIGINT AS pg_size, 3 AS expected_members FROM region),
member AS (
    SELECT (n_regionkey + 1)::INT AS pg_id, printf('%04d0123456789abcdef0123456789ab', n_nationkey) AS member_id, n_name AS name,
           CASE n_nationkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE -1 END AS priority, n_nationkey % 2 = 0 AS is_leader FROM nation),
peer AS (
    SELECT printf('%04d0123456789abcdef0123456789ab', n_nationkey) AS member_id, (n_nationkey * 1000)::BIGINT AS last_commit_lsn,
           (n_nationkey * 7000000)::BIGINT AS last_response_us, n_nationkey % 5 <> 0 AS can_vote FROM nation WHERE n_nationkey % 4 <> 0),
shard AS (
    SELECT (n_regionkey + 1)::BIGINT * 281474976710656 + o_orderkey AS shard_id, (n_regionkey + 1)::INT AS pg_id, o_orderkey AS seq, o_orderkey AS lsn,
           CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END AS state, o_custkey AS chunk_id,
           date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::BIGINT * 86400000 AS created_ms, o_orderpriority AS meta
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
blob AS (
    SELECT shard_id, pg_id, seq, chunk_id, l_orderkey * 256 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity,
               l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS blob_id,
           (l_quantity * 1024)::BIGINT AS size, (1 + ceil(l_quantity * 1024 / 4096.0))::BIGINT AS blk_count, l_partkey * 64 + l_linenumber AS blk_num, l_returnflag = 'R' AS is_tombstone
    FROM lineitem JOIN shard ON l_orderkey = seq),
chunk_use AS (
    SELECT chunk_id, sum(blk_count)::BIGINT AS used_blks, sum(CASE WHEN is_tombstone THEN blk_count ELSE 0 END)::BIGINT AS defrag_blks FROM blob GROUP BY chunk_id),
chunk AS (
    SELECT s.pg_id, s.chunk_id, ((s.pg_id - 1) % 3 + 1)::INT AS pdev_id, row_number() OVER (PARTITION BY s.pg_id ORDER BY s.chunk_id)::BIGINT - 1 AS v_chunk_id, 2000::BIGINT AS total_blks,
           coalesce(used_blks, 0) AS used_blks, coalesce(defrag_blks, 0) AS defrag_blks, 2000 - coalesce(used_blks, 0) AS available_blks, CASE WHEN open_shards > 0 THEN 1 ELSE 0 END AS state
    FROM (SELECT pg_id, chunk_id, count(*) FILTER (state = 0) AS open_shards FROM shard GROUP BY pg_id, chunk_id) s LEFT JOIN chunk_use USING (chunk_id)),
oplog AS (
    SELECT event_id AS lsn, (user_id % 5 + 1)::INT AS pg_id, user_id AS shard_id, event_id % 60 AS blob_id,
           CASE WHEN event_type IN ('click', 'purchase', 'view') THEN 'PUT_BLOB' WHEN event_type = 'error' THEN 'DEL_BLOB' ELSE 'SEAL_SHARD' END AS msg_type,
           (event_id % 7 + 2)::INT AS blk_count, event_id % 97 = 0 AS header_corrupted, event_id % 3 AS blk_num FROM events),
payload AS (
    SELECT doc_id % 40 AS shard_id, doc_id AS blob_id, encode(text) AS body, source AS user_key, doc_id * 4096 AS object_off FROM documents),
replica AS (
    SELECT r.replica, shard_id, blob_id, blk_num * 31 + size + CASE WHEN r.replica = 2 AND blob_id % 211 = 0 THEN 1 ELSE 0 END AS hash
    FROM blob, (VALUES (0), (1), (2)) r(replica) WHERE NOT is_tombstone AND NOT (r.replica = 1 AND blob_id % 101 = 0)),
task AS (
    SELECT p_partkey AS task_id, p_partkey * 7 % 150 AS chunk_id, p_partkey * 7 % 150 + 1000 AS to_chunk_id, CASE WHEN p_size % 2 = 0 THEN 'normal' ELSE 'emergent' END AS priority,
           p_size % 7 <> 0 AS succeeded, (p_size * 40)::BIGINT AS used_from, (p_size * 25)::BIGINT AS used_to, p_partkey % 150 AS job_id FROM part)
"""
