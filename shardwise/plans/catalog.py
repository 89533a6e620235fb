"""All queries of the store's own operators, by name, with their DuckDB counterparts.

A query's name begins with the row of the operator inventory it covers. SQL texts use the tables of `sources.store.TABLES_SQL`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardwise.functions import scalars as S
from shardwise.operators import compaction, integrity, oplog, placement, reads, relations, snapshot, statistics, writes
from shardwise.sources.store import TABLES_SQL, Store
from shardwise.streaming.fold import fold_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None, make: Callable[[Store], DataFrame]) -> None:
    QUERIES[name] = lambda spark, folder: make(Store(spark, folder))
    if sql is not None:
        ORACLES[name] = f"{TABLES_SQL}\n{sql}" if not sql.startswith(",") else f"{TABLES_SQL}{sql}"


_EXPORTED = """, exported AS (
    SELECT shard.pg_id, shard_id, v_chunk_id, lsn, row_number() OVER (PARTITION BY shard.pg_id ORDER BY v_chunk_id, lsn)::BIGINT AS position
    FROM shard JOIN (SELECT pg_id, coalesce(max(CASE WHEN state = 0 THEN lsn END) - 1, max(lsn)) AS upto FROM shard GROUP BY pg_id) c ON c.pg_id = shard.pg_id AND lsn <= upto AND upto <> 0
    JOIN chunk ON chunk.pg_id = shard.pg_id AND chunk.chunk_id = shard.chunk_id)"""


def _exported(s: Store) -> DataFrame:
    return snapshot.exported_shards(s.shard, s.chunk, snapshot.snapshot_cuts(s.shard))


# --- Reads and scans ---


def _requests(s: Store) -> DataFrame:
    ids = s.read("documents").select((F.col("doc_id") % 40).alias("shard_id"), F.col("doc_id").alias("blob_id"), "n_chars")
    off = F.col("blob_id") % 50
    return ids.select("shard_id", "blob_id", off.alias("off"), F.when(F.col("blob_id") % 3 == 0, 0).when(F.col("blob_id") % 3 == 1, 20).otherwise(1 << 20).cast("long").alias("len"), (F.col("blob_id") % 2 == 0).alias("skip_verify"))


_REQUESTS_SQL = """, request AS (
    SELECT doc_id % 40 AS shard_id, doc_id AS blob_id, doc_id % 50 AS off, CASE WHEN doc_id % 3 = 0 THEN 0 WHEN doc_id % 3 = 1 THEN 20 ELSE 1048576 END::BIGINT AS len, doc_id % 2 = 0 AS skip_verify FROM documents),
answer AS (
    SELECT r.*, octet_length(p.body)::BIGINT AS size, p.body, p.user_key, p.object_off,
           CASE WHEN p.body IS NULL THEN 'UNKNOWN_BLOB' WHEN off + len > octet_length(p.body) THEN 'INVALID_ARG' ELSE 'OK' END AS status,
           skip_verify AND len > 0 AND (off >= 4096 OR off + len + 4096 <= ((octet_length(p.body) + 4096 + 4095) // 4096) * 4096 - 4096) AS partial
    FROM request r LEFT JOIN payload p USING (shard_id, blob_id))"""


def _read_answers(s: Store) -> DataFrame:
    got = reads.read_range(s.payload, _requests(s))
    return got.select("shard_id", "blob_id", "status", F.octet_length("body").cast("long").alias("n_bytes"), F.sha2("body", 256).alias("sha256"), "user_key", "object_off", "partial")


query(
    "a1_blob_get",
    _REQUESTS_SQL
    + """ SELECT shard_id, blob_id, status, CASE WHEN status = 'OK' THEN octet_length(part)::BIGINT END AS n_bytes, CASE WHEN status = 'OK' THEN sha256(part) END AS sha256,
           CASE WHEN status = 'OK' AND NOT partial THEN user_key END AS user_key, CASE WHEN status = 'OK' THEN CASE WHEN partial THEN 0 ELSE object_off END END AS object_off, status = 'OK' AND partial AS partial
    FROM (SELECT *, unhex(substr(hex(body), 2 * off::INT + 1, 2 * (CASE WHEN len = 0 THEN size - off ELSE len END)::INT)) AS part FROM answer)""",
    _read_answers,
)
query("a4_point_lookup", """SELECT s.shard_id, s.seq * 256 AS blob_id, CASE WHEN b.blk_num IS NULL THEN 'UNKNOWN_BLOB' ELSE 'OK' END AS status, b.blk_num
    FROM shard s LEFT JOIN (SELECT * FROM blob WHERE NOT is_tombstone) b ON b.shard_id = s.shard_id AND b.blob_id = s.seq * 256""",
    lambda s: reads.lookup(s.blob, s.shard.select("shard_id", (F.col("seq") * 256).alias("blob_id"))))
query("a7_partial_read_rule", _REQUESTS_SQL + " SELECT shard_id, blob_id, partial FROM answer",
    lambda s: _requests(s).join(s.payload, ["shard_id", "blob_id"], "left").select("shard_id", "blob_id", reads.partial_read_allowed(F.col("skip_verify"), F.col("off"), F.col("len"), reads.stored_bytes(F.octet_length("body").cast("long"))).alias("partial")))
query("a8_shard_range_scan", """SELECT shard_id, blob_id, blk_num, is_tombstone FROM blob JOIN (SELECT pg_id, min(seq) AS lo, (min(seq) + max(seq)) // 2 AS hi FROM shard GROUP BY pg_id) r USING (pg_id) WHERE seq BETWEEN lo AND hi""",
    lambda s: reads.range_scan(s.blob, s.shard.groupBy("pg_id").agg(F.min("shard_id").alias("first"), (F.min("shard_id") + F.floor((F.max("seq") - F.min("seq")) / 2)).alias("last"))).select("shard_id", "blob_id", "blk_num", "is_tombstone"))
query("a8_first_entries", "SELECT blob_id, blk_num, is_tombstone FROM blob WHERE shard_id = (SELECT min(shard_id) FROM blob) ORDER BY blob_id LIMIT 3",
    lambda s: reads.shard_scan(s.blob.join(s.blob.agg(F.min("shard_id").alias("least")), F.col("shard_id") == F.col("least"), "left_semi"), F.col("shard_id"), 0, 3).select("blob_id", "blk_num", "is_tombstone"))
query("a9_shard_blobs", "SELECT shard_id, count(*) AS entries, min(blob_id) AS first_blob, max(blob_id) AS last_blob FROM blob GROUP BY shard_id",
    lambda s: s.blob.groupBy("shard_id").agg(F.count("*").alias("entries"), F.min("blob_id").alias("first_blob"), F.max("blob_id").alias("last_blob")))
query("a10_group_sweep", "SELECT pg_id, count(*) AS entries, count(*) FILTER (is_tombstone) AS tombstones FROM blob GROUP BY pg_id", lambda s: reads.sweep(s.blob))
query("a11_live_index", "SELECT shard_id, blob_id, blk_num FROM blob WHERE NOT is_tombstone", lambda s: reads.live(s.blob).select("shard_id", "blob_id", "blk_num"))
query("a12_gc_index_prefix", """, latest AS (SELECT chunk_id, arg_max(to_chunk_id, task_id) AS to_chunk_id FROM task WHERE succeeded GROUP BY chunk_id)
    SELECT to_chunk_id, shard_id, blob_id, blk_num FROM blob JOIN latest USING (chunk_id) WHERE NOT is_tombstone""", lambda s: reads.gc_index_prefix(s.chunk, s.blob, s.task))
query("a13_list_shards", "SELECT pg_id, shard_id, state, lsn, created_ms, meta FROM shard", lambda s: s.shard.select("pg_id", "shard_id", "state", "lsn", "created_ms", "meta"))
query("a14_get_shard", """, ids AS (SELECT (l_suppkey % 5 + 1) * 281474976710656 + l_orderkey AS shard_id FROM lineitem GROUP BY 1)
    SELECT shard_id, pg_id, state, lsn, CASE WHEN pg_id IS NULL THEN 'UNKNOWN_SHARD' ELSE 'OK' END AS status FROM ids LEFT JOIN shard USING (shard_id)""",
    lambda s: reads.shard_by_id(s.shard, s.read("lineitem").select(S.make_shard_id(F.col("l_suppkey") % 5 + 1, F.col("l_orderkey")).alias("shard_id")).distinct()))
query("a15_list_groups", "SELECT pg_id, group_name FROM pg", lambda s: s.pg.select("pg_id", "group_name"))
query("a16_group_by_uuid", "SELECT pg_id, md5(group_name) AS uuid FROM pg WHERE md5(group_name) >= '8'", lambda s: s.pg.select("pg_id", F.md5("group_name").alias("uuid")).where("uuid >= '8'"))
query("a17_shards_in_vchunk", "SELECT pg_id, v_chunk_id, s.shard_id, s.state FROM shard s JOIN chunk c USING (pg_id, chunk_id)",
    lambda s: s.shard.join(s.chunk.select("pg_id", "chunk_id", "v_chunk_id"), ["pg_id", "chunk_id"]).select("pg_id", "v_chunk_id", "shard_id", s.shard["state"]))
query("a18_shards_in_pchunk", "SELECT chunk_id, count(*) AS shards, min(shard_id) AS first_shard, max(shard_id) AS last_shard FROM shard GROUP BY chunk_id",
    lambda s: s.shard.groupBy("chunk_id").agg(F.count("*").alias("shards"), F.min("shard_id").alias("first_shard"), F.max("shard_id").alias("last_shard")))
query("a19_shard_places", "SELECT shard_id, chunk_id, v_chunk_id FROM shard JOIN chunk USING (pg_id, chunk_id)", lambda s: s.shard.join(s.chunk, ["pg_id", "chunk_id"]).select("shard_id", "chunk_id", "v_chunk_id"))
query("a20_group_chunks", "SELECT pg_id, string_agg(chunk_id::VARCHAR, ',' ORDER BY v_chunk_id) AS chunks FROM chunk GROUP BY pg_id", lambda s: reads.group_chunks(s.chunk))
query("a21_device_chunks", "SELECT pdev_id, string_agg(chunk_id::VARCHAR, ',' ORDER BY chunk_id) AS chunks FROM chunk GROUP BY pdev_id", lambda s: reads.device_chunks(s.chunk))
query("a22_each_chunk", "SELECT chunk_id, available_blks * 100 // total_blks AS free_percent FROM chunk", lambda s: s.chunk.select("chunk_id", F.floor(F.col("available_blks") * 100 / F.col("total_blks")).alias("free_percent")))
query("a23_chunk_dump", """SELECT pg_id, '[' || string_agg('{"v_chunk_id":' || v_chunk_id || ',"available_blks":' || available_blks || ',"state":' || state || ',"p_chunk_id":' || chunk_id || '}', ',' ORDER BY v_chunk_id) || ']' AS chunks
    FROM chunk GROUP BY pg_id""", lambda s: reads.chunk_dump(s.chunk))
query("a24_metadata_recovery", "SELECT 'pg' AS kind, count(*) AS records FROM pg UNION ALL SELECT 'shard', count(*) FROM shard UNION ALL SELECT 'task', count(*) FROM task",
    lambda s: s.pg.agg(F.lit("pg").alias("kind"), F.count("*").alias("records")).unionByName(s.shard.agg(F.lit("shard").alias("kind"), F.count("*").alias("records"))).unionByName(s.task.agg(F.lit("task").alias("kind"), F.count("*").alias("records"))))
query("a25_group_recovery", """SELECT pg.pg_id, count(l.chunk_id) AS missing, CASE WHEN count(l.chunk_id) > 0 THEN 1 ELSE 0 END AS state
    FROM pg LEFT JOIN (SELECT pg_id, chunk_id FROM chunk WHERE chunk_id % 1000 = 7) l USING (pg_id) GROUP BY pg.pg_id""",
    lambda s: reads.recovered_groups(s.pg, s.chunk.select("pg_id", "chunk_id"), s.chunk.where("chunk_id % 1000 <> 7")))
query("a26_shard_versions", "SELECT shard_id, state, CASE WHEN seq % 2 = 0 THEN '' ELSE meta END AS meta FROM shard",
    lambda s: reads.read_any_version([s.shard.where("seq % 2 = 1").select("shard_id", "state", "meta"), s.shard.where("seq % 2 = 0").select("shard_id", "state")]))
query("a27_fetch_for_replica", """, local AS (SELECT shard_id, blob_id, blk_num FROM blob WHERE blob_id % 3 = 0)
    SELECT b.shard_id, b.blob_id, CASE WHEN l.blk_num IS NOT NULL THEN 'local' WHEN NOT b.is_tombstone THEN 'index' ELSE 'delete_marker' END AS source, coalesce(l.blk_num, CASE WHEN NOT b.is_tombstone THEN b.blk_num END) AS blk_num
    FROM blob b LEFT JOIN local l USING (shard_id, blob_id)""",
    lambda s: reads.fetch_for_replica(s.blob.select("shard_id", "blob_id"), s.blob.select("shard_id", "blob_id", "blk_num", (F.col("blob_id") % 3 == 0).alias("verified")), s.blob))
query("a28_device_list", "SELECT s_suppkey, '/dev/sd' || s_suppkey AS path, CASE s_suppkey % 3 WHEN 0 THEN 'HDD' WHEN 1 THEN 'NVME' ELSE 'AUTO' END AS kind FROM supplier",
    lambda s: s.read("supplier").select("s_suppkey", *(c.alias(n) for c, n in zip(S.device(F.concat(F.lit("/dev/sd"), "s_suppkey", F.element_at(F.array(F.lit(":hdd"), F.lit(":NVME"), F.lit(":tape")), (F.col("s_suppkey") % 3 + 1).cast("int")))), ("path", "kind"), strict=True))))
query("a29_live_count", "SELECT pg_id, count(*) AS live FROM blob WHERE NOT is_tombstone GROUP BY pg_id", lambda s: reads.live(s.blob).groupBy("pg_id").agg(F.count("*").alias("live")))
query("a30_chunk_by_place", "SELECT pg_id, v_chunk_id, chunk_id, state, available_blks FROM chunk", lambda s: s.chunk.select("pg_id", "v_chunk_id", "chunk_id", "state", "available_blks"))
query("a31_check_group_chunks", """SELECT l.pg_id, count(*) FILTER (c.pdev_id IS NULL) AS missing, count(DISTINCT c.pdev_id) AS devices, count(*) FILTER (c.pdev_id IS NULL) = 0 AND count(DISTINCT c.pdev_id) = 1 AS valid
    FROM chunk l LEFT JOIN (SELECT chunk_id, CASE WHEN chunk_id % 400 = 5 THEN 9 ELSE pdev_id END AS pdev_id FROM chunk WHERE chunk_id % 500 <> 3) c USING (chunk_id) GROUP BY l.pg_id""",
    lambda s: placement.check_group_chunks(s.chunk.select("pg_id", "chunk_id"), s.chunk.where("chunk_id % 500 <> 3").select("chunk_id", F.when(F.col("chunk_id") % 400 == 5, 9).otherwise(F.col("pdev_id")).alias("pdev_id"))))

# --- Writes ---
query("b1_put_validation", """, puts AS (SELECT (l_suppkey % 5 + 1) * 281474976710656 + l_orderkey AS shard_id, l_partkey AS blob_id, CASE WHEN l_linenumber = 7 THEN 0 ELSE l_quantity END::BIGINT AS size FROM lineitem)
    SELECT shard_id, blob_id, size, CASE WHEN state IS NULL THEN 'UNKNOWN_SHARD' WHEN state <> 0 THEN 'SEALED_SHARD' WHEN size <= 0 THEN 'INVALID_ARG' ELSE 'OK' END AS status FROM puts LEFT JOIN shard USING (shard_id)""",
    lambda s: writes.validate_puts(s.read("lineitem").select(S.make_shard_id(F.col("l_suppkey") % 5 + 1, F.col("l_orderkey")).alias("shard_id"), F.col("l_partkey").alias("blob_id"), F.when(F.col("l_linenumber") == 7, 0).otherwise(F.col("l_quantity")).cast("long").alias("size")), s.shard))
_FOLD = """, sound AS (SELECT * FROM oplog WHERE NOT header_corrupted),
put AS (SELECT shard_id, blob_id, min(lsn) AS put_lsn, arg_min(blk_count, lsn) AS blk_count, arg_min(pg_id, lsn) AS pg_id FROM sound WHERE msg_type = 'PUT_BLOB' GROUP BY shard_id, blob_id),
del AS (SELECT p.shard_id, p.blob_id, min(d.lsn) AS del_lsn FROM put p JOIN sound d ON d.shard_id = p.shard_id AND d.blob_id = p.blob_id AND d.msg_type = 'DEL_BLOB' AND d.lsn > p.put_lsn GROUP BY p.shard_id, p.blob_id),
folded AS (SELECT shard_id, blob_id, pg_id, put_lsn, del_lsn, blk_count, del_lsn IS NOT NULL AS is_tombstone FROM put LEFT JOIN del USING (shard_id, blob_id))"""
query("b3_put_commits", _FOLD + """, address AS (SELECT shard_id, blob_id, arg_min(blk_num, lsn) AS first_blk FROM sound WHERE msg_type = 'PUT_BLOB' GROUP BY shard_id, blob_id)
    SELECT o.lsn, o.shard_id, o.blob_id, NOT header_corrupted AND coalesce(o.lsn > f.put_lsn, false) AS existed,
           CASE WHEN header_corrupted THEN 'CHECKSUM_MISMATCH' WHEN o.lsn = f.put_lsn OR o.blk_num = a.first_blk OR f.del_lsn < o.lsn THEN 'OK' ELSE 'CONFLICT' END AS status
    FROM oplog o LEFT JOIN folded f USING (shard_id, blob_id) LEFT JOIN address a USING (shard_id, blob_id) WHERE o.msg_type = 'PUT_BLOB'""", lambda s: writes.put_commits(s.oplog))
query("b5_group_counters", _FOLD + " SELECT pg_id, max(blob_id) + 1 AS blob_sequence_num, count(*) FILTER (NOT is_tombstone) AS active_blobs, count(*) FILTER (is_tombstone) AS tombstones, sum(blk_count)::BIGINT AS occupied_blks FROM folded GROUP BY pg_id",
    lambda s: writes.group_counters(oplog.fold_index(s.oplog)))
query("b8_delete_outcomes", _FOLD + " SELECT o.lsn, o.shard_id, o.blob_id, 'OK' AS status, coalesce(o.lsn = f.del_lsn, false) AS counted FROM sound o LEFT JOIN folded f USING (shard_id, blob_id) WHERE o.msg_type = 'DEL_BLOB'",
    lambda s: oplog.delete_outcomes(s.oplog))
query("b10_shard_creation", """, req AS (SELECT p_partkey AS request_id, (p_size % 7)::INT AS pg_id, CASE WHEN p_size % 11 = 0 THEN 0 ELSE p_size * 30000000 END::BIGINT AS size, repeat('x', (p_size * 25)::INT) AS meta FROM part)
    SELECT request_id, r.pg_id, CASE WHEN size <= 0 OR size > 1073741824 OR length(meta) > 1024 THEN 'INVALID_ARG' WHEN pg.pg_id IS NULL THEN 'UNKNOWN_PG' WHEN f.pg_id IS NULL THEN 'NO_SPACE_LEFT' ELSE 'OK' END AS status
    FROM req r LEFT JOIN pg ON pg.pg_id = r.pg_id LEFT JOIN (SELECT DISTINCT pg_id FROM chunk WHERE state = 0) f ON f.pg_id = r.pg_id""",
    lambda s: writes.shard_creation(s.read("part").select(F.col("p_partkey").alias("request_id"), (F.col("p_size") % 7).cast("int").alias("pg_id"), F.when(F.col("p_size") % 11 == 0, 0).otherwise(F.col("p_size").cast("long") * 30000000).cast("long").alias("size"), F.repeat(F.lit("x"), F.col("p_size") * 25).alias("meta")), s.pg, s.chunk))
query("b11_shard_numbers", "SELECT pg_id, shard_id, row_number() OVER (PARTITION BY pg_id ORDER BY lsn)::BIGINT AS persistent_seq, row_number() OVER (PARTITION BY pg_id ORDER BY lsn)::BIGINT - 1 AS memory_seq FROM shard", lambda s: writes.shard_numbers(s.shard))
query("b12_seal_shard", "SELECT shard_id, min(CASE WHEN msg_type = 'SEAL_SHARD' THEN lsn END) AS seal_lsn, CASE WHEN min(CASE WHEN msg_type = 'SEAL_SHARD' THEN lsn END) IS NOT NULL THEN 1 ELSE 0 END AS state FROM oplog GROUP BY shard_id", lambda s: writes.seal(s.oplog))
query("b13_shard_commits", "SELECT pg_id, count(*) AS header_blks, count(*) FILTER (state = 1) AS footer_blks FROM shard GROUP BY pg_id", lambda s: writes.shard_commits(s.shard))
query("b14_create_group", """SELECT pg_id, CASE WHEN NOT coalesce(lead, false) OR lead IS NULL OR pg_size < 2147483648 THEN 'INVALID_ARG' WHEN pg_size // 2147483648 > coalesce(free, 0) THEN 'NO_SPACE_LEFT' ELSE 'OK' END AS status
    FROM pg LEFT JOIN (SELECT pg_id, max(priority) > 0 AS lead FROM member GROUP BY pg_id) m USING (pg_id) LEFT JOIN (SELECT pg_id, count(*) AS free FROM chunk WHERE state = 0 GROUP BY pg_id) f USING (pg_id)""", lambda s: writes.group_creation(s.pg, s.member, s.chunk))
query("b16_destroy_group", "SELECT pg_id, count(*) AS shards FROM shard WHERE pg_id NOT IN (2, 4) GROUP BY pg_id", lambda s: writes.without_groups(s.shard, s.pg.where("pg_id IN (2, 4)").select("pg_id")).groupBy("pg_id").agg(F.count("*").alias("shards")))
query("b22_group_record", """SELECT pg_id, '{"pg_id":' || pg_id || ',"pg_size":' || pg_size || ',"members":' || m.members || ',"chunk_ids":' || c.ids || '}' AS record FROM pg
    LEFT JOIN (SELECT pg_id, '[' || string_agg('{"id":"' || member_id || '","name":"' || name || '","priority":' || priority || '}', ',' ORDER BY member_id) || ']' AS members FROM member GROUP BY pg_id) m USING (pg_id)
    LEFT JOIN (SELECT pg_id, '[' || string_agg(chunk_id::VARCHAR, ',' ORDER BY v_chunk_id) || ']' AS ids FROM chunk GROUP BY pg_id) c USING (pg_id)""", lambda s: writes.group_record(s.pg, s.member, s.chunk))

# --- Predicates and projections ---
query("c1_shard_ids", "SELECT seq, pg_id, pg_id::BIGINT * 281474976710656 + seq AS shard_id FROM shard", lambda s: s.shard.select("seq", "pg_id", S.make_shard_id(F.col("pg_id"), F.col("seq")).alias("shard_id")))
query("c2_c3_shard_parts", "SELECT shard_id, shard_id % 281474976710656 AS part_seq, (shard_id // 281474976710656)::INT AS part_pg FROM shard", lambda s: s.shard.select("shard_id", S.shard_seq(F.col("shard_id")).alias("part_seq"), S.shard_pg(F.col("shard_id")).alias("part_pg")))
query("c4_object_ids", "SELECT seq, (9223372036854775808::DECIMAL(20,0) + seq * 32768 + seq % 100)::VARCHAR AS object_id FROM shard", lambda s: s.shard.select("seq", S.object_id(F.col("seq"), F.col("seq") % 100).cast("string").alias("object_id")))
query("c5_alloc_hints", "SELECT chunk_id, pg_id::BIGINT * 65536 + v_chunk_id AS hint FROM chunk", lambda s: s.chunk.select("chunk_id", S.alloc_hint(F.col("pg_id"), F.col("v_chunk_id")).alias("hint")))
query("c6_c7_live_and_open", "SELECT s.pg_id, count(*) AS live_in_open FROM blob b JOIN shard s USING (shard_id) WHERE NOT is_tombstone AND state = 0 GROUP BY s.pg_id",
    lambda s: reads.live(s.blob).join(s.shard.where(F.col("state") == S.OPEN).select("shard_id"), "shard_id").groupBy("pg_id").agg(F.count("*").alias("live_in_open")))
query("c8_state_mask", "SELECT pg_id, (pg_id | 4) AS set_bits, (pg_id & ~1) AS cleared, (pg_id & 2) = 2 AS tested FROM pg", lambda s: s.pg.select("pg_id", S.set_bits(F.col("pg_id"), 4).alias("set_bits"), S.clear_bits(F.col("pg_id"), 1).alias("cleared"), S.has_bits(F.col("pg_id"), 2).alias("tested")))
query("c9_gc_eligible", "SELECT chunk_id, defrag_blks FROM chunk WHERE defrag_blks > 0 AND state = 0 AND 100 * defrag_blks > total_blks * 5", lambda s: compaction.eligible(s.chunk, 5).select("chunk_id", "defrag_blks"))
query("c10_gc_gate", "SELECT pg_id, count(*) AS chunks FROM chunk WHERE pg_id % 2 = 1 GROUP BY pg_id", lambda s: relations.groups_alive(s.chunk, s.pg.select("pg_id", F.when(F.col("pg_id") % 2 == 1, S.ALIVE).otherwise(S.DISK_DOWN).alias("state"))).groupBy("pg_id").agg(F.count("*").alias("chunks")))
query("c11_mark_gc", "SELECT chunk_id, CASE WHEN state = 1 AND chunk_id % 2 = 0 THEN 1 ELSE 2 END AS marked FROM chunk", lambda s: s.chunk.select("chunk_id", placement.mark_gc(F.col("state"), F.col("chunk_id") % 2 == 1).alias("marked")))
query("c12_snapshot_cut", _EXPORTED + " SELECT pg_id, count(*) AS shards FROM exported GROUP BY pg_id", lambda s: _exported(s).groupBy("pg_id").agg(F.count("*").alias("shards")))
query("c13_equal_groups", "SELECT pg_id, pg_id <> 2 AS equal FROM pg", lambda s: relations.equal_groups(s.member, s.member.select("pg_id", "member_id", F.lit("x").alias("name"), F.when(F.col("pg_id") == 2, 9).otherwise(F.col("priority")).alias("priority"))))
query("c14_cursor_rule", """SELECT event_id, CASE WHEN user_id % 50 = 0 THEN true WHEN event_id % 10 = 9 THEN false ELSE (user_id % 50 = 41 AND event_id % 5 = 0) OR (user_id % 50 = 40 AND event_id % 5 IN (0, 2, 3)) END AS valid FROM events""",
    lambda s: s.read("events").select("event_id", snapshot.cursor_valid(F.when(F.col("event_id") % 10 != 9, 40), F.lit(2), F.lit(41), F.col("user_id") % 50, F.col("event_id") % 5).alias("valid")))
query("c16_blob_verify", "SELECT blob_id, blob_id % 7 <> 0 AND blob_id % 11 <> 0 AS verified FROM payload",
    lambda s: integrity.verify(s.payload.select("shard_id", "blob_id", "body", "user_key", F.lit(2).alias("version"), (F.col("shard_id") + (F.col("blob_id") % 7 == 0).cast("int")).alias("header_shard_id"), F.lit(0).alias("header_blob_id"), (F.crc32("body") + (F.col("blob_id") % 11 == 0).cast("int")).alias("hash")).withColumn("own_id", F.col("blob_id")).withColumn("blob_id", F.lit(0))).select(F.col("own_id").alias("blob_id"), "verified"))
query("c17_delete_marker", "SELECT blob_id, blob_id % 9 = 0 AS deleted FROM payload", lambda s: s.payload.select("blob_id", integrity.is_delete_marker(F.when(F.col("blob_id") % 9 == 0, F.concat(F.lit(integrity.DELETE_MARKER), "body")).otherwise(F.col("body"))).alias("deleted")))
query("c18_available_chunks", "SELECT chunk_id FROM chunk WHERE state = 0", lambda s: s.chunk.where(F.col("state") == S.AVAILABLE).select("chunk_id"))
query("c19_shard_views", """SELECT shard_id, '{"shard_id":' || shard_id || ',"state":' || state || ',"lsn":' || lsn || '}' AS info FROM shard""", lambda s: s.shard.select("shard_id", F.to_json(F.struct("shard_id", "state", "lsn")).alias("info")))

# --- Joins ---
_STATUS = "SELECT pg_id, member_id, name, coalesce(last_commit_lsn, 0) AS last_commit_lsn, coalesce(last_response_us, 0) AS last_response_us, coalesce(can_vote, true) AS can_vote FROM member LEFT JOIN peer USING (member_id)"
query("d1_member_status", _STATUS, lambda s: relations.member_status(s.member, s.peer))
query("d2_group_view", f", st AS ({_STATUS}) SELECT pg_id, group_name, count(*) AS members, count(*) FILTER (can_vote) AS voters, max(last_commit_lsn) AS last_lsn FROM pg JOIN st USING (pg_id) GROUP BY pg_id, group_name",
    lambda s: s.pg.join(relations.member_status(s.member, s.peer), "pg_id").groupBy("pg_id", "group_name").agg(F.count("*").alias("members"), F.count_if("can_vote").alias("voters"), F.max("last_commit_lsn").alias("last_lsn")))
query("d3_chunk_entries", """SELECT c.chunk_id, v_chunk_id, count(DISTINCT s.shard_id) AS shards, count(*) AS entries, sum(CASE WHEN is_tombstone THEN 0 ELSE blk_count END)::BIGINT AS live_blks
    FROM chunk c JOIN shard s USING (chunk_id) JOIN blob b ON b.shard_id = s.shard_id GROUP BY c.chunk_id, v_chunk_id""", lambda s: relations.chunk_entries(s.chunk, s.shard, s.blob))
query("d4_shard_overview", """SELECT s.shard_id, s.pg_id, s.state, s.chunk_id, c.v_chunk_id, coalesce(n, 0) AS total_blob_count, coalesce(l, 0) AS live_blob_count FROM shard s JOIN chunk c ON c.pg_id = s.pg_id AND c.chunk_id = s.chunk_id
    LEFT JOIN (SELECT shard_id, count(*) AS n, count(*) FILTER (NOT is_tombstone) AS l FROM blob GROUP BY shard_id) b ON b.shard_id = s.shard_id""", lambda s: relations.shard_overview(s.shard, s.blob, s.chunk))
query("d5_index_owners", "SELECT md5(r_name) AS uuid, CASE WHEN r_regionkey <> 3 THEN (r_regionkey + 1)::INT END AS pg_id, r_regionkey = 3 AS orphan FROM region",
    lambda s: relations.index_owners(s.pg.select(F.md5("group_name").alias("uuid")), s.pg.where("pg_id <> 4").select("pg_id", F.md5("group_name").alias("uuid"))))
query("d6_not_yet_stored", "SELECT shard_id, blob_id FROM (SELECT shard_id, blob_id + blob_id % 2 * 128 AS blob_id FROM blob) WHERE (shard_id, blob_id) NOT IN (SELECT (shard_id, blob_id) FROM blob)",
    lambda s: relations.not_yet_stored(s.blob.select("shard_id", (F.col("blob_id") + F.col("blob_id") % 2 * 128).alias("blob_id")), s.blob))
query("d7_membership_change", "SELECT pg_id, member_id, 'removed' AS change FROM member WHERE priority = 0 UNION ALL SELECT pg_id, member_id || 'x', 'added' FROM member WHERE priority > 0",
    lambda s: relations.membership_change(s.member.select("pg_id", "member_id"), s.member.where("priority <> 0").select("pg_id", "member_id").unionByName(s.member.where("priority > 0").select("pg_id", F.concat("member_id", F.lit("x")).alias("member_id")))))
query("d8_index_difference", """, a AS (SELECT shard_id, blob_id, blk_num AS copied_blk FROM blob WHERE blob_id % 13 <> 0), b AS (SELECT shard_id, blob_id, blk_num + CASE WHEN blob_id % 17 = 0 THEN 1 ELSE 0 END AS indexed_blk FROM blob WHERE blob_id % 19 <> 0)
    SELECT shard_id, blob_id, copied_blk, indexed_blk FROM a FULL JOIN b USING (shard_id, blob_id) WHERE copied_blk IS DISTINCT FROM indexed_blk""",
    lambda s: relations.index_difference(s.blob.where("blob_id % 13 <> 0").select("shard_id", "blob_id", "blk_num"), s.blob.where("blob_id % 19 <> 0").select("shard_id", "blob_id", (F.col("blk_num") + F.when(F.col("blob_id") % 17 == 0, 1).otherwise(0)).alias("blk_num"))))
query("d9_replace_index", """SELECT shard_id, blob_id, is_tombstone, CASE WHEN chunk_id % 3 = 0 AND blob_id % 2 = 0 THEN blk_num + 1000000 ELSE blk_num END AS blk_num FROM blob WHERE NOT (chunk_id % 3 = 0 AND is_tombstone)""",
    lambda s: relations.replace_index(s.blob, s.blob.where("chunk_id % 3 = 0 AND blob_id % 2 = 0 AND NOT is_tombstone").select("shard_id", "blob_id", (F.col("blk_num") + 1000000).alias("new_blk")), s.chunk.where("chunk_id % 3 = 0")))
query("d10_replay_lookup", "SELECT shard_id, blob_id FROM blob WHERE blob_id % 2 = 0", lambda s: relations.already_stored(s.blob.where("blob_id % 2 = 0").select("shard_id", "blob_id"), s.blob))
query("d11_prefetched", "SELECT chunk_id, count(*) AS blobs FROM blob WHERE NOT is_tombstone GROUP BY chunk_id", lambda s: snapshot.read_order(reads.live(s.blob)).groupBy("chunk_id").agg(F.count("*").alias("blobs")))
query("d12_recovered_tasks", "SELECT task_id, chunk_id FROM task WHERE to_chunk_id % 4 = 0", lambda s: compaction.recovered_tasks(s.task, s.task.where("to_chunk_id % 4 = 0").select(F.col("to_chunk_id").alias("reserved_chunk")).distinct()).select("task_id", "chunk_id"))
query("d13_chunk_states", "SELECT pg_id, chunk_id, state FROM chunk", lambda s: placement.recovered_states(s.chunk, s.shard))
query("d14_replica_mismatches", """SELECT shard_id, blob_id, count(*) AS copies, count(DISTINCT hash) AS hashes, CASE WHEN count(*) < 3 THEN 'missing' ELSE 'mismatch' END AS problem FROM replica GROUP BY shard_id, blob_id HAVING count(*) < 3 OR count(DISTINCT hash) > 1""", lambda s: relations.replica_mismatches(s.replica))

# --- Statistics ---
query("e1_open_shards", "SELECT pg_id, count(*) AS total_shards, count(*) FILTER (state = 0) AS open_shards FROM shard GROUP BY pg_id", lambda s: statistics.open_shards(s.shard))
query("e2_pg_stats", """SELECT s.pg_id, total_shards, open_shards, coalesce(active_blobs, 0) AS active_blobs, coalesce(tombstones, 0) AS tombstones, (coalesce(blks, 0) + 2 * total_shards - open_shards) * 4096 AS used_bytes
    FROM (SELECT pg_id, count(*) AS total_shards, count(*) FILTER (state = 0) AS open_shards FROM shard GROUP BY pg_id) s
    LEFT JOIN (SELECT pg_id, count(*) FILTER (NOT is_tombstone) AS active_blobs, count(*) FILTER (is_tombstone) AS tombstones, sum(blk_count)::BIGINT AS blks FROM blob GROUP BY pg_id) b USING (pg_id)""", lambda s: statistics.group_stats(s.shard, s.blob))
query("e4_service_stats", """SELECT ((SELECT sum(total_blks) - count(DISTINCT pdev_id) * 6 * 2000 FROM chunk) * 4096)::BIGINT AS total_bytes, (SELECT sum(CASE WHEN state <> 2 THEN used_blks ELSE 0 END) * 4096 FROM chunk)::BIGINT AS used_bytes,
    (SELECT count(*) FROM shard WHERE state = 0) AS open_shards, (SELECT count(*) FROM chunk) - (SELECT count(*) FROM shard WHERE state = 0) AS avail_open_shards, (SELECT count(DISTINCT pdev_id) FROM chunk) AS disks""", lambda s: statistics.service_stats(s.chunk, s.shard, placement.TOTAL_BLOCKS))
query("e5_refresh_counters", """SELECT pg_id, count(*) FILTER (NOT is_tombstone) AS active_blobs, count(*) FILTER (is_tombstone) AS tombstones, sum(blk_count)::BIGINT AS blob_blks, true AS repair FROM blob GROUP BY pg_id""",
    lambda s: statistics.refreshed_counters(s.blob, s.pg.select("pg_id", F.lit(999).cast("long").alias("active"), F.lit(888).cast("long").alias("dead"), F.lit(777).cast("long").alias("occupied"))))
query("e6_tombstones", "SELECT pg_id, count(*) FILTER (is_tombstone) AS tombstones FROM blob GROUP BY pg_id", lambda s: s.blob.groupBy("pg_id").agg(F.count_if("is_tombstone").alias("tombstones")))
query("e7_used_blocks", "SELECT sum(used_blks)::BIGINT AS used_blks FROM chunk WHERE state <> 2", lambda s: placement.used_blocks(s.chunk))
query("e8_device_blocks", "SELECT pdev_id, sum(total_blks)::BIGINT AS total_blks, count(*) AS chunks FROM chunk GROUP BY pdev_id", lambda s: placement.device_space(s.chunk))
query("e9_group_space", "SELECT pg_id, count(*) FILTER (state = 0) AS avail_chunks, sum(CASE WHEN state = 0 THEN available_blks ELSE 0 END)::BIGINT AS avail_blks, count(*) AS total_chunks FROM chunk GROUP BY pg_id", lambda s: placement.group_space(s.chunk))
query("e10_most_available", "SELECT max(n) AS most_avail_chunks FROM (SELECT count(*) AS n FROM chunk WHERE state = 0 GROUP BY pdev_id)", lambda s: placement.most_available_chunks(s.chunk))
query("e11_snapshot_percent", "SELECT pg_id, CASE WHEN total > 0 THEN 100 * done // total ELSE 0 END AS percent FROM (SELECT pg_id, sum(size)::BIGINT AS total, sum(CASE WHEN seq % 3 = 0 THEN size ELSE 0 END)::BIGINT AS done FROM blob GROUP BY pg_id)",
    lambda s: s.blob.groupBy("pg_id").agg(F.sum("size").alias("total"), F.sum(F.when(F.col("seq") % 3 == 0, F.col("size")).otherwise(0)).alias("done")).select("pg_id", snapshot.complete_percent(F.col("done"), F.col("total")).alias("percent")))


def _received(s: Store) -> DataFrame:
    return s.read("events").select(F.col("user_id").alias("shard_id"), (F.col("event_id") % 4).alias("batch_id"), F.col("event_id").alias("attempt"), (F.col("event_id") % 5).alias("blobs"), (F.col("event_id") % 1000).alias("bytes"), (F.col("event_id") % 2).alias("corrupted"))


query("e12_batch_totals", """, last AS (SELECT user_id AS shard_id, event_id % 4 AS batch_id, max(event_id) AS e FROM events GROUP BY 1, 2)
    SELECT shard_id, count(*) AS batches, sum(e % 5)::BIGINT AS blobs, sum(e % 1000)::BIGINT AS bytes, sum(e % 2)::BIGINT AS corrupted FROM last GROUP BY shard_id""", lambda s: snapshot.progress(_received(s)))
query("e13_job_status", "SELECT job_id, count(*) AS total, count(*) FILTER (succeeded) AS success, count(*) FILTER (NOT succeeded) AS failed, CASE WHEN count(*) FILTER (NOT succeeded) > 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status FROM task GROUP BY job_id", lambda s: statistics.job_status(s.task))
query("e14_reclaimed", "SELECT priority, sum(used_from - used_to)::BIGINT AS reclaimed_blks, (sum(used_from - used_to) * 1000 // sum(used_from))::BIGINT AS per_mille FROM task WHERE succeeded GROUP BY priority", lambda s: statistics.reclaimed(s.task))
query("e15_task_counts", "SELECT priority, succeeded, count(*) AS tasks FROM task GROUP BY priority, succeeded", lambda s: statistics.task_counts(s.task))
query("e16_next_sequences", "SELECT s.pg_id, s.n AS next_shard_seq, coalesce(b.n, 0) AS next_blob_id FROM (SELECT pg_id, max(seq) + 1 AS n FROM shard GROUP BY pg_id) s LEFT JOIN (SELECT pg_id, max(blob_id) + 1 AS n FROM blob GROUP BY pg_id) b USING (pg_id)", lambda s: statistics.next_sequences(s.shard, s.blob))
query("e17_scrub_bound", "SELECT shard_id, greatest(CASE WHEN count(*) < 3 THEN 5000 ELSE max(n) END, 1)::BIGINT AS bound FROM (SELECT shard_id, replica, count(*) AS n FROM replica GROUP BY shard_id, replica) GROUP BY shard_id", lambda s: statistics.scrub_bound(s.replica, 5000))
query("e18_index_size", """, n0 AS (SELECT pg_id, count(*) AS entries, ceil(count(*) / 167.0)::BIGINT AS leaves FROM blob GROUP BY pg_id),
    n1 AS (SELECT *, CASE WHEN leaves > 1 THEN ceil(leaves / 125.0) ELSE 0 END::BIGINT AS a FROM n0), n2 AS (SELECT *, CASE WHEN a > 1 THEN ceil(a / 125.0) ELSE 0 END::BIGINT AS b FROM n1), n3 AS (SELECT *, CASE WHEN b > 1 THEN ceil(b / 125.0) ELSE 0 END::BIGINT AS c FROM n2)
    SELECT pg_id, entries, leaves, a + b + c AS inner_nodes, (leaves + a + b + c) * 4096 AS bytes FROM n3""", lambda s: statistics.index_size(s.blob))
query("e19_histogram", "SELECT CASE WHEN used_from >= 2000 THEN 11 ELSE used_from // 200 + 1 END AS bucket, count(*) AS n FROM task GROUP BY 1", lambda s: statistics.histogram(s.task, F.col("used_from"), 0.0, 2000.0, 10))

# --- Order, placement, sets ---
query("w4_scan_cap", "SELECT pdev_id, chunk_id, defrag_blks FROM (SELECT *, row_number() OVER (PARTITION BY pdev_id ORDER BY chunk_id) AS nth FROM chunk WHERE defrag_blks > 0 AND state = 0 AND 100 * defrag_blks > total_blks * 2) WHERE nth <= 8", lambda s: compaction.scan(s.chunk, 2))
query("w5_last_shards", "SELECT chunk_id, max(shard_id) AS last_shard FROM shard GROUP BY chunk_id", lambda s: compaction.last_shards(s.shard))
query("f1_export_order", _EXPORTED + " SELECT * FROM exported", _exported)
query("f3_chunks_for_group", """, d AS (SELECT pdev_id FROM chunk WHERE state = 0 GROUP BY pdev_id HAVING count(*) >= 3 ORDER BY count(*) DESC, pdev_id LIMIT 1),
    r AS (SELECT pdev_id, chunk_id, available_blks, row_number() OVER (PARTITION BY pdev_id ORDER BY available_blks DESC, chunk_id)::BIGINT AS rank FROM chunk WHERE state = 0 AND pdev_id IN (SELECT pdev_id FROM d)) SELECT * FROM r WHERE rank <= 3""", lambda s: placement.chunks_for_group(s.chunk, 3))
query("f4_chunk_for_shard", """, best AS (SELECT pg_id, v_chunk_id, available_blks FROM chunk WHERE state = 0 AND available_blks > 0 QUALIFY row_number() OVER (PARTITION BY pg_id ORDER BY available_blks DESC, v_chunk_id) = 1)
    SELECT g.pg_id, v_chunk_id, available_blks, CASE WHEN v_chunk_id IS NULL THEN 'NO_SPACE_LEFT' ELSE 'OK' END AS status FROM (SELECT DISTINCT pg_id FROM chunk) g LEFT JOIN best USING (pg_id)""", lambda s: placement.chunk_for_shard(s.chunk))
query("f5_chunk_heap", "SELECT pdev_id, chunk_id, available_blks, row_number() OVER (PARTITION BY pdev_id ORDER BY available_blks DESC, chunk_id)::BIGINT AS rank FROM chunk WHERE state = 0", lambda s: placement.chunk_heap(s.chunk))
query("f6_yield_target", "SELECT pg_id, max(priority) AS priority, arg_min(member_id, member_id) AS member_id FROM member WHERE priority > 0 AND NOT is_leader GROUP BY pg_id", lambda s: relations.yield_target(s.member))
query("f9_latest_jobs", "SELECT job_id, max(task_id) AS last_task FROM task GROUP BY job_id ORDER BY last_task DESC, job_id LIMIT 100", lambda s: compaction.latest_jobs(s.task))
query("f10_switch_chunks", """, done AS (SELECT chunk_id, arg_max(to_chunk_id, task_id) AS new_chunk_id FROM task WHERE succeeded GROUP BY chunk_id)
    SELECT pg_id, v_chunk_id, chunk_id AS old_chunk_id, new_chunk_id, CASE WHEN state = 1 THEN 1 ELSE 0 END AS state FROM chunk JOIN done USING (chunk_id)""", lambda s: placement.switch_chunks(s.chunk, s.task))
query("f11_select_chunk", "SELECT chunk_id, state FROM chunk WHERE pg_id = 1 AND v_chunk_id = 2 AND state <> 2", lambda s: placement.select_chunk(s.chunk, 1, 2).select("chunk_id", "state"))
query("g1_g3_replacement", """, m AS (SELECT list_sort(list(member_id)) AS m, min(member_id) AS o FROM member WHERE pg_id = 1)
    SELECT 1::INT AS pg_id, array_to_string(list_sort(list_append(m, 'zz')), ',') AS at_start, array_to_string(list_sort(list_append(list_filter(m, lambda x: x <> '00000123456789abcdef0123456789ab'), 'zz')), ',') AS completed,
           array_to_string(list_filter(m, lambda x: x <> '00000123456789abcdef0123456789ab'), ',') AS removed FROM m""", lambda s: relations.replacement(s.member.withColumn("pg_id", F.col("pg_id")), 1, "00000123456789abcdef0123456789ab", "zz"))
query("g4_merged_shards", """, own AS (SELECT chunk_id, shard_id FROM shard), moved AS (SELECT DISTINCT to_chunk_id AS chunk_id, shard_id FROM task JOIN own USING (chunk_id) WHERE succeeded)
    SELECT chunk_id, count(*) AS shards FROM (SELECT * FROM own UNION SELECT * FROM moved) GROUP BY chunk_id""", lambda s: relations.merged_shards(s.shard, s.task))
query("g5_reconcile", "SELECT pg_id, member_id, CASE WHEN priority >= 0 THEN name ELSE '' END AS name, CASE WHEN priority >= 0 THEN priority ELSE 0 END AS priority FROM member", lambda s: relations.reconciled(s.member.select("pg_id", "member_id"), s.member.where("priority >= 0")))

# --- Log ---
query("i1_dispatch", "SELECT msg_type, count(*) AS n, min(lsn) AS first_lsn, max(lsn) AS last_lsn FROM oplog GROUP BY msg_type", lambda s: oplog.dispatch(s.oplog))
query("i2_index_fold", _FOLD + " SELECT * FROM folded", lambda s: oplog.fold_index(s.oplog))
query("i2_stream_fold", _FOLD + " SELECT shard_id, blob_id, put_lsn, del_lsn, blk_count, is_tombstone FROM folded", lambda s: fold_files(s.spark, s.oplog_stream, s.scratch()))
query("i3_puts_after_seal", """, s AS (SELECT shard_id, min(lsn) AS seal_lsn FROM oplog WHERE msg_type = 'SEAL_SHARD' GROUP BY shard_id)
    SELECT lsn, shard_id, blob_id, 'SEALED_SHARD' AS status FROM oplog JOIN s USING (shard_id) WHERE msg_type = 'PUT_BLOB' AND lsn > seal_lsn""", lambda s: oplog.after_seal(s.oplog))
query("i4_rollback", "SELECT msg_type, count(*) AS n FROM oplog WHERE lsn % 10 <> 3 GROUP BY msg_type", lambda s: oplog.rolled_back(s.oplog, s.oplog.where("lsn % 10 = 3").select("lsn")).groupBy("msg_type").agg(F.count("*").alias("n")))
query("i5_replay", "SELECT pg_id, chunk_id, state FROM chunk WHERE state = 1", lambda s: placement.recovered_states(s.chunk, s.shard).where(F.col("state") == S.IN_USE))
query("i12_resume", _EXPORTED + " SELECT pg_id, shard_id, position FROM exported WHERE position > 5", lambda s: snapshot.resume(_exported(s), _exported(s).where("position <= 5").select("shard_id")).select("pg_id", "shard_id", "position"))
query("i13_deferred_no_space", """, c AS (SELECT pg_id, max(lsn) AS last_lsn FROM oplog WHERE lsn % 3 <> 0 GROUP BY pg_id), e AS (SELECT pg_id, max(lsn) AS lsn FROM oplog GROUP BY pg_id)
    SELECT pg_id, lsn, coalesce(last_lsn >= lsn - 1, false) AS ready FROM e LEFT JOIN c USING (pg_id)""",
    lambda s: oplog.deferred_no_space(s.oplog.groupBy("pg_id").agg(F.max("lsn").alias("lsn")), s.oplog.where("lsn % 3 <> 0").groupBy("pg_id").agg(F.max("lsn").alias("last_lsn"))))
query("i14_duplicates", "SELECT lsn, msg_type, shard_id, blob_id FROM (SELECT *, row_number() OVER (PARTITION BY msg_type, shard_id, blob_id ORDER BY lsn) AS nth FROM oplog WHERE msg_type <> 'SEAL_SHARD') WHERE nth > 1", lambda s: oplog.replay_duplicates(s.oplog))
query("i6_group_meta", """SELECT s.pg_id, shard_seq_num, shards, blob_seq_num, total_blobs, total_bytes FROM (SELECT pg_id, max(seq) + 1 AS shard_seq_num, count(*) AS shards FROM shard GROUP BY pg_id) s
    LEFT JOIN (SELECT pg_id, max(blob_id) + 1 AS blob_seq_num, count(*) FILTER (NOT is_tombstone) AS total_blobs, sum(blk_count)::BIGINT * 4096 AS total_bytes FROM blob GROUP BY pg_id) b USING (pg_id)""", lambda s: snapshot.group_meta(s.shard, s.blob))
query("w2_i8_export_batches", """, ordered AS (SELECT shard_id, size, row_number() OVER (PARTITION BY shard_id ORDER BY blob_id) AS n FROM blob WHERE NOT is_tombstone),
    walk AS (WITH RECURSIVE w(shard_id, n, size, batch, total) AS (
        SELECT shard_id, n, size, 0::BIGINT, size FROM ordered WHERE n = 1
        UNION ALL SELECT o.shard_id, o.n, o.size, CASE WHEN w.total >= 65536 THEN w.batch + 1 ELSE w.batch END, CASE WHEN w.total >= 65536 THEN o.size ELSE w.total + o.size END FROM w JOIN ordered o ON o.shard_id = w.shard_id AND o.n = w.n + 1) SELECT * FROM w)
    SELECT shard_id, batch + 1 AS batch_id, count(*) AS blobs, sum(size)::BIGINT AS bytes, batch = max(batch) OVER (PARTITION BY shard_id) AS is_last_batch FROM walk GROUP BY shard_id, batch""", lambda s: snapshot.export_batches(s.blob, 65536))
query("w3_scrub_bins", None, lambda s: snapshot.bins(s.blob.groupBy("pg_id", "seq").agg(F.count("*").alias("n")), "pg_id", "seq", "n", 12))

# --- Compaction ---
_PLAN = """, last AS (SELECT chunk_id, max(shard_id) AS last_shard FROM shard GROUP BY chunk_id), alive AS (SELECT shard_id, sum(blk_count)::BIGINT AS blks, count(*) AS n FROM blob WHERE NOT is_tombstone GROUP BY shard_id),
kept AS (SELECT s.chunk_id, coalesce(blks, 0) AS blks, coalesce(n, 0) AS n, shard_id = last_shard AND state = 0 AS open_last, n IS NOT NULL OR (shard_id = last_shard AND state = 0) AS k FROM shard s JOIN last USING (chunk_id) LEFT JOIN alive USING (shard_id)),
planned AS (SELECT chunk_id, sum(n)::BIGINT AS blobs, sum(blks)::BIGINT AS live_blks, count(*) FILTER (k) AS headers, count(*) FILTER (k AND NOT open_last) AS footers, (sum(blks) + count(*) FILTER (k) + count(*) FILTER (k AND NOT open_last))::BIGINT AS copied_blks FROM kept GROUP BY chunk_id)"""
query("k1_scan", "SELECT pdev_id, count(*) AS eligible FROM chunk WHERE defrag_blks > 0 AND state = 0 AND 100 * defrag_blks > total_blks * 3 GROUP BY pdev_id", lambda s: compaction.eligible(s.chunk, 3).groupBy("pdev_id").agg(F.count("*").alias("eligible")))
query("k2_k3_submissions", """SELECT task_id, t.chunk_id, priority, CASE WHEN state IS NULL THEN 'rejected' WHEN priority = 'normal' AND defrag_blks = 0 THEN 'done' WHEN state = 2 OR (state = 1 AND priority = 'normal') THEN 'rejected' ELSE 'queued' END AS status
    FROM task t LEFT JOIN chunk USING (chunk_id)""", lambda s: compaction.submissions(s.task, s.chunk))
query("k4_purge", """, latest AS (SELECT chunk_id, arg_max(to_chunk_id, task_id) AS to_chunk_id FROM task WHERE succeeded GROUP BY chunk_id)
    SELECT to_chunk_id, count(*) AS entries FROM blob JOIN latest USING (chunk_id) WHERE NOT is_tombstone AND to_chunk_id % 5 <> 0 GROUP BY to_chunk_id""",
    lambda s: compaction.purged(reads.gc_index_prefix(s.chunk, s.blob, s.task), s.task.where("to_chunk_id % 5 = 0").select("to_chunk_id").distinct()).groupBy("to_chunk_id").agg(F.count("*").alias("entries")))
query("k5_plan", _PLAN + " SELECT * FROM planned", lambda s: compaction.plan(s.shard, s.blob))
query("k6_outcome", _PLAN + " SELECT chunk_id, used_blks AS used_from, copied_blks AS used_to, defrag_blks FROM chunk JOIN planned USING (chunk_id) WHERE defrag_blks > 0 AND state = 0 AND 100 * defrag_blks > total_blks * 2", lambda s: compaction.outcome(s.chunk, compaction.plan(s.shard, s.blob), 2))
query("k7_group_update", """, done AS (SELECT chunk_id, sum(used_from - used_to)::BIGINT AS reclaimed FROM task WHERE succeeded GROUP BY chunk_id)
    SELECT pg_id, sum(reclaimed)::BIGINT AS reclaimed_blks, count(*) AS chunks FROM chunk JOIN done USING (chunk_id) GROUP BY pg_id""", lambda s: compaction.group_update(s.task, s.chunk))
query("k8_trigger", "SELECT chunk_id, defrag_blks FROM chunk WHERE defrag_blks > 0 AND pg_id = 2", lambda s: compaction.triggered(s.chunk, pg_id=2).select("chunk_id", "defrag_blks"))
query("k11_job_report", "SELECT job_id, priority, count(*) AS tasks, count(*) FILTER (succeeded) AS success FROM task GROUP BY job_id, priority", lambda s: s.task.groupBy("job_id", "priority").agg(F.count("*").alias("tasks"), F.count_if("succeeded").alias("success")))

# --- Scalars ---
query("h1_checksums", None, lambda s: s.payload.select("blob_id", integrity.checksum(F.col("body")).alias("crc32")))
query("h3_digests", "SELECT blob_id, md5(body) AS md5, sha1(body) AS sha1 FROM payload", lambda s: s.payload.select("blob_id", F.md5("body").alias("md5"), F.sha1("body").alias("sha1")))
query("h4_blocks", "SELECT blob_id, ((size + 511) // 512) * 512 AS aligned, ((size + 4095) // 4096) * 4096 AS padded, 1 + (size + 4095) // 4096 AS blocks FROM blob",
    lambda s: s.blob.select("blob_id", S.round_up(F.col("size"), 512).alias("aligned"), S.round_up(F.col("size"), 4096).alias("padded"), S.blob_blocks(F.col("size")).alias("blocks")))
query("h5_routes", "SELECT printf('%04x:%012x:%016x', pg_id, seq, blob_id) AS route FROM blob", lambda s: s.blob.select(S.route(F.col("shard_id"), F.col("blob_id")).alias("route")))
query("h7_uuid", "SELECT n_nationkey, n_nationkey % 2 = 0 AS valid FROM nation", lambda s: s.read("nation").select("n_nationkey", S.is_uuid(F.when(F.col("n_nationkey") % 2 == 0, "01234567-89ab-cdef-0123-456789abcdef").otherwise("0123")).alias("valid")))
query("h12_error_names", """SELECT lsn, CASE lsn % 4 WHEN 0 THEN 'INVALID_ARG' WHEN 1 THEN 'SHUTTING_DOWN' WHEN 2 THEN 'TIMEOUT' ELSE 'UNKNOWN' END AS error FROM oplog""",
    lambda s: s.oplog.select("lsn", S.api_error(F.element_at(F.array(*(F.lit(x) for x in ("BAD_REQUEST", "CANCELLED", "TIMEOUT", "ODD"))), (F.col("lsn") % 4 + 1).cast("int"))).alias("error")))
query("h13_stats_text", "SELECT pg_id, 'PG ' || pg_id || ': ' || count(*) || ' shards' AS line FROM shard GROUP BY pg_id", lambda s: s.shard.groupBy("pg_id").agg(F.count("*").alias("n")).select("pg_id", F.format_string("PG %d: %d shards", "pg_id", "n").alias("line")))
query("h14_h15_overrides", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'hdd' ELSE 'nvme' END AS kind FROM supplier", lambda s: s.read("supplier").select("s_suppkey", F.lower(F.coalesce(F.when(F.col("s_suppkey") % 2 == 0, "HDD"), F.lit("NVME"))).alias("kind")))

# --- More writes, export and views ---
query("a2_get_if_ready", "SELECT b.shard_id, b.blob_id, CASE WHEN b.pg_id = 3 THEN 'RETRY' WHEN b.is_tombstone THEN 'UNKNOWN_BLOB' ELSE 'OK' END AS status FROM blob b",
    lambda s: s.blob.join(reads.lookup(s.blob, s.blob.select("shard_id", "blob_id")), ["shard_id", "blob_id"]).select("shard_id", "blob_id", F.when(F.col("pg_id") == 3, "RETRY").otherwise(F.col("status")).alias("status")))
query("a3_memory_get", "SELECT shard_id, blob_id, sha256(body) AS sha256 FROM payload", lambda s: s.payload.select("shard_id", "blob_id", F.sha2("body", 256).alias("sha256")))
query("a6_partial_reads", _REQUESTS_SQL + " SELECT shard_id, blob_id FROM answer WHERE status = 'OK' AND partial", lambda s: reads.read_range(s.payload, _requests(s)).where("partial").select("shard_id", "blob_id"))
query("b2_put_records", """, c AS (SELECT pg_id, max(blob_id) + 1 AS n FROM blob GROUP BY pg_id), puts AS (SELECT pg_id, shard_id, seq AS request_id, (seq % 9000)::BIGINT AS size FROM shard)
    SELECT pg_id, shard_id, request_id, coalesce(n, 0) + row_number() OVER (PARTITION BY pg_id ORDER BY request_id) - 1 AS blob_id, 1 + (size + 4095) // 4096 AS blk_count, ((size + 8191) // 4096) * 4096 - 4096 - size AS padding FROM puts LEFT JOIN c USING (pg_id)""",
    lambda s: writes.put_records(s.shard.select("pg_id", "shard_id", F.col("seq").alias("request_id"), (F.col("seq") % 9000).alias("size")), s.blob.groupBy("pg_id").agg((F.max("blob_id") + 1).alias("blob_sequence_num"))))
query("b7_delete_records", "SELECT s.shard_id, s.seq * 256 AS blob_id, 'DEL_BLOB' AS msg_type, NOT coalesce(is_tombstone, true) AS was_live FROM shard s LEFT JOIN blob b ON b.shard_id = s.shard_id AND b.blob_id = s.seq * 256",
    lambda s: writes.delete_records(s.blob, s.shard.select("shard_id", (F.col("seq") * 256).alias("blob_id"))))
query("b15_h8_group_records", "SELECT pg_id, m AS members, c AS chunks, pg_id <> 2 AND lead AS sound FROM pg JOIN (SELECT pg_id, count(*) AS m, max(priority) > 0 AS lead FROM member GROUP BY pg_id) USING (pg_id) JOIN (SELECT pg_id, count(*) AS c FROM chunk GROUP BY pg_id) USING (pg_id)",
    lambda s: writes.parsed_group_records(writes.group_record(s.pg, s.member, s.chunk).withColumn("crc", F.crc32(F.col("record").cast("binary")) + F.when(F.col("pg_id") == 2, 1).otherwise(0))))
query("b20_group_gauges", """, o AS (SELECT pg_id, count(*) FILTER (state = 0) AS open_shards FROM shard GROUP BY pg_id), b AS (SELECT pg_id, count(*) FILTER (is_tombstone) * 1000 // count(*) AS d FROM blob GROUP BY pg_id),
    c AS (SELECT pg_id, (sum(defrag_blks) * 1000 // sum(total_blks))::BIGINT AS g, (sum(used_blks) * 1000 // sum(total_blks))::BIGINT AS u FROM chunk GROUP BY pg_id)
    SELECT pg_id, open_shards, coalesce(d, 0) AS deleted_per_mille, g AS garbage_per_mille, u AS used_per_mille FROM o LEFT JOIN b USING (pg_id) LEFT JOIN c USING (pg_id)""", lambda s: statistics.group_gauges(s.shard, s.blob, s.chunk))
query("e3_memory_stats", "SELECT pg_id, count(*) AS total_shards, count(*) FILTER (state = 0) AS open_shards FROM shard GROUP BY pg_id", lambda s: statistics.open_shards(s.shard))
query("h9_shard_records", "SELECT shard_id, state, lsn FROM shard", lambda s: s.shard.select(F.from_json(F.to_json(F.struct("shard_id", "state", "lsn")), "shard_id bigint, state int, lsn bigint").alias("r")).select("r.*"))
query("i6_export_messages", _EXPORTED + """, m AS (SELECT DISTINCT pg_id, 0::BIGINT AS position, 0::BIGINT AS batch_id, 'group' AS kind FROM exported UNION ALL SELECT pg_id, position, 0, 'shard' FROM exported
        UNION ALL SELECT DISTINCT e.pg_id, position, 1, 'blobs' FROM exported e JOIN blob USING (shard_id) WHERE NOT is_tombstone)
    SELECT *, (9223372036854775808::DECIMAL(20,0) + position * 32768 + batch_id)::VARCHAR AS message_id FROM m""", lambda s: snapshot.messages(_exported(s), snapshot.export_batches(s.blob, 1 << 40)))
query("i9_prefetch_states", "SELECT blob_id, CASE WHEN blob_id % 7 <> 0 THEN 'NORMAL' ELSE 'CORRUPTED' END AS state FROM payload",
    lambda s: s.payload.select("blob_id", snapshot.prefetch_state(integrity.checksum(F.col("body")) == F.crc32("body") + (F.col("blob_id") % 7 == 0).cast("int")).alias("state")))
query("i11_received_batches", """SELECT user_id AS shard_id, event_id % 4 AS batch_id, count(*) AS blobs, count(*) FILTER (event_id % 11 = 0) AS corrupted, CASE WHEN count(*) FILTER (event_id % 11 <> 0 AND event_id % 31 = 0) > 0 THEN 'FAILED' ELSE 'OK' END AS status FROM events GROUP BY 1, 2""",
    lambda s: snapshot.receive(s.read("events").select(F.col("user_id").alias("shard_id"), (F.col("event_id") % 4).alias("batch_id"), F.when(F.col("event_id") % 11 == 0, "CORRUPTED").otherwise("NORMAL").alias("state"), (F.col("event_id") % 31 != 0).alias("sound"))))
query("v_quorum", f", st AS ({_STATUS}), q AS (SELECT pg_id, min(last_commit_lsn) AS least_lsn, max(last_commit_lsn) AS greatest_lsn, count(*) AS voters FROM st WHERE can_vote GROUP BY pg_id)"
    " SELECT s.pg_id, total_shards, open_shards, least_lsn, greatest_lsn, voters FROM (SELECT pg_id, count(*) AS total_shards, count(*) FILTER (state = 0) AS open_shards FROM shard GROUP BY pg_id) s LEFT JOIN q USING (pg_id)",
    lambda s: statistics.quorum(statistics.open_shards(s.shard), relations.member_status(s.member, s.peer)))
