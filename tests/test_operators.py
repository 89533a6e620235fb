"""Small cases with known answers."""

import os
import zlib

from pyspark.sql import functions as F

from shardwise.functions import scalars as S
from shardwise.operators import compaction, integrity, oplog, placement, reads, snapshot, statistics, writes
from shardwise.sources import files
from shardwise.streaming.fold import fold_files, fold_stream

CHUNKS = [(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 4, 1), (2, 5, 2), (2, 6, 3), (3, 7, 1), (3, 8, 2), (3, 9, 3)]


def chunks(spark, pg=True):
    rows = [(d if pg else 0, c, d, (c - 1) % 3, 3, 0, 0, a, 0) for d, c, a in CHUNKS]
    return spark.createDataFrame(rows, "pg_id int, chunk_id long, pdev_id int, v_chunk_id long, total_blks long, used_blks long, defrag_blks long, available_blks long, state int")


def test_chunk_space(spark):
    c = chunks(spark)
    assert c.agg(F.sum("available_blks")).first()[0] == 18
    assert {tuple(r) for r in placement.group_space(c).collect()} == {(1, 3, 6, 3), (2, 3, 6, 3), (3, 3, 6, 3)}
    assert placement.most_available_chunks(c).first()[0] == 3
    assert [r["chunk_id"] for r in placement.chunks_for_group(c, 3).orderBy("rank").collect()] == [3, 2, 1]
    assert placement.chunks_for_group(c, 4).count() == 0


def test_most_available_chunk_until_none(spark):
    c, left = chunks(spark), []
    for _ in range(4):
        best = {r["pg_id"]: r for r in placement.chunk_for_shard(c).collect()}
        left.append(c.where("pg_id = 1 AND state = 0").agg(F.coalesce(F.sum("available_blks"), F.lit(0))).first()[0])
        status = best[1]["status"]
        if status == "OK":
            c = c.withColumn("state", F.when((F.col("pg_id") == 1) & (F.col("v_chunk_id") == best[1]["v_chunk_id"]), 1).otherwise(F.col("state")))
    assert left == [6, 3, 1, 0] and status == "NO_SPACE_LEFT"


def test_shard_ids_beyond_the_sign_bit(spark):
    r = spark.range(1).select(S.make_shard_id(F.lit(40000), F.lit(7)).alias("id")).select("id", S.shard_pg(F.col("id")).alias("pg"), S.shard_seq(F.col("id")).alias("seq"), S.unsigned(F.col("id")).alias("u")).first()
    assert r["id"] == -7187745005283311616 + 7 and (r["pg"], r["seq"]) == (40000, 7) and int(r["u"]) == (40000 << 48) + 7
    too_large = spark.range(1).select(S.object_id(F.lit(1 << 48), F.lit(0)).alias("a"), S.object_id(F.lit(1), F.lit(1 << 15)).alias("b"), S.object_id(F.lit(1), F.lit(2)).alias("c")).first()
    assert too_large["a"] is None and too_large["b"] is None and int(too_large["c"]) == (1 << 63) + (1 << 15) + 2


def test_fold_keeps_tombstones(spark):
    rows = [(1, "DEL_BLOB"), (2, "PUT_BLOB"), (3, "DEL_BLOB"), (4, "PUT_BLOB"), (5, "DEL_BLOB")]
    log = spark.createDataFrame([(n, 1, 9, 4, k, 3, False, n) for n, k in rows], "lsn long, pg_id int, shard_id long, blob_id long, msg_type string, blk_count int, header_corrupted boolean, blk_num long")
    r = oplog.fold_index(log).first()
    assert (r["put_lsn"], r["del_lsn"], r["is_tombstone"]) == (2, 3, True)
    assert [x["counted"] for x in oplog.delete_outcomes(log).orderBy("lsn").collect()] == [False, True, False]
    assert [x["status"] for x in writes.put_commits(log).orderBy("lsn").collect()] == ["OK", "OK"]  # the second finds a deleted entry
    taken = spark.createDataFrame([(n, 9, 4, "PUT_BLOB", False, a) for n, a in ((1, 7), (2, 7), (3, 8))], "lsn long, shard_id long, blob_id long, msg_type string, header_corrupted boolean, blk_num long")
    assert [(x["status"], x["existed"]) for x in writes.put_commits(taken).orderBy("lsn").collect()] == [("OK", False), ("OK", True), ("CONFLICT", True)]


def test_cursor_rule(spark):
    """At batch 2 of shard 4, with shard 7 next."""
    asked = [(0, 0), (0, 5), (4, 0), (4, 2), (4, 3), (4, 1), (4, 4), (7, 0), (7, 1), (5, 0), (9, 0)]
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(asked)], "k int, seq long, batch long").orderBy("k")
    valid = snapshot.cursor_valid(F.lit(4), F.lit(2), F.lit(7), F.col("seq"), F.col("batch"))
    assert [r[0] for r in df.select(valid).collect()] == [True, True, True, True, True, False, False, True, False, False, False]
    none = snapshot.cursor_valid(F.lit(None).cast("int"), F.lit(0), F.lit(1), F.col("seq"), F.col("batch"))
    assert [r[0] for r in df.select(none).collect()] == [s == 0 for s, _ in asked]


def test_stream_folds_as_the_batch(spark, tmp_path):
    from shardwise.sources.store import Store

    log = Store(spark, "/root/testdata/sf0.001").oplog
    for k in range(3):
        log.where(f"lsn % 1000 >= {k} * 300 AND lsn % 1000 < {k + 1} * 300 AND lsn < 1000").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in log.schema)
    stream = fold_stream(files.stream_log(spark, str(tmp_path / "log"), schema))
    q = stream.writeStream.outputMode("update").format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    got = {}
    for r in spark.table("folded").collect():
        old = got.get((r["shard_id"], r["blob_id"]))
        new = (r["put_lsn"], r["del_lsn"])
        got[r["shard_id"], r["blob_id"]] = new if old is None or old[1] is None else old
    want = {(r["shard_id"], r["blob_id"]): (r["put_lsn"], r["del_lsn"]) for r in oplog.fold_index(log.where("lsn < 900")).collect()}
    assert got == want


def test_stream_folds_in_any_order_without_python(spark, tmp_path):
    """Each entry comes in a batch of its own, the last first; keys are folded by built-in functions."""
    log = [(1, 7, 1, "DEL_BLOB", 5, False), (2, 7, 1, "PUT_BLOB", 3, False), (3, 7, 1, "DEL_BLOB", 5, False), (4, 7, 1, "PUT_BLOB", 4, False), (5, 7, 1, "DEL_BLOB", 5, False)]
    log += [(6, 7, 2, "PUT_BLOB", 6, True), (7, 7, 2, "PUT_BLOB", 7, False), (8, 7, 3, "DEL_BLOB", 5, False), (9, None, 4, "PUT_BLOB", 8, False), (10, None, 4, "DEL_BLOB", 5, False)]
    schema = "lsn long, shard_id long, blob_id long, msg_type string, blk_count int, header_corrupted boolean"
    for n, row in enumerate(reversed(log)):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        part = max((tmp_path / "log").glob("*.parquet"), key=lambda f: f.stat().st_ctime_ns)
        os.utime(part, (1_000_000 + n, 1_000_000 + n))
    stream = files.stream_log(spark, str(tmp_path / "log"), schema)
    assert "Pandas" not in fold_stream(stream)._jdf.queryExecution().logical().toString()
    got = fold_files(spark, stream, str(tmp_path / "folded"))
    columns = ["shard_id", "blob_id", "put_lsn", "del_lsn", "blk_count", "is_tombstone"]
    want = oplog.fold_index(spark.createDataFrame([(*row, 1) for row in log], f"{schema}, pg_id int")).select(columns)
    assert {tuple(r) for r in want.collect()} == {(7, 1, 2, 3, 3, True), (7, 2, 7, None, 7, False), (None, 4, 9, None, 8, False)}
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.collect()))


def test_statistics_of_a_group(spark):
    blob = spark.createDataFrame([(1, n, 2, n < 3) for n in range(10)], "pg_id int, blob_id long, blk_count long, is_tombstone boolean")
    stored = spark.createDataFrame([(1, 999, 888, 777)], "pg_id int, active long, dead long, occupied long")
    r = statistics.refreshed_counters(blob, stored).first()
    assert (r["active_blobs"], r["tombstones"], r["repair"]) == (7, 3, True)


def test_compaction_counts_headers_and_footers(spark):
    shard = spark.createDataFrame([(5, s, 1) for s in range(4)], "chunk_id long, shard_id long, state int")
    half = spark.createDataFrame([(s, 3, b % 2 == 0) for s in range(4) for b in range(40)], "shard_id long, blk_count long, is_tombstone boolean")
    r = compaction.plan(shard, half).first()
    assert (r["blobs"], r["copied_blks"]) == (80, 80 * 3 + 2 * 4)
    r = compaction.plan(shard, half.withColumn("is_tombstone", F.lit(True))).first()
    assert (r["blobs"], r["copied_blks"]) == (0, 0)
    r = compaction.plan(shard.withColumn("state", F.when(F.col("shard_id") == 3, 0).otherwise(1)), half.withColumn("is_tombstone", F.lit(True))).first()
    assert (r["headers"], r["footers"]) == (1, 0)


def test_batches_stop_after_the_blob_that_fills_them(spark):
    blob = spark.createDataFrame([(1, n, s, False) for n, s in enumerate([10, 10, 30, 5, 20, 1])] + [(2, 0, 100, False), (2, 1, 1, True)], "shard_id long, blob_id long, size long, is_tombstone boolean")
    got = {(r["shard_id"], r["blob_id"]): r["batch"] for r in snapshot.batches(blob, 25).collect()}
    assert got == {(1, 0): 0, (1, 1): 0, (1, 2): 0, (1, 3): 1, (1, 4): 1, (1, 5): 2, (2, 0): 0, (2, 1): 1}
    assert {(r["shard_id"], r["batch_id"]): r["is_last_batch"] for r in snapshot.export_batches(blob, 25).collect()} == {(1, 1): False, (1, 2): False, (1, 3): True, (2, 1): True}


def test_bins(spark):
    df = spark.createDataFrame([(1, n, s) for n, s in enumerate([3, 4, 9, 20, 2, 8, 1])], "g long, i long, n long")
    assert [r["bin"] for r in snapshot.bins(df, "g", "i", "n", 10).orderBy("item").collect()] == [0, 0, 1, 2, 3, 3, 4]


def test_snapshot_cut(spark):
    shard = spark.createDataFrame([(g, 10 * g + n, n % 2, n, int(g == 2 or n != 4)) for g in (1, 2, 3) for n in range(1, 5)], "pg_id int, shard_id long, chunk_id long, lsn long, state int")
    places = spark.createDataFrame([(g, c, 1 - c) for g in (1, 2, 3) for c in (0, 1)], "pg_id int, chunk_id long, v_chunk_id long")
    assert {tuple(r) for r in snapshot.snapshot_cuts(shard).collect()} == {(1, 3), (2, 4), (3, 3)}
    cuts = spark.createDataFrame([(1, 3), (2, 4), (3, 0)], "pg_id int, upto long")
    got = {(r["pg_id"], r["position"]): r["shard_id"] for r in snapshot.exported_shards(shard, places, cuts).collect()}
    assert got == {(1, 1): 11, (1, 2): 13, (1, 3): 12, (2, 1): 21, (2, 2): 23, (2, 3): 22, (2, 4): 24}


def test_checksums(spark):
    df = spark.createDataFrame([(1, bytearray(b"123456789"))], "blob_id long, body binary")
    assert df.select(integrity.checksum(F.col("body"))).first()[0] == zlib.crc32(b"123456789") == 0xCBF43926


def test_ranged_reads(spark):
    payload = spark.createDataFrame([(1, 1, bytearray(b"0123456789"), "k", 42)], "shard_id long, blob_id long, body binary, user_key string, object_off long")
    asked = spark.createDataFrame([(1, 1, 2, 3, False), (1, 1, 4, 0, False), (1, 1, 5, 6, False), (1, 2, 0, 0, False), (1, 1, 2, 3, True)], "shard_id long, blob_id long, off long, len long, skip_verify boolean")
    got = [(r["status"], bytes(r["body"]) if r["body"] is not None else None, r["partial"]) for r in reads.read_range(payload, asked).collect()]
    assert sorted(got, key=str) == sorted([("OK", b"234", False), ("OK", b"456789", False), ("INVALID_ARG", None, False), ("UNKNOWN_BLOB", None, False), ("OK", b"234", False)], key=str)


def test_index_layout(spark, tmp_path):
    from shardwise.sources.store import Store

    blob = Store(spark, "/root/testdata/sf0.001").blob
    files.write_index(blob, str(tmp_path / "index"))
    back = files.read_index(spark, str(tmp_path / "index"), 2)
    assert back.count() == blob.where("pg_id = 2").count()
    assert "PartitionFilters: [isnotnull(pg_id" in back._jdf.queryExecution().toString() or "pg_id" in back._jdf.queryExecution().toString()
