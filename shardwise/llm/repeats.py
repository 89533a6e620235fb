"""Removes every byte covered by a long string that also starts anywhere else, by suffix arrays of small groups.

All windows of LENGTH bytes that occur twice must meet somewhere. Each window has an anchor, its run of GRAM bytes of
least hash (the leftmost of equals), so equal windows have equal anchors at equal distances. Consecutive windows with one anchor and
with distances in one stretch of `width` form a segment; its key is a hash of the bytes that all windows of
that stretch share, its content is the bytes its windows cover. Then:

1. Keys that occur once are done: their windows are unique. Where all segments of a key are equal, all their windows repeat; here
   equal 64-bit hashes of the bytes stand for equal bytes, and no suffix array is needed.
2. The distinct segments of every other key are brought together with their counts, many small keys in one batch, and a suffix array
   of the batch is built by linear grouping (see `suffixes`). A window repeats if its neighbour in the order has equal
   first LENGTH bytes, which are compared as bytes, or its segment occurs more than once.
3. A key of more than HOT distinct segments is not gathered: its segments are cut to a narrower width, whose keys hold more
   of the windows, and steps 1 to 3 run on the parts, where equal parts of many segments are compared as one. At width 1 the key is a hash of the whole window and nothing is left to compare, so the windows of a passage
   that more than HOT different surroundings share are found by hashes alone.

Scale: the first pass sends one short row for about a hundred bytes of text, counted before shuffles where keys are equal; texts
move by id to the few segments to be compared and once more for the result. Groups hold at most HOT segments of less than
2 * LENGTH bytes, so tasks have bounded memory whatever the corpus holds.

Defined results: a null text counts as empty; texts of fewer than LENGTH bytes lose nothing; windows never cross texts; a repeated
row is another place where its strings start, so both rows lose what they share; rows are told apart by two 64-bit hashes of id and text. An empty table
gives an empty table. Only the named columns are read. Texts of more than SLICE_BYTES are read in pieces
that overlap by LENGTH - 1 bytes, so a task needs a few times a piece, and the text itself, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwise.llm.bytetext import byte_codes, mix64, prefix_hash, range_hash, sliced, string_buffer
from shardwise.llm.near_dup import groups
from shardwise.llm.storage import gathered, settled
from shardwise.llm.suffixes import byte_suffix_order

LENGTH, GRAM = 400, 16
#: Widths of the stretches of distances to the anchor, by level.
WIDTHS = (192, 48, 12, 3, 1)
#: Distinct segments under one key from which it is cut to the next width; bytes of segments in one suffix array.
HOT, BATCH_BYTES = 4000, 1 << 18
SLICE_BYTES = 1 << 19


def anchors(raw: np.ndarray, prefix: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For each window start the place of its anchor, as if all of `raw` were one text."""
    grams = np.arange(len(raw) - gram + 1)
    values = range_hash(prefix, grams, grams + gram) & ~np.uint64((1 << 32) - 1) | grams.astype(np.uint64)
    width = length - gram + 1
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    rows = np.full((-(-len(values) // width), width), np.iinfo(np.uint64).max, dtype=np.uint64)
    rows.ravel()[: len(values)] = values
    upto = np.minimum.accumulate(rows, axis=1).ravel()
    since = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(since[:n], upto[width - 1 : width - 1 + n]) & np.uint64((1 << 32) - 1)).astype(np.int64)


def cut_segments(prefix: np.ndarray, start: np.ndarray, anchor: np.ndarray, breaks: np.ndarray, width: int, length: int) -> tuple[np.ndarray, ...]:
    """Segments of consecutive windows at `start` with one anchor and one stretch of distances: key, content hash, index of the first window, number of windows. `breaks` marks windows that must begin a segment."""
    stretch = (anchor - start) // width
    begins = breaks.copy()
    begins[1:] |= (anchor[1:] != anchor[:-1]) | (stretch[1:] != stretch[:-1])
    first = np.flatnonzero(begins)
    count = np.diff(np.append(first, len(start)))
    core = anchor[first] - stretch[first] * width
    key = mix64(range_hash(prefix, core, core - width + 1 + length) + stretch[first].astype(np.uint64) + np.uint64(width))
    content = mix64(range_hash(prefix, start[first], start[first] + count - 1 + length) + (anchor[first] - start[first]).astype(np.uint64))
    return key.view(np.int64), content.view(np.int64), first, count


def list_segments(df: DataFrame, length: int, gram: int, width: int) -> DataFrame:
    """(doc, twin, key, content, start, windows, reach) for the segments of each row of df (doc, twin, text), where doc and twin tell rows apart; `reach` is the first window's distance to the anchor."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE_BYTES):
            whole, bounds = string_buffer(batch.column(2))
            for piece in range(0, max(len(whole) - length + 1, 0), SLICE_BYTES) if batch.num_rows == 1 else (0,):
                raw, offsets = (whole[piece : piece + SLICE_BYTES + length - 1], None) if batch.num_rows == 1 else (whole, bounds)
                offsets = np.array([0, len(raw)]) if offsets is None else offsets
                counts = np.maximum(np.diff(offsets) - length + 1, 0)
                if not counts.sum():
                    continue
                prefix = prefix_hash(byte_codes(raw))
                row = np.repeat(np.arange(len(counts)), counts)
                at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                start = offsets[row] + at
                anchor = anchors(raw, prefix, length, gram)[start]
                key, content, first, windows = cut_segments(prefix, start, anchor, at == 0, width, length)
                owner = pa.array(row[first])
                columns = [batch.column(0).take(owner), batch.column(1).take(owner), pa.array(key), pa.array(content), pa.array((piece + at[first]).astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array((anchor - start)[first].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "twin", "key", "content", "start", "windows", "reach"])

    return df.select("doc", "twin", "text").mapInArrow(cut, "doc bigint, twin bigint, key bigint, content bigint, start int, windows int, reach int")


def recut(segments: DataFrame, width: int, length: int) -> DataFrame:
    """Cuts distinct segments (root_key, root_content, offset, times, reach, windows, data) to a narrower width."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "data", SLICE_BYTES):
            raw, offsets = string_buffer(batch.column(6))
            counts = batch.column(5).to_numpy().astype(np.int64)
            prefix = prefix_hash(byte_codes(raw))
            row = np.repeat(np.arange(len(counts)), counts)
            at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            start = offsets[row] + at
            anchor = (offsets[:-1] + batch.column(4).to_numpy())[row]
            key, content, first, windows = cut_segments(prefix, start, anchor, at == 0, width, length)
            owner = pa.array(row[first])
            data = [raw[a:b].tobytes() for a, b in zip(start[first], start[first] + windows - 1 + length, strict=True)]
            offset = batch.column(2).to_numpy()[row[first]] + at[first]
            columns = [batch.column(0).take(owner), batch.column(1).take(owner), pa.array(offset.astype(np.int32)), batch.column(3).take(owner), pa.array((anchor - start)[first].astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(data, pa.binary()), pa.array(key), pa.array(content)]
            yield pa.RecordBatch.from_arrays(columns, names=["root_key", "root_content", "offset", "times", "reach", "windows", "data", "key", "content"])

    return segments.select("root_key", "root_content", "offset", "times", "reach", "windows", "data").mapInArrow(
        cut, "root_key bigint, root_content bigint, offset int, times bigint, reach int, windows int, data binary, key bigint, content bigint"
    )


def equal_neighbours(raw: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place of `order` but the last whether it and the next have equal `length` bytes. Hashes tell most apart, bytes decide."""
    hashes = range_hash(prefix_hash(byte_codes(raw)), order, order + length)
    same = hashes[1:] == hashes[:-1]
    windows = np.lib.stride_tricks.sliding_window_view(raw, length) if len(raw) >= length else raw.reshape(-1, 1)
    likely = np.flatnonzero(same)
    for k in range(0, len(likely), 8192):
        some = likely[k : k + 8192]
        same[some] = (windows[order[some]] == windows[order[some + 1]]).all(axis=1)
    return same


def compare(segments: DataFrame, length: int) -> DataFrame:
    """(key, content, first, last): runs of repeating windows of each distinct segment (key, content, times, windows, data); all segments of a key get into one suffix array."""

    def judge(tables: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(tables).combine_chunks()
        raw, offsets = string_buffer(table.column("data"))
        windows = table.column("windows").to_numpy().astype(np.int64)
        order = byte_suffix_order(raw, offsets[1:])
        owner = np.searchsorted(offsets, order, side="right") - 1
        valid = order - offsets[owner] < windows[owner]
        order = order[valid]
        same = equal_neighbours(raw, order, length)
        repeats = np.zeros(len(raw) + 1, dtype=bool)
        repeats[order[1:][same]] = True
        repeats[order[:-1][same]] = True
        times = table.column("times").to_numpy()
        for k in np.flatnonzero(times > 1):
            repeats[offsets[k] : offsets[k] + windows[k]] = True
        edges = np.diff(np.concatenate([[0], repeats.astype(np.int8)]))
        begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        row = np.searchsorted(offsets, begin, side="right") - 1
        return pa.RecordBatch.from_arrays(
            [pa.array(table.column("key").to_numpy()[row]), pa.array(table.column("content").to_numpy()[row]), pa.array((begin - offsets[row]).astype(np.int32)), pa.array((end - 1 - offsets[row]).astype(np.int32))],
            names=["key", "content", "first", "last"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for g in groups(batches, 1):
            kept.append(g)
            size += int(g.column("windows").to_numpy().sum()) + g.num_rows * length
            if size >= BATCH_BYTES:
                yield judge(kept)
                kept, size = [], 0
        if kept:
            yield judge(kept)

    tasks = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, as a byte takes longer here than Spark assumes
    return gathered(segments.select("key", "content", "times", "windows", "data"), "key", partitions=tasks).mapInArrow(run, "key bigint, content bigint, first int, last int")


def _by_key(parts: DataFrame, times: str) -> DataFrame:
    """(key, mixed): keys with at least two places; mixed if their segments differ."""
    totals = parts.groupBy("key").agg(F.expr(f"sum({times})").alias("total"), F.min("content").alias("low"), F.max("content").alias("high"))
    return totals.where("total > 1").select("key", (F.col("low") < F.col("high")).alias("mixed"))


def repeated_spans(df: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc, twin, start, stop): spans of bytes to remove from each row of df (doc, twin, text), possibly overlapping."""
    rows = list_segments(df, length, gram, WIDTHS[0])
    rows = settled(rows.join(settled(_by_key(rows, "1")), "key"))  # of settled keys, so that Spark can split a hot one
    distinct = rows.where("mixed").groupBy("key", "content").agg(F.count("*").alias("times"), *(F.first(c).alias(c) for c in ("doc", "twin", "start", "windows", "reach")))
    size = F.col("windows") - 1 + length
    texts = df.select("doc", "twin", F.col("text").cast("binary").alias("body"))
    fetched = distinct.join(texts, ["doc", "twin"]).select("key", "content", "times", "windows", "reach", F.col("body").substr(F.col("start") + 1, size).alias("data"))
    level = settled(fetched.dropDuplicates(["key", "content"]))
    level = level.select("*", F.col("times").alias("total"), F.lit(True).alias("first_of"), F.col("key").alias("root_key"), F.col("content").alias("root_content"), F.lit(0).alias("offset"))
    found = []
    for width in WIDTHS[1:]:
        counted = level.join(level.groupBy("key").agg(F.count_if("first_of").alias("n")), "key")
        once = counted.where(F.col("first_of") & (F.col("n") <= hot))  # equal parts of many segments are compared as one
        runs = compare(once.select("key", "content", F.col("total").alias("times"), "windows", "data"), length)
        found.append(level.join(runs, ["key", "content"]).select("root_key", "root_content", (F.col("offset") + F.col("first")).alias("first"), (F.col("offset") + F.col("last")).alias("last")))
        crowded = settled(counted.where(F.col("n") > hot).select("root_key", "root_content", "offset", "times", "reach", "windows", "data"))
        if not crowded.take(1):
            break
        parts = settled(recut(crowded, width, length))
        parts = parts.join(settled(_by_key(parts, "times")), "key")
        whole = parts.where("NOT mixed")
        found.append(whole.select("root_key", "root_content", F.col("offset").alias("first"), (F.col("offset") + F.col("windows") - 1).alias("last")))
        merged = settled(parts.where("mixed").withColumn("place", F.xxhash64("root_key", "root_content", "offset")))
        totals = settled(merged.groupBy("key", "content").agg(F.sum("times").alias("total"), F.min("place").alias("least")))
        level = settled(merged.join(totals, ["key", "content"]).withColumn("first_of", F.col("place") == F.col("least")))
        level = level.select("key", "content", "times", "total", "first_of", "windows", "reach", "data", "root_key", "root_content", "offset")
    ranges = found[0]
    for more in found[1:]:
        ranges = ranges.unionByName(more)
    ranges = settled(ranges.distinct())
    mixed = rows.where("mixed").join(ranges.withColumnsRenamed({"root_key": "key", "root_content": "content"}), ["key", "content"])
    plain = rows.where("NOT mixed").select("doc", "twin", "start", (F.col("start") + size).alias("stop"))
    return plain.unionByName(mixed.select("doc", "twin", (F.col("start") + F.col("first")).alias("start"), (F.col("start") + F.col("last") + length).alias("stop")))


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[list[int], list[int]]:
    """The maximal runs that the spans from start to stop cover, in order."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    first = np.ones(len(start), dtype=bool)
    first[1:] = start[1:] > reach[:-1]
    last = np.append(first[1:], True)[: len(start)]
    return start[first].tolist(), reach[last].tolist()


def remove_repeats(df: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, spans array<struct<start, stop>>, kept binary) of each row: the maximal removed runs, and the bytes that stay."""
    told = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("doc"), F.xxhash64(text_col).alias("twin"))
    spans = repeated_spans(told, length, gram, hot).groupBy("doc", "twin").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    joined = told.join(spans, ["doc", "twin"], "left").select("id", "text", "spans")
    runs = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE_BYTES):
            raw, offsets = string_buffer(batch.column(1))
            listed, kept = [], []
            for k, own in enumerate(batch.column(2)):
                text = raw[offsets[k] : offsets[k + 1]]
                start, stop = merged(own.values.field(0).to_numpy(), own.values.field(1).to_numpy()) if own.is_valid else merged(np.zeros(0, int), np.zeros(0, int))
                kept.append(b"".join(text[a:b].tobytes() for a, b in zip([0, *stop], [*start, len(text)], strict=True)))
                listed.append([{"start": a, "stop": b} for a, b in zip(start, stop, strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(listed, runs), pa.array(kept, pa.binary())], names=[id_col, "n_bytes", "spans", "kept"])

    return joined.mapInArrow(remove, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_bytes bigint, spans array<struct<start:int,stop:int>>, kept binary")


def digests(removed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Byte counts, the number of removed runs, and a digest and the number of the bytes that stay."""
    stays = F.octet_length("kept").cast("long")
    return removed.select(id_col, "n_bytes", (F.col("n_bytes") - stays).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), stays.alias("n_kept"))
