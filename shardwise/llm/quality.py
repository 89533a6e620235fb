"""Quality classifier by importance resampling.

Two generative models over hashed n-grams of bytes are compared: one of target text (labelled rows of
quality 1 that are not toxic), one of the raw corpus. A document's log weight is the log ratio of its n-grams under the two models,
whatever its length; Gumbel noise is added and the documents with the k largest sums are
kept. That draws k documents without replacement in proportion to their weights. k is the share of
quality-1 rows among the labelled ones, of all documents.

Scale: counts of the raw model cover every byte of every document; each task sends one row for each of its
non-empty buckets (at most BUCKETS). The models are BUCKETS numbers each on the driver and the executors. The target model
is fitted on at most TARGET_ROWS labelled rows, those of least hash. The k-th largest sum is
found by a radix search over counts, so nothing is sorted and one task never sees all documents.

Defined results: a null or empty text has no n-grams, log weight 0 and takes part like any other; documents that tie with
the k-th sum go by a hash of their ids, and only repeated rows of one id can tie in that too and are kept together; labels with nulls
are ignored and repeated labels count once; without target rows or labels all documents are kept; an empty
table gives an empty table. Only the named columns are read, so extra columns of any name do no harm.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardwise.llm.bytetext import mix64, sliced, string_buffer
from shardwise.llm.storage import settled

NGRAM = 4
BUCKETS = 1 << 18
#: Bound of the sample of labelled target rows that the target model is fitted on.
TARGET_ROWS = 20_000
#: Pseudo-counts of the raw model in the target model, as a share of the target's n-grams.
SMOOTHING = 1e-3


def gram_buckets(raw: np.ndarray, offsets: np.ndarray, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each run of n bytes within a text, and the runs' bounds by text."""
    counts = np.maximum(np.diff(offsets) - (n - 1), 0)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    if not bounds[-1]:
        return np.zeros(0, dtype=np.int64), bounds
    mixed = np.zeros(len(raw) - n + 1, dtype=np.uint64)
    for k in range(n):
        mixed = mixed * np.uint64(257) + raw[k : k + len(mixed)]
    buckets = (mix64(mixed) & np.uint64(BUCKETS - 1)).astype(np.int64)
    return buckets[np.repeat(offsets[:-1] - bounds[:-1], counts) + np.arange(bounds[-1])], bounds


def gram_counts(df: DataFrame, text_col: str, target_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts by bucket over all rows, and over the rows where the boolean target_col is true."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw_counts, target_counts = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for batch in sliced(batches, text_col):
            buckets, bounds = gram_buckets(*string_buffer(batch.column(0)))
            raw_counts += np.bincount(buckets, minlength=BUCKETS)
            chosen = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            if chosen.any():
                target_counts += np.bincount(buckets[np.repeat(chosen, np.diff(bounds))], minlength=BUCKETS)
        full = np.flatnonzero(raw_counts)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(raw_counts[full]), pa.array(target_counts[full])], names=["bucket", "raw", "target"])

    rows = df.select(text_col, target_col).mapInArrow(count, "bucket bigint, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw_counts, target_counts = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw_counts[rows["bucket"].to_numpy()], target_counts[rows["bucket"].to_numpy()] = rows["raw"].to_numpy(), rows["target"].to_numpy()
    return raw_counts, target_counts


def log_ratio(raw_counts: np.ndarray, target_counts: np.ndarray) -> np.ndarray:
    """Log of target over raw probability by bucket; 0 everywhere without target n-grams."""
    if not target_counts.sum():
        return np.zeros(len(raw_counts))
    raw = (raw_counts + 1) / (raw_counts.sum() + len(raw_counts))
    weight = SMOOTHING * target_counts.sum()
    return np.log((target_counts + weight * raw) / (target_counts.sum() + weight) / raw)


def weigh(df: DataFrame, ratio: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(id, n_grams, log_weight) of each row."""
    shipped = df.sparkSession.sparkContext.broadcast(ratio)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_col):
            buckets, bounds = gram_buckets(*string_buffer(batch.column(1)))
            sums = np.concatenate([[0.0], np.cumsum(shipped.value[buckets])])
            weights = sums[bounds[1:]] - sums[bounds[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds)), pa.array(np.round(weights, 6))], names=[id_col, "n_grams", "log_weight"])

    return df.select(id_col, text_col).mapInArrow(score, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_grams bigint, log_weight double")


def gumbel(id_col: str, seed: int = 8) -> Column:
    """Standard Gumbel noise that depends on the id and the seed alone."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(seed)), 12).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(-F.log(uniform))


def top_k(df: DataFrame, k: int, by: str, tie: str) -> DataFrame:
    """Adds `kept`: whether the row is among the k largest by the bigint columns `by`, then `tie`; rows that are equal in both are kept or not together. A radix search, four passes over counts of 16 bits each."""
    least = _kth_largest(df, k, by)
    if least is None:
        return df.withColumn("kept", F.lit(False))
    above, level = df.agg(F.count_if(F.col(by) > least), F.count_if(F.col(by) == least)).first()
    if above + level <= k:
        return df.withColumn("kept", F.col(by) >= least)
    last = _kth_largest(df.where(F.col(by) == least), k - above, tie)
    return df.withColumn("kept", (F.col(by) > least) | ((F.col(by) == least) & (F.col(tie) >= last)))


def _kth_largest(df: DataFrame, k: int, by: str) -> int | None:
    if k <= 0:
        return None
    prefix, left = 0, k
    shifted = F.col(by) + F.lit(0)
    flipped = shifted.bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order
    for level, shift in enumerate(range(48, -1, -16)):
        inside = df if not level else df.where(F.shiftrightunsigned(flipped, shift + 16) == F.lit(prefix))
        counts = {r["digit"]: r["n"] for r in inside.groupBy(F.shiftrightunsigned(flipped, shift).bitwiseAND(F.lit(0xFFFF)).alias("digit")).agg(F.count("*").alias("n")).collect()}
        for digit in sorted(counts, reverse=True):
            if counts[digit] >= left:
                break
            left -= counts[digit]
        else:
            return -(1 << 63)  # fewer than k rows: all are kept
        prefix = prefix << 16 | digit
    return prefix - (1 << 63)


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id") -> DataFrame:
    """(id, n_grams, log_weight, score, kept) of each row of df. `labels` has label_id, quality and toxic."""
    known = labels.where("quality IS NOT NULL").select(F.col(label_id).alias("label_id"), "quality", F.coalesce("toxic", F.lit(0)).alias("toxic")).where("label_id IS NOT NULL").distinct()
    good = known.where("quality = 1 AND toxic = 0").select("label_id").distinct()
    sample = good.orderBy(F.xxhash64("label_id"), "label_id").limit(TARGET_ROWS).withColumn("target", F.lit(True))
    flagged = df.select(id_col, text_col).join(F.broadcast(sample), F.col(id_col) == F.col("label_id"), "left").select(text_col, F.coalesce("target", F.lit(False)).alias("target"))
    scored = settled(weigh(df, log_ratio(*gram_counts(flagged, text_col, "target")), id_col, text_col).withColumn("score", F.round(F.col("log_weight") + gumbel(id_col), 6)))
    share = known.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    total = scored.count()
    k = total if share is None or not good.take(1) else math.ceil(share * total)
    ranked = scored.withColumns({"order_key": F.round(F.col("score") * 1e6).cast("long"), "tie_key": F.xxhash64(id_col)})
    return top_k(ranked, k, "order_key", "tie_key").drop("order_key", "tie_key")
