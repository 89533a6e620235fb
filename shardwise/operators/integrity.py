"""Checks of stored blobs: header, owner, checksum, delete marker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardwise.functions import scalars as S

# Fixed values of the stored header.
VERSION = 2
#: How a deleted blob's body begins; this library's own choice.
DELETE_MARKER = b"deleted-blob"


def checksum(body: Column) -> Column:
    """The reflected CRC-32, which the JVM computes."""
    return F.crc32(body)


def header_valid(version: Column, key: Column) -> Column:
    return (version <= VERSION) & (F.octet_length(key) <= S.MAX_KEY_BYTES)


def is_delete_marker(body: Column) -> Column:
    return F.startswith(body, F.lit(DELETE_MARKER))


def verify(read: DataFrame) -> DataFrame:
    """(…, verified) of rows with body, hash, shard_id, header_shard_id, blob_id, header_blob_id, version and user_key; an expected blob id of 0 is not compared."""
    ok = (
        header_valid(F.col("version"), F.col("user_key"))
        & (F.col("shard_id") == F.col("header_shard_id"))
        & ((F.col("blob_id") == 0) | (F.col("blob_id") == F.col("header_blob_id")))
        & (checksum(F.col("body")) == F.col("hash"))
        & ~is_delete_marker(F.col("body"))
    )
    return read.withColumn("verified", F.coalesce(ok, F.lit(False)))
