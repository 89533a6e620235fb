"""Identifiers, block arithmetic, masks and formats of the store as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the store.
BLOCK_BYTES = 4096
CHUNK_BYTES = 2 << 30
HEADER_BYTES = 4096
ALIGN_BYTES = 512
MAX_SHARD_BYTES = 1 << 30
MAX_META_BYTES = 1024
MAX_KEY_BYTES = 1024
SEQ_BITS = 48
OPEN, SEALED, DELETED = 0, 1, 2
AVAILABLE, IN_USE, GC = 0, 1, 2
ALIVE, DISK_DOWN = 0, 1
LEAF_FANOUT, INNER_FANOUT = 167, 125

_SEQ_SPAN = 1 << SEQ_BITS


def make_shard_id(pg_id: Column, seq: Column) -> Column:
    """pg_id in the upper 16 bits; groups from 32768 on give negative ids, see `unsigned`."""
    return F.shiftleft(pg_id.cast("long"), SEQ_BITS).bitwiseOR(seq.cast("long"))


def shard_seq(shard_id: Column) -> Column:
    return shard_id.bitwiseAND(F.lit(_SEQ_SPAN - 1))


def shard_pg(shard_id: Column) -> Column:
    return F.shiftrightunsigned(shard_id, SEQ_BITS).cast("int")


def unsigned(value: Column) -> Column:
    """A bigint's bits as an unsigned number."""
    wide = value.cast("decimal(20,0)")
    return F.when(value < 0, wide + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)")


def object_id(seq: Column, batch: Column) -> Column:
    """A snapshot message's id: the top bit, 48 bits of shard sequence, 15 bits of batch; null if one does not fit."""
    fits = seq.between(0, _SEQ_SPAN - 1) & batch.between(0, (1 << 15) - 1)
    wide = F.lit("9223372036854775808").cast("decimal(20,0)") + seq.cast("decimal(20,0)") * 32768 + batch
    return F.when(fits, wide.cast("decimal(20,0)"))


def alloc_hint(pg_id: Column, v_chunk: Column) -> Column:
    return F.shiftleft(pg_id.cast("long"), 16) + v_chunk


def round_up(size: Column, unit: int) -> Column:
    return (F.floor((size + (unit - 1)) / F.lit(unit)) * unit).cast("long")


def blob_blocks(size: Column) -> Column:
    """Blocks of a stored blob: its header and its body."""
    return (F.ceil(size / F.lit(BLOCK_BYTES)) + 1).cast("long")


def set_bits(state: Column, mask: int) -> Column:
    return state.bitwiseOR(F.lit(mask))


def clear_bits(state: Column, mask: int) -> Column:
    return state.bitwiseAND(F.lit(~mask))


def has_bits(state: Column, mask: int) -> Column:
    return state.bitwiseAND(F.lit(mask)) == mask


def route(shard_id: Column, blob_id: Column) -> Column:
    """Group, sequence and blob in hexadecimal."""
    return F.concat_ws(":", F.lpad(F.lower(F.hex(F.shiftrightunsigned(shard_id, SEQ_BITS))), 4, "0"), F.lpad(F.lower(F.hex(shard_seq(shard_id))), 12, "0"), F.lpad(F.lower(F.hex(blob_id)), 16, "0"))


def is_uuid(text: Column) -> Column:
    return text.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(done * 100 / total)).otherwise(F.lit(0)).cast("long")


def device(entry: Column) -> tuple[Column, Column]:
    """Path and type of a "path:TYPE" entry; other types, and none, are AUTO."""
    kind = F.upper(F.element_at(F.split(entry, ":"), 2))
    return F.element_at(F.split(entry, ":"), 1), F.when(kind.isin("HDD", "NVME"), kind).otherwise("AUTO")


def api_error(code: Column) -> Column:
    """A replication error's name to that of the API."""
    # Replication errors and what callers get.
    pairs = {"BAD_REQUEST": "INVALID_ARG", "CANCELLED": "SHUTTING_DOWN", "NOT_LEADER": "NOT_LEADER", "NO_SPACE_LEFT": "NO_SPACE_LEFT", "TIMEOUT": "TIMEOUT", "SERVER_NOT_FOUND": "UNKNOWN_PG"}
    table = F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))
    return F.coalesce(table[code], F.lit("UNKNOWN"))


def index_nodes(entries: Column) -> tuple[Column, Column]:
    """Leaves, and nodes of the three levels above, of an index of so many entries."""
    leaves = F.ceil(entries / F.lit(LEAF_FANOUT)).cast("long")
    upper, level = F.lit(0).cast("long"), leaves
    for _ in range(3):
        level = F.when(level > 1, F.ceil(level / F.lit(INNER_FANOUT))).otherwise(F.lit(0)).cast("long")
        upper = upper + level
    return leaves, upper
