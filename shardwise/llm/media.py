"""Media columns: MPEG transport streams in a binary column.

`mux` stores a payload as an elementary stream of a transport stream: a program association table,
a program map table, then one PES packet per access unit, each with a presentation timestamp, and a
clock reference with the random-access mark on the first unit of each group. `parse_stream` reads
stored bytes back: it parses the program tables, checks continuity counters, reassembles PES packets
and lists every access unit with its timestamps and random-access mark.

Defined results: a null or empty payload is stored as one row of spaces (see `padded`); bytes without a
sync byte at a packet's place are counted as lost packets and skipped; a stream without tables has
no programs and no units; a repeated packet (same counter twice) counts once; equal payloads give
equal streams. Only the named id and payload columns are read, so extra columns of any name do no
harm, and an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwise.llm.bytetext import sliced

# Fixed values of the transport stream format.
PACKET = 188
SYNC = 0x47
PAT_PID = 0
PMT_PID = 0x1000
STREAM_PID = 0x100
PRIVATE_DATA = 0x06
STREAM_ID = 0xBD
CLOCK = 90_000
PES_HEADER = 14

#: Payload rows of 192 bytes in one access unit, units a second, and units from one random-access point to the next.
ROW, ROWS_PER_UNIT, UNITS_PER_SECOND, GROUP = 192, 16, 25, 4


@lru_cache(1024)
def crc32_mpeg(data: bytes) -> int:
    """The checksum of program tables: polynomial 04C11DB7, most significant bit first, no final inversion."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def _table(pid: int, table_id: int, number: int, body: bytes) -> bytes:
    section = bytes([table_id, 0xB0, len(body) + 9]) + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    section += crc32_mpeg(section).to_bytes(4, "big")
    packet = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section
    return packet + b"\xff" * (PACKET - len(packet))


_TABLES = _table(PAT_PID, 0x00, 1, b"\x00\x01" + (0xE000 | PMT_PID).to_bytes(2, "big")) + _table(
    PMT_PID, 0x02, 1, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00"
)


def _stamp(prefix: int, pts: np.ndarray) -> np.ndarray:
    """The five bytes of a 33-bit timestamp."""
    pts = pts.astype(np.int64)
    return np.stack([prefix << 4 | (pts >> 30 & 7) << 1 | 1, pts >> 22 & 255, (pts >> 15 & 127) << 1 | 1, pts >> 7 & 255, (pts & 127) << 1 | 1], 1).astype(np.uint8)


def _units(data: np.ndarray, first: int, counter: int) -> np.ndarray:
    """Packets of access units of one size, given as the rows of `data`; `first` is the first unit's number, `counter` the packets before."""
    count, size = data.shape
    numbers = np.arange(first, first + count)
    pts = numbers * (CLOCK // UNITS_PER_SECOND) & (1 << 33) - 1
    pes = np.empty((count, PES_HEADER + size), dtype=np.uint8)
    pes[:, :4] = (0, 0, 1, STREAM_ID)
    length = size + PES_HEADER - 6
    pes[:, 4], pes[:, 5] = (length >> 8, length & 255) if length < 65536 else (0, 0)
    pes[:, 6:9] = (0x84, 0x80, 5)
    pes[:, 9:14] = _stamp(2, pts)
    pes[:, 14:] = data
    total = pes.shape[1]
    first_room = PACKET - 4 - 8
    packets = 1 + max(0, -(-(total - first_room) // (PACKET - 4)))
    out = np.full((count, packets, PACKET), 0xFF, dtype=np.uint8)
    out[:, :, 0] = SYNC
    out[:, :, 1], out[:, :, 2] = STREAM_PID >> 8, STREAM_PID & 255
    out[:, 0, 1] |= 0x40
    counters = (counter + np.arange(count * packets)).reshape(count, packets) & 15
    out[:, :, 3] = 0x10 | counters
    out[:, 0, 3] |= 0x20
    start = PACKET - min(first_room, total)
    out[:, 0, 4] = start - 5
    out[:, 0, 5] = np.where(numbers % GROUP == 0, 0x50, 0x10)
    out[:, 0, 6:10] = np.stack([pts >> 25 & 255, pts >> 17 & 255, pts >> 9 & 255, pts >> 1 & 255], 1)
    out[:, 0, 10] = (pts & 1) << 7 | 0x7E
    out[:, 0, 11] = 0
    used = PACKET - start
    out[:, 0, start:] = pes[:, :used]
    whole = (total - used) // (PACKET - 4)
    if whole:
        out[:, 1 : 1 + whole, 4:] = pes[:, used : used + whole * (PACKET - 4)].reshape(count, whole, PACKET - 4)
    rest = total - used - whole * (PACKET - 4)
    if rest:
        out[:, -1, 3] |= 0x20
        stuffing = PACKET - 4 - rest
        out[:, -1, 4] = stuffing - 1
        if stuffing > 1:
            out[:, -1, 5] = 0
        out[:, -1, PACKET - rest :] = pes[:, total - rest :]
    return out.reshape(-1, PACKET)


def mux(payload: np.ndarray) -> bytes:
    """The transport stream of a payload of at least one byte."""
    unit = ROW * ROWS_PER_UNIT
    whole = len(payload) // unit
    parts = [_TABLES]
    packets = 0
    if whole:
        made = _units(payload[: whole * unit].reshape(whole, unit), 0, 0)
        packets = len(made)
        parts.append(made.tobytes())
    if len(payload) % unit:
        parts.append(_units(payload[whole * unit :].reshape(1, -1), whole, packets).tobytes())
    return b"".join(parts)


@dataclass
class Stream:
    """What a transport stream holds. `units` has, for each PES packet in order: program, PID, offset and size in the payload, PTS, DTS, random access."""

    programs: list[tuple[int, int, int, int]] = field(default_factory=list)  # program, PMT PID, stream type, PID
    packets: int = 0
    lost: int = 0
    continuity_errors: int = 0
    bad_tables: int = 0
    payload: bytes = b""
    units: list[tuple[int, int, int, int, int | None, int | None, bool]] = field(default_factory=list)


def _section(packets: np.ndarray, starts: np.ndarray, stream: Stream) -> bytes | None:
    """The first whole section on a table's PID, if its checksum is right."""
    for packet, start in zip(packets, starts, strict=True):
        if not packet[1] & 0x40 or start >= PACKET:
            continue
        data = packet[start + 1 + packet[start] :].tobytes()
        if len(data) >= 3 and (size := 3 + ((data[1] & 15) << 8 | data[2])) <= len(data):
            if crc32_mpeg(data[:size]) == 0:
                return data[:size]
            stream.bad_tables += 1
    return None


def _timestamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def parse_stream(media: bytes) -> Stream:
    """Reads a stored stream; see the module's text for what broken input gives."""
    stream = Stream()
    stream.packets = len(media) // PACKET
    all_packets = np.frombuffer(media, dtype=np.uint8, count=stream.packets * PACKET).reshape(-1, PACKET)
    synced = all_packets[:, 0] == SYNC
    stream.lost = int(stream.packets - synced.sum())
    p = all_packets[synced]
    if not len(p):
        return stream
    pids = (p[:, 1].astype(np.int64) & 31) << 8 | p[:, 2]
    adapted, loaded = (p[:, 3] & 0x20) > 0, (p[:, 3] & 0x10) > 0
    starts = np.where(adapted, 5 + p[:, 4].astype(np.int64), 4)
    flags = np.where(adapted & (p[:, 4] > 0), p[:, 5], 0)
    at = np.flatnonzero((pids == PAT_PID) & loaded)
    pat = _section(p[at], starts[at], stream)
    streams: list[tuple[int, int]] = []
    for k in range(8, len(pat) - 4, 4) if pat else ():
        number, pmt_pid = pat[k] << 8 | pat[k + 1], (pat[k + 2] & 31) << 8 | pat[k + 3]
        at = np.flatnonzero((pids == pmt_pid) & loaded)
        pmt = _section(p[at], starts[at], stream) if number else None
        k = 12 + ((pmt[10] & 15) << 8 | pmt[11]) if pmt else 0
        while pmt and k + 5 <= len(pmt) - 4:
            pid = (pmt[k + 1] & 31) << 8 | pmt[k + 2]
            stream.programs.append((number, pmt_pid, pmt[k], pid))
            streams.append((number, pid))
            k += 5 + ((pmt[k + 3] & 15) << 8 | pmt[k + 4])
    parts, base = [], 0
    for number, pid in streams:
        at = np.flatnonzero((pids == pid) & loaded)
        if not len(at):
            continue
        counters = (p[at, 3] & 15).astype(np.int64)
        step = np.diff(counters) & 15
        again = np.concatenate([[False], step == 0])
        stream.continuity_errors += int(((step > 1) & (flags[at[1:]] & 0x80 == 0)).sum())
        at = at[~again]
        q, start, first = p[at], starts[at].copy(), np.flatnonzero(p[at, 1] & 0x40)
        heads = []
        for k in first.tolist():
            s = int(start[k])
            head = q[k, s : s + 19].tobytes()
            if len(head) >= 9 and head[:3] == b"\0\0\1":
                kind = head[7] >> 6
                pts = _timestamp(head[9:14]) if kind & 2 and len(head) >= 14 else None
                dts = _timestamp(head[14:19]) if kind == 3 and len(head) >= 19 else pts
                heads.append((k, pts, dts, bool(flags[at[k]] & 0x40)))
                start[k] = min(PACKET, s + 9 + head[8])
        if not heads:
            continue
        start[: heads[0][0]] = PACKET
        parts.append(q[np.arange(PACKET) >= start[:, None]].tobytes())
        ends = np.concatenate([[0], np.cumsum(PACKET - np.minimum(start, PACKET))])
        stops = [*(int(ends[h[0]]) for h in heads[1:]), int(ends[-1])]
        stream.units += [(number, pid, base + int(ends[k]), stop - int(ends[k]), pts, dts, mark) for (k, pts, dts, mark), stop in zip(heads, stops, strict=True)]
        base += len(parts[-1])
    stream.payload = b"".join(parts)
    return stream


def padded(raw: np.ndarray, row: int = ROW) -> np.ndarray:
    """Appends spaces up to a positive multiple of `row` bytes."""
    out = np.full(max(1, -(-len(raw) // row)) * row, 32, dtype=np.uint8)
    out[: len(raw)] = raw
    return out


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media) with each text's UTF-8 bytes, padded, as a transport stream."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_col):
            raws = [np.frombuffer((t or "").encode(), dtype=np.uint8) for t in batch.column(1).to_pylist()]
            media = [mux(padded(r)) for r in raws]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in raws], pa.int64()), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "media"])

    return df.select(id_col, text_col).mapInArrow(store, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_bytes bigint, media binary")


_PARSED = "programs array<struct<program:int,table_pid:int,stream_type:int,pid:int>>, n_packets bigint, n_lost bigint, n_continuity_errors bigint, n_bad_tables bigint, payload binary, units array<struct<program:int,pid:int,offset:bigint,size:bigint,pts:bigint,dts:bigint,random_access:boolean>>"


def parse_column(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id, programs, packet counts, payload, units) of each stored stream; a null stream counts as empty."""
    programs = pa.list_(pa.struct([(n, pa.int32()) for n in ("program", "table_pid", "stream_type", "pid")]))
    units = pa.list_(pa.struct([("program", pa.int32()), ("pid", pa.int32()), ("offset", pa.int64()), ("size", pa.int64()), ("pts", pa.int64()), ("dts", pa.int64()), ("random_access", pa.bool_())]))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, media_col):
            got = [parse_stream(m or b"") for m in batch.column(1).to_pylist()]
            columns = [
                batch.column(0),
                pa.array([[dict(zip(("program", "table_pid", "stream_type", "pid"), x, strict=True)) for x in s.programs] for s in got], programs),
                *(pa.array([getattr(s, k) for s in got], pa.int64()) for k in ("packets", "lost", "continuity_errors", "bad_tables")),
                pa.array([s.payload for s in got], pa.binary()),
                pa.array([[dict(zip(("program", "pid", "offset", "size", "pts", "dts", "random_access"), x, strict=True)) for x in s.units] for s in got], units),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "programs", "n_packets", "n_lost", "n_continuity_errors", "n_bad_tables", "payload", "units"])

    return df.select(id_col, media_col).mapInArrow(parse, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, {_PARSED}")


def digests(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests of `store_texts`' rows, all but the first two columns from the stored bytes read back."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "media"):
            got = [parse_stream(m or b"") for m in batch.column(2).to_pylist()]
            features = [
                f"programs={len(s.programs)};packets={s.packets};lost={s.lost};continuity_errors={s.continuity_errors};units={len(s.units)};"
                f"random_access={sum(u[6] for u in s.units)};first_pts={s.units[0][4] if s.units else ''};last_pts={s.units[-1][4] if s.units else ''}"
                for s in got
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([s.payload for s in got], pa.binary()), pa.array(features, pa.string())], names=[*batch.schema.names, "payload", "feature"])

    kind = stored.schema[id_col].dataType.simpleString()
    back = stored.select(id_col, "n_bytes", "media").mapInArrow(keep, f"`{id_col}` {kind}, n_bytes bigint, media binary, payload binary, feature string")
    return back.select(
        id_col,
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, greatest(octet_length(payload) - 15, 1), 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
