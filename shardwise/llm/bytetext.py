"""Vectorised byte-level text helpers shared by the operators of this subpackage.

Everything here works on the buffers of one Arrow string column inside a task: no Python
object is made per character or per word, and memory is bounded by slicing batches to a few
megabytes of text (a single longer text forms a slice of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

_PRIME = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_PRIME), -1, 1 << 64))
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every input bit over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * _PRIME)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_CODES = _BYTE_CODES[_LOWER]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of each."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 1 << 16)
        base, inverse = np.full(size, _PRIME), np.full(size, _INVERSE)
        base[0] = inverse[0] = 1
        powers, inverses = np.multiply.accumulate(base), np.multiply.accumulate(inverse)
        if size > 4 * SLICE_BYTES:
            return powers, inverses
        _powers, _inverses = powers, inverses
    return _powers, _inverses


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Prefix sums of codes[i] * base^i (modulo 2^64), with a leading zero."""
    powers, _ = _power_tables(len(codes) + 1)
    out = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * powers[: len(codes)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ranges [start, end): equal contents give equal values wherever they lie."""
    _, inverses = _power_tables(len(prefix))
    return mix64((prefix[end] - prefix[start]) * inverses[start] + (end - start).astype(np.uint64))


def byte_codes(raw: np.ndarray) -> np.ndarray:
    return _BYTE_CODES[raw]


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column and its n + 1 offsets; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, offsets - offsets[0]


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that each holds about `limit` bytes of `column`, or one longer row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = string_buffer(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased, split at bytes 9 to 13 and 32) and, for each text, its first word's index (n + 1 values)."""
    if not len(raw):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    inside = ~_SPACE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(raw)]
    begins[cuts] = inside[cuts]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = cuts[cuts > 0] - 1
    ends[last] = inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return range_hash(prefix_hash(_LOWER_CODES[raw]), start, end), np.searchsorted(start, offsets, side="left")


def ngram_hashes(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within a text, and their bounds by text (texts of fewer words have none)."""
    total = len(words) - n + 1
    counts = np.maximum(np.diff(bounds) - (n - 1), 0)
    out_bounds = np.concatenate([[0], np.cumsum(counts)])
    if total <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros_like(out_bounds)
    mixed = np.zeros(total, dtype=np.uint64)
    for k in range(n):
        mixed = mixed * _PRIME + words[k : k + total]
    first = np.repeat(bounds[:-1] - out_bounds[:-1], counts) + np.arange(out_bounds[-1])
    return mix64(mixed[first]), out_bounds


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles; the whole word sequence if it has fewer words, none without words."""
    words, bounds = word_hashes(raw, offsets)
    grams, gram_bounds = ngram_hashes(words, bounds, n)
    out = []
    for i in range(len(offsets) - 1):
        a, b = gram_bounds[i], gram_bounds[i + 1]
        if b > a:
            run = np.sort(grams[a:b])
            keep = np.ones(len(run), dtype=bool)
            np.not_equal(run[1:], run[:-1], out=keep[1:])
            out.append(run[keep])
        elif bounds[i + 1] > bounds[i]:
            value = np.array([bounds[i + 1] - bounds[i]], dtype=np.uint64)
            for k in range(bounds[i], bounds[i + 1]):
                value = mix64(value * _PRIME + words[k : k + 1])
            out.append(value)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
