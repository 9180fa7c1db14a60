"""Vectorised text kernels over Arrow string buffers: word bounds, word hashes, n-gram hashes.

All work on bytes of UTF-8. Lower-casing touches A-Z only, so every byte keeps
its place. Words never cross a row's end. Hashes are 64 bits wide.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; a longer text is taken alone.
BLOCK_BYTES = 1 << 20


def process_cache() -> dict:
    """What this process keeps between tasks (never pickled)."""
    return sys.__dict__.setdefault("_spanwise_cache", {})


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd 64-bit base and of its inverse, at least ``n`` of each; those that a block needs are kept."""
    kept = process_cache()
    if "powers" in kept and len(kept["powers"][0]) >= n:
        return kept["powers"]
    size = max(n, 2 * BLOCK_BYTES + 1)
    base = 0x9E3779B97F4A7C15
    pair = []
    for b in (base, pow(base, -1, 1 << 64)):
        seq = np.full(size, b, dtype=np.uint64)
        seq[0] = 1
        pair.append(np.multiply.accumulate(seq))
    if "powers" not in kept and size == 2 * BLOCK_BYTES + 1:
        kept["powers"] = tuple(pair)
    return tuple(pair)


def byte_values() -> np.ndarray:
    """A random 64-bit value for each byte; A-Z have those of a-z."""
    kept = process_cache()
    if "values" not in kept:
        order = np.arange(256, dtype=np.uint64)
        order[65:91] += np.uint64(32)
        kept["values"] = mix(order * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x1234567))
    return kept["values"]


def alnum_table() -> np.ndarray:
    """Word bytes: digits, letters, and all bytes above 0x7F."""
    t = np.zeros(256, dtype=bool)
    t[0x30:0x3A] = t[0x41:0x5B] = t[0x61:0x7B] = True
    t[0x80:] = True
    return t


def nonspace_table() -> np.ndarray:
    """Word bytes: all but space and 0x09 to 0x0D."""
    t = np.ones(256, dtype=bool)
    t[0x20] = False
    t[0x09:0x0E] = False
    return t


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = 0):
    """Yield (first row, rows, bytes, offsets) for runs of rows of about BLOCK_BYTES; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    limit, lo = limit or BLOCK_BYTES, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        yield lo, hi - lo, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi
    # Workers live on between tasks: give back what this batch took.
    pa.default_memory_pool().release_unused()


def word_bounds(buf: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each row the number of its first word (one entry more than rows)."""
    n = len(buf)
    if not n:
        empty = np.empty(0, np.int64)
        return empty, empty, np.zeros(len(offs), np.int64)
    inside = table[buf]
    edges = offs[(offs > 0) & (offs < n)]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[edges] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def running_sums(buf: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hashes() hashes any span of ``buf``."""
    sums = np.empty(len(buf) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(byte_values()[buf] * powers(len(buf) + 1)[0][: len(buf)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the (A-Z lower-cased) bytes of each span."""
    if not len(starts):
        return np.empty(0, np.uint64)
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts] + (ends - starts).astype(np.uint64))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each of ascending spans that don't overlap, in pieces of a block: a very long text takes no arrays of eight bytes a byte."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + BLOCK_BYTES)))
        lo = starts[i]
        out[i:j] = span_hashes(running_sums(buf[lo : ends[j - 1]]), starts[i:j] - lo, ends[i:j] - lo)
        i = j
    return out


def gram_hashes(words: np.ndarray, first: np.ndarray, steps: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the words at each place plus ``steps``, within a row: (hashes, row of each)."""
    reach = steps[-1]
    rows = np.repeat(np.arange(len(first) - 1), np.maximum(np.diff(first) - reach, 0))
    if not len(rows):
        return np.empty(0, np.uint64), rows
    left = np.diff(first)
    starts = first[:-1][left > reach]
    sizes = left[left > reach] - reach
    at = np.arange(len(rows)) + np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
    total = np.full(len(rows), np.uint64(len(steps) * 0x1000 + reach), np.uint64)
    for k in steps:
        total = total * np.uint64(0xD1342543DE82EF95) + words[at + k]
    return mix(total), rows


def as_list(values: np.ndarray, rows: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """Values grouped by ascending row as an Arrow list array of ``n`` rows."""
    offsets = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
