"""Vectorised helpers on Arrow text columns, for use inside ``mapInArrow``.

A column of texts is one buffer of UTF-8 bytes with offsets, so words, hashes
and counts of many documents are computed at once with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one step works on; a longer single document is one step of its own.
SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Tables(dict):
    """Tables that each process computes for itself: functions that are sent to the executors take them along empty."""

    def __reduce__(self):
        return Tables, ()


_powers = Tables()

#: White space as bytes: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values (the splitmix64 finisher)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(kind: str, n: int) -> np.ndarray:
    """The first n powers of the hash base ("up") or of its inverse ("down")."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 18, 0 if have is None else 3 * len(have) // 2), _BASE if kind == "up" else _BASE_INVERSE, np.uint64)
        have[0] = 1
        _powers[kind] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of each text and of the end); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), ends - ends[0]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of each run of bytes that aren't in ``breaks``; runs end with their text."""
    inside = np.zeros(len(data) + 1, bool)
    np.logical_not(breaks[data], out=inside[:-1])
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    first[inner] = inside[inner]
    starts = np.flatnonzero(first)
    last = inside[:-1] & ~inside[1:]
    cut = inner[inner > 0] - 1
    last[cut] = inside[cut]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span values[start:end]; equal spans have equal hashes wherever they stand."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers("up", len(values)), out=sums[1:], dtype=np.uint64)
    return mix((sums[ends] - sums[starts]) * powers("down", len(values) + 1)[starts])


def run_starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of keys begins, in arrays sorted by them."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each of many runs, one after the other."""
    total = np.cumsum(counts)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(starts - (total - counts), counts)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """An Arrow list column: row i holds values[bounds[i]:bounds[i + 1]]."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))
