"""Vectorised helpers for ragged byte strings.

A column of texts arrives from Arrow as one contiguous UTF-8 buffer and an
offset array.  All helpers work on that pair, so no Python object is made per
word.  A *slice list* is a pair of arrays (start, end) of byte positions in a
buffer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Byte classes of the word separators [\x20\x09-\x0D].
SEP = np.zeros(256, dtype=bool)
SEP[[0x20, 9, 10, 11, 12, 13]] = True

#: Texts are worked on in runs of about this many bytes (a longer text is a run of its own).
CHUNK_BYTES = 1 << 20

_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_LOW = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def runs(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Split rows 0..n-1 into runs [a, b) of about `size` bytes each."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of each run of a text column."""
    data, offsets = texts_of(column)
    for a, b in runs(offsets, size):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def padded(data: np.ndarray) -> np.ndarray:
    """A copy with 8 zero bytes behind it, as `hash_slices` needs."""
    out = np.zeros(len(data) + 8, np.uint8)
    out[: len(data)] = data
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+: (start, end, row); no word spans two rows."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~SEP[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    first[edge] |= solid[edge]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    last[edge - 1] |= solid[edge - 1]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def hash_slices(buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, first eight bytes) of each slice of a `padded` buffer."""
    at8 = np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))
    length = end - start
    head = at8[start] & _LOW[np.minimum(length, 8)]
    h = (length.astype(np.uint64) * _K[0]) ^ (head * _K[1])
    h = mix(h)
    live = np.flatnonzero(length > 8)
    at = 8
    while len(live):
        word = at8[start[live] + at] & _LOW[np.minimum(length[live] - at, 8)]
        h[live] = mix(h[live] ^ (word * _K[1]))
        at += 8
        live = live[length[live] > at]
    return h, head


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(32))) * _K[3]
    h = (h ^ (h >> np.uint64(29))) * _K[2]
    return h ^ (h >> np.uint64(32))


def window_hash(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of k consecutive values; len(h) - k + 1 of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, (salt * 0x9E3779B97F4A7C15 + k) & ((1 << 64) - 1), np.uint64)
    odd = 0x2545F4914F6CDD1D + 2 * salt
    power = 1
    for i in range(k):
        power = power * odd & ((1 << 64) - 1)
        out += h[i : i + n] * np.uint64(power)
    return mix(out)


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenation of flat[start[i] : start[i] + length[i]]."""
    total = int(length.sum())
    if total == 0:
        return flat[:0]
    before = np.cumsum(length) - length
    return flat[np.repeat(start - before, length) + np.arange(total)]


def per_row(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Sum of values by row (rows 0..n-1), as int64."""
    return np.bincount(row, weights=values, minlength=n).astype(np.int64)


def counts(row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, minlength=n).astype(np.int64)


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask over n positions of those in a window [s, s + width)."""
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, starts, 1)
    np.add.at(delta, np.minimum(starts + width, n), -1)
    return np.cumsum(delta[:n]) > 0
