"""Word hashing straight from Arrow buffers.

Words are maximal runs of bytes other than space and 0x09-0x0D, which is `[^\\x20\\x09-\\x0D]+` on the
text since every other character's UTF-8 bytes lie outside that range. A word's hash is a multilinear sum
of byte codes and place codes modulo 2**64, taken as a difference of prefix sums, then mixed; the place
codes are unrelated to one another, so no pattern of letters cancels as it does with powers of one base.
No Python object is made per word. Texts are hashed in pieces cut at word ends, so scratch memory does
not grow with a text's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
_U = np.uint64
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def codes(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit codes."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


_BYTE = codes(256, 7)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_places = np.zeros(0, np.uint64)


def _place_codes(n: int) -> np.ndarray:
    """Codes of the places 0..n-1 within a word."""
    global _places
    if len(_places) < n:
        _places = codes(max(n, 4096), 29)
    return _places


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and each row's offsets; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def _pieces(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of at most about PIECE_BYTES that begin and end outside words."""
    start, end = int(at[0]), int(at[-1])
    while start < end:
        stop = start + PIECE_BYTES
        if stop >= end:
            stop = end
        else:
            k = int(np.searchsorted(at, stop, "right")) - 1
            if at[k] > start:
                stop = int(at[k])
            else:
                stop = start + PIECE_BYTES
                last = int(at[k + 1])
                while stop < last:
                    space = np.flatnonzero(_IS_SPACE[data[stop : min(last, stop + 65536)]])
                    if len(space):
                        stop += int(space[0])
                        break
                    stop = min(last, stop + 65536)
        yield start, stop
        start = stop


def hash_words(data: np.ndarray, at: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each row (and past the last) the index of its first word."""
    return hash_spans(data, at, lower)[:2]


def hash_spans(data: np.ndarray, at: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As hash_words, and where each word begins and ends in `data`."""
    hashes, starts, stops = [], [], []
    table = _LOWER if lower else _BYTE
    with np.errstate(over="ignore"):
        for a, b in _pieces(data, at):
            piece = data[a:b]
            inside = ~_IS_SPACE[piece]
            edge = np.ones(len(piece) + 1, bool)
            edge[1:-1] = ~inside[:-1]
            rows = at[np.searchsorted(at, a) : np.searchsorted(at, b)] - a
            edge[rows] = True
            first = np.flatnonzero(inside & edge[:-1])
            following = np.ones(len(piece), bool)
            following[:-1] = ~inside[1:]
            following[rows[rows > 0] - 1] = True
            last = np.flatnonzero(inside & following)
            begun = np.zeros(len(piece), np.int32)
            begun[first] = first
            place = np.arange(len(piece), dtype=np.int32) - np.maximum.accumulate(begun)
            place[~inside] = 0
            value = table[piece] * _place_codes(int(place.max()) + 1)[place]
            total = np.cumsum(value, dtype=np.uint64)
            hashes.append(mix(total[last] - total[first] + value[first]))
            starts.append(first + a)
            stops.append(last + (a + 1))
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(begin, at), begin, np.concatenate(stops)


def window_hashes(hashes: np.ndarray, starts: np.ndarray, size: int, seed: int = 11) -> np.ndarray:
    """Hash of the `size` words from each start; starts + size must stay within hashes."""
    total = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for j, code in enumerate(codes(size, seed)):
            total += hashes[starts + j] * code
        return mix(total)


def row_slices(batch: pa.RecordBatch, column: str, max_bytes: int = 8 << 20, max_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Split a batch into runs of rows with a bounded amount of text (a longer row stands alone)."""
    _, at = text_buffer(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(at, at[start] + max_bytes, "right")) - 1
        stop = min(max(stop, start + 1), start + max_rows, batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop
