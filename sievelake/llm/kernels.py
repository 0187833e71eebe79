"""Vectorised token kernels over Arrow string batches.

Every function works on one contiguous UTF-8 buffer that holds the texts of a batch, so the cost per
word is a few numpy passes and no Python object is made per word.  Whole texts are processed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
#: A random 64-bit value per byte, folded into the polynomial word hash.
BYTE_MIX = _RNG.integers(1, 2**63 - 1, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)

#: Bytes that belong to a word: ASCII letters and digits and every byte of a multi-byte character.
WORD_BYTE = np.zeros(256, dtype=bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    WORD_BYTE[_lo:_hi] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
FOLDED_MIX = BYTE_MIX[_FOLD]

SPACE_BYTE = np.zeros(256, dtype=bool)
SPACE_BYTE[[9, 10, 11, 12, 13, 32]] = True

#: Bytes handled at once by the kernels; it bounds their temporaries, not what they process.
SLICE_BYTES = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_pow_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _pow_cache:
        _pow_cache.clear()
        with np.errstate(over="ignore"):
            up = np.full(size, _BASE, dtype=np.uint64)
            up[0] = 1
            down = np.full(size, _BASE_INV, dtype=np.uint64)
            down[0] = 1
            _pow_cache[size] = np.cumprod(up), np.cumprod(down)
    return _pow_cache[size]


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of n + 1 texts) of an Arrow string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges [a, b) of at most ``limit`` bytes each, or of one row where that row alone is longer."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray = WORD_BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every maximal run of ``member`` bytes; runs never cross a text's border."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = member[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(offsets, start, "right") - 1


def spans(data: np.ndarray, mixer: np.ndarray = FOLDED_MIX):
    """A function of (start, end) that hashes byte spans of ``data`` to 64 bits, from prefix sums of a polynomial over 2**64."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(mixer[data] * up[: len(data)], out=total[1:])

    def hashed(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))

    return hashed


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, mixer: np.ndarray = FOLDED_MIX) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    return spans(data, mixer)(start, end)


_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingles(hashes: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, position of its first word) of every run of ``width`` words within one row."""
    n = len(hashes) - width + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z
    with np.errstate(over="ignore"):
        h = np.zeros(n, dtype=np.uint64)
        for k in range(width):
            h = h * _STEP + hashes[k : n + k]
        keep = np.flatnonzero(row[:n] == row[width - 1 :])
        return mix64(h[keep]), row[keep], keep


def row_bounds(row: np.ndarray, n: int) -> np.ndarray:
    """Offsets into a row-sorted array for each of n rows."""
    return np.searchsorted(row, np.arange(n + 1))


def sorted_leaders(batches):
    """For sorted (key, node): (key, node, smallest node of the key) wherever a key has two nodes or more."""
    names = ["key", "node", "leader"]
    held = None  # the last row waits for its successor, which says whether it is alone
    carry = None  # (key, leader) of the held row, if it is known not to be

    def marked(key, node):
        begin = np.r_[True, key[1:] != key[:-1]]
        leader = node[np.maximum.accumulate(np.where(begin, np.arange(len(key)), 0))]
        many = np.r_[~begin[1:], False] | ~begin
        if carry is not None and carry[0] == key[0]:
            same = key == key[0]
            leader[same], many[same] = carry[1], True
        return leader, many

    def emitted(key, node, leader, many):
        keep = np.flatnonzero(many)
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, node, leader)], names)

    for batch in batches:
        if batch.num_rows:
            key, node = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "node"))
            if held is not None:
                key, node = np.r_[held[0], key], np.r_[held[1], node]
            leader, many = marked(key, node)
            if len(key) > 1:
                yield emitted(key[:-1], node[:-1], leader[:-1], many[:-1])
            held, carry = (key[-1:], node[-1:]), (key[-1], leader[-1]) if many[-1] else None
    if held is not None:
        yield emitted(*held, *marked(*held))
