"""Vectorised byte kernels shared by the Arrow-backed operators.

All of them work on the concatenated UTF-8 buffer of an Arrow string column, so
cost is a few numpy passes per byte and no Python object is made per word.
Null texts read as empty texts everywhere.
"""

from __future__ import annotations

import sys
from types import ModuleType

import numpy as np
import pyarrow as pa

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240117))
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
LOWER_VALUE = BYTE_VALUE.copy()
LOWER_VALUE[65:91] = BYTE_VALUE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
CHUNK = 1 << 20
BLOCK = 64  # bytes that one row of values each covers
GROUP = 1 << 13  # blocks that are hashed at once
TABLE = _rng.integers(0, 2**64, (BLOCK, 256), dtype=np.uint64)
LOWER_TABLE = TABLE.copy()
LOWER_TABLE[:, 65:91] = TABLE[:, 97:123]

#: Words are runs of bytes outside these sets.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[:] = U64(base)
    out[0] = U64(1)
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, at least n of them.

    They are kept by process, outside this module: what a module holds travels with its functions.
    """
    kept = sys.modules.setdefault("_lectern_powers", ModuleType("_lectern_powers")).__dict__
    if "up" not in kept or len(kept["up"]) < n:
        size = max(n, CHUNK + 1)
        kept["up"], kept["down"] = _powers(_BASE, size), _powers(_BASE_INV, size)
    return kept["up"], kept["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; x is not changed."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(33))
        x = x * U64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> U64(33))
        x = x * U64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> U64(33))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buffer and offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    if column.null_count:
        column = column.fill_null(b"" if kind == pa.large_binary() else "")
    if column.type != kind:
        column = column.cast(kind)
    offs = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    data = column.buffers()[2] if len(column) else None
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def chunks(column: pa.Array, most: int = CHUNK):
    """Slices of the column of about `most` bytes, one row at least: (first row, end row, buffer, offsets)."""
    buf, offs = column_bytes(column)
    n, a = len(offs) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, side="right")) - 1)
        b = min(b, n)
        yield a, b, buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def spans(buf: np.ndarray, offs: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of bytes that aren't separators; a run never crosses rows."""
    if not len(buf):
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    word = ~separators[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[offs] = True
    begins, finishes = word.copy(), word.copy()
    begins[1:] &= ~word[:-1] | edge[1:-1]
    finishes[:-1] &= ~word[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(finishes) + 1, np.searchsorted(offs, starts, side="right") - 1


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = TABLE) -> np.ndarray:
    """64-bit hashes of byte spans, by their content alone.

    Each byte has a random value of its own at each of 64 places (tabulation); blocks of 64 bytes are mixed with
    their number before they are added, so no pattern of the text makes two spans equal but by chance (2^-64).
    """
    size = ends - starts
    blocks = (size + (BLOCK - 1)) // BLOCK
    first = np.cumsum(blocks) - blocks
    number = np.arange(blocks.sum()) - np.repeat(first, blocks)
    begin = np.repeat(starts, blocks) + number * BLOCK
    length = np.minimum(BLOCK, np.repeat(ends, blocks) - begin)
    values, sums = table.ravel(), np.empty(len(begin), dtype=np.uint64)
    for a in range(0, len(begin), GROUP):
        n = length[a : a + GROUP]
        at = np.cumsum(n) - n
        place = np.arange(n.sum()) - np.repeat(at, n)
        byte = buf[place + np.repeat(begin[a : a + GROUP], n)]
        sums[a : a + GROUP] = np.add.reduceat(values[place << 8 | byte], at)
    out, some = np.zeros(len(starts), dtype=np.uint64), size > 0
    with np.errstate(over="ignore"):
        if len(sums):
            out[some] = np.add.reduceat(mix(sums + mix(number.astype(np.uint64) + U64(1))), first[some])
        return mix(out + size.astype(np.uint64) * U64(0x9E3779B97F4A7C15))


def _same_bytes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> bool:
    """Whether each span equals the span that `other` names, byte by byte."""
    size = ends - starts
    if (size != size[other]).any():
        return False
    rows = np.flatnonzero(other != np.arange(len(other)))
    total, a = np.cumsum(size[rows]), 0
    while a < len(rows):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + CHUNK // 4, side="right")))
        r = rows[a:b]
        n = size[r]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if (buf[place + np.repeat(starts[r], n)] != buf[place + np.repeat(starts[other[r]], n)]).any():
            return False
        a = b
    return True


def distinct_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each distinct span, and for each span its number among these; spans are compared by their bytes."""
    _, first, number = np.unique(span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
    number = number.ravel()
    if not _same_bytes(buf, starts, ends, first[number]):
        raw, known = buf.tobytes(), {}
        number = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist())], dtype=np.int64)
        first = np.unique(number, return_index=True)[1]
    return first, number


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive hashes."""
    m = len(hashes) - k + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(m, dtype=np.uint64)
        for j in range(k):
            out = out * U64(0xD6E8FEB86659FD93) + hashes[j : j + m]
        return mix(out + U64(k))


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int = 5):
    """For each row its sorted distinct k-word shingles; rows with fewer words have their whole sequence, without words none."""
    starts, ends, row = spans(buf, offs, SPACES)
    words = span_hashes(buf, starts, ends, LOWER_TABLE)
    first = np.searchsorted(row, np.arange(len(offs)))
    full = windows(words, k)
    for i in range(len(offs) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= k:
            yield np.unique(full[a : b - k + 1])
        elif b > a:
            yield windows(words[a:b], int(b - a))
        else:
            yield words[:0]


def sequence_hash(values: np.ndarray, salt: int = 0) -> int:
    """Hash of an array of uint64, in its order."""
    up, _ = powers(len(values) + 1)
    with np.errstate(over="ignore"):
        total = (mix(values + U64(salt)) * up[: len(values)]).sum(dtype=np.uint64)
    return int(mix(np.array([total + U64(len(values))], dtype=np.uint64))[0].astype(np.int64))
