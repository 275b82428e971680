"""Vectorised scanning of whole texts straight from Arrow's UTF-8 buffers (numpy inside Spark tasks).

Words, lines and windows are found for a slice of rows at once; they are identified by 64-bit hashes that depend
on their bytes alone, so they agree between executors and runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_CODE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
BASE = 0x5851F42D4C957F2D
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text that are scanned at once: what is derived from them stays in the processor's caches.
CHUNK = 1 << 17


def byte_table(inside: str | bytes, complement: bool = False) -> np.ndarray:
    """A table of 256 booleans; ``complement`` gives every byte but these (non-ASCII bytes included)."""
    table = np.zeros(256, bool)
    table[list(inside.encode("ascii") if isinstance(inside, str) else inside)] = True
    return ~table if complement else table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: Words as runs of anything but ASCII white space.
SPACED = byte_table(SPACES, complement=True)
#: Words as runs of anything but ASCII outside 0-9 and a-z (for lower-cased text).
ALNUM = byte_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]), complement=True)
def window_factors(n: int) -> list[np.uint64]:
    """The weight of each word of a window of ``n``."""
    return [U(pow(0xD6E8FEB86659FD93, j, 1 << 64)) for j in range(n)]


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of BASE and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK + 4096)
        _POWERS[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(size - 1, b, U)])) for b in (BASE, BASE_INVERSE)]
    return _POWERS[0][:n], _POWERS[1][:n]


def slices(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Whole rows, about ``limit`` bytes at a time (one row at least): first row, end row, bytes, offsets. Null counts
    as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, where, what = column.buffers()
    offsets = np.frombuffer(where, wide)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(what, np.uint8) if what is not None else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield start, end, data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
        start = end


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The number of set flags of each row."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offsets[1:]] - total[offsets[:-1]]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of set bytes that stay in one row: starts, ends, rows."""
    edges = offsets[:-1][offsets[1:] > offsets[:-1]]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[edges] = False
    after[edges[1:] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(offsets, starts, "right") - 1


class Hasher:
    """Hashes of any byte ranges of one slice."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.concatenate([np.zeros(1, U), np.cumsum(BYTE_CODE[data] * up[:-1], dtype=U)])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(U))


def windows(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first word and the hash of every run of ``n`` consecutive words in a row."""
    if len(hashes) < n:
        return np.zeros(0, np.int64), np.zeros(0, U)
    total = np.zeros(len(hashes) - n + 1, U)
    for j, factor in enumerate(window_factors(n)):
        total += hashes[j : len(hashes) - n + 1 + j] * factor
    first = np.flatnonzero(rows[n - 1 :] == rows[: len(rows) - n + 1])
    return first, mix(total[first] + U(n))


def shingles(hashes: np.ndarray, rows: np.ndarray, n: int, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each window of ``n`` words; a row with fewer words, but some, has one window of all of them."""
    first, values = windows(hashes, rows, n)
    counts = np.bincount(rows, minlength=n_rows)
    begins = np.cumsum(counts) - counts
    all_rows, all_values = [rows[first]], [values]
    for m in range(1, n):
        short = np.flatnonzero(counts == m)
        if len(short):
            total = np.zeros(len(short), U)
            for j, factor in enumerate(window_factors(m)):
                total += hashes[begins[short] + j] * factor
            all_rows.append(short)
            all_values.append(mix(total + U(m)))
    return np.concatenate(all_rows), np.concatenate(all_values)


def within_rows(rows: np.ndarray, order: np.ndarray, n_rows: int) -> np.ndarray:
    """Bring an order of entries into rows, keeping it inside each row. Short row numbers sort by radix."""
    return order[np.argsort(rows[order].astype(np.uint16 if n_rows <= 1 << 16 else np.int64), kind="stable")]


def distinct(rows: np.ndarray, values: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in ascending order, with the row bounds."""
    order = within_rows(rows, np.argsort(values), n_rows)
    rows, values = rows[order], values[order]
    if len(rows):
        keep = np.concatenate([[True], (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])])
        rows, values = rows[keep], values[keep]
    return np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n_rows))]), values
