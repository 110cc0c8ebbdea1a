"""Words and rolling hashes of whole text columns, computed on Arrow buffers with numpy.

A word is a run of bytes other than space and 0x09-0x0D, which never splits a
UTF-8 sequence. Hashes are 64-bit and the same on every worker: a prefix sum of
random byte values times powers of an odd base, so the hash of any stretch is
one subtraction, finished by a mixing step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
# Bytes of text that are worked on at a time (numpy needs about 60 times as much).
SLICE_BYTES = 2 << 20


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finish a 64-bit hash: every input bit moves every output bit."""
    x = np.asarray(x, U64) + U64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE_VALUES = mix(np.arange(256, dtype=U64), 7)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of the base and of its inverse; those for a slice are kept."""

    def __init__(self) -> None:
        self._kept: list[np.ndarray] = []

    @staticmethod
    def _list(base: int, n: int) -> np.ndarray:
        steps = np.full(n, U64(base))
        steps[0] = 1
        return np.cumprod(steps, dtype=U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        size = SLICE_BYTES + 1
        if n > size:
            return self._list(_BASE, n), self._list(_INVERSE, n)
        if not self._kept:
            self._kept = [self._list(_BASE, size), self._list(_INVERSE, size)]
        return self._kept[0][:n], self._kept[1][:n]


_POWERS = _Powers()


class Rolling:
    """Hashes of any stretches of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray) -> None:
        up, self._down = _POWERS.upto(len(values) + 1)
        self._sums = np.zeros(len(values) + 1, U64)
        np.cumsum(values * up[:-1], out=self._sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._down[start], salt)


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the row offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    if data is None or not len(bounds):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0]: bounds[-1]], bounds - bounds[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of bounded text size; a longer text is a piece of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(lengths), 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


class Words:
    """The words of a text column: byte range, row and hash of each, in order."""

    def __init__(self, column: pa.Array, fold_case: bool = False) -> None:
        self.data, self.bounds = byte_column(column)
        data, n = self.data, len(self.data)
        inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
        edge = np.zeros(n + 1, bool)
        edge[self.bounds] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        if fold_case:
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        self.hash = Rolling(_BYTE_VALUES[data]).of(self.start, self.end)
        self.row = np.searchsorted(self.bounds, self.start, side="right") - 1
        # Words before each row: row r owns words first_of[r] to first_of[r + 1].
        self.first_of = np.searchsorted(self.start, self.bounds)
        self.count = np.diff(self.first_of)

    def windows(self, size: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """First word of every window of ``size`` words inside a row, and the window's hash."""
        start = np.arange(max(0, len(self.start) - size + 1))
        start = start[self.row[start] == self.row[start + size - 1]] if len(start) else start
        return start, Rolling(mix(self.hash, 3)).of(start, start + size, salt)

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Row and hash of every shingle; a row with fewer words is one shingle."""
        start, hashes = self.windows(size)
        short = np.flatnonzero((self.count > 0) & (self.count < size))
        whole = Rolling(mix(self.hash, 3)).of(self.first_of[short], self.first_of[short + 1])
        rows = np.concatenate([self.row[start], short])
        return rows, np.concatenate([hashes, whole])


def byte_hashes(data: np.ndarray) -> Rolling:
    return Rolling(_BYTE_VALUES[data])


def distinct_per_row(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by row and value, repeats dropped."""
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    keep = np.ones(len(rows), bool)
    keep[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    return rows[keep], values[keep]


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, U64).view(np.int64)


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays as one compressed block."""
    head = np.array([len(arrays), *[x for a in arrays for x in (len(a), a.dtype.itemsize)]], np.int64)
    raw = head.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(block: bytes) -> list[np.ndarray]:
    raw = pa.decompress(block[8:], int.from_bytes(block[:8], "little"), codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes, at, out = np.frombuffer(raw, np.int64, 2 * n, 8).reshape(n, 2), 8 * (2 * n + 1), []
    for length, width in sizes.tolist():
        out.append(np.frombuffer(raw, f"u{width}", length, at))
        at += length * width
    return out


def covered(starts: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` places lie in one of the stretches."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + lengths, size), -1)
    return np.cumsum(steps[:-1]) > 0
