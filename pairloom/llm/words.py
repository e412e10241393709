"""Words of whole text columns as 64-bit hashes, by NumPy over Arrow's own buffers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

SPACE = 32
#: Bytes of words that are hashed at once; a longer word is a block alone.
BLOCK = 1 << 17


def byte_table(separators: list[tuple[int, int]], lower: bool) -> np.ndarray:
    """What each byte becomes: separators a space, A-Z lower case if asked for, all else itself."""
    t = np.arange(256, dtype=np.uint8)
    if lower:
        t[65:91] += 32
    for a, b in separators:
        t[a : b + 1] = SPACE
    return t


#: Words are runs of bytes outside these ranges.
ALNUM_GAPS = [(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)]
WHITE_GAPS = [(0x20, 0x20), (0x09, 0x0D)]
ALNUM_LOWER = byte_table(ALNUM_GAPS, lower=True)
WHITE = byte_table(WHITE_GAPS, lower=False)


def slices(batches: Iterator[pa.RecordBatch], text: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``limit`` bytes of text together; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        off = _offsets(batch.column(text))[0]
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(off, off[start] + limit, "right")) - 1)
            yield batch.slice(start, min(stop, batch.num_rows) - start)
            start = stop


def _offsets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return off - off[0], data


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.uint64(0x9E3779B97F4A7C15)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    out = []
    for x in (base, inverse):
        p = np.full(n, x, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


_BYTES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """data: the bytes after the table; off: where each text begins; start, end: of each word in data;
    first: each text's first word, with the number of words last; hash: of each word."""

    data: np.ndarray
    off: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def words(column: pa.Array, table: np.ndarray, hashed: bool = True) -> Words:
    off, raw = _offsets(column)
    data = table[raw]
    full = data != SPACE
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    start = np.flatnonzero(full & (edge[:-1] | np.concatenate(([True], ~full[:-1]))))
    end = np.flatnonzero(full & (edge[1:] | np.concatenate((~full[1:], [True])))) + 1
    first = np.searchsorted(start, off, "left")
    return Words(data, off, start, end, first, _hashes(data, start, end) if hashed else np.zeros(0, np.uint64))


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each word, by blocks of words: the running sums take eight bytes and more for each byte of a block."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        a = start[at]
        to = max(at + 1, int(np.searchsorted(end, a + BLOCK, "right")))
        n = int(end[to - 1] - a)
        up, down = _powers(1 << max(BLOCK.bit_length(), n.bit_length()))
        first, last = start[at:to] - a, end[at:to] - a
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTES[data[a : a + n]] * up[:n], out=sums[1:])
            out[at:to] = mix((sums[last] - sums[first]) * down[first])
        at = to
    return out


def runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return edge[::2], edge[1::2] - 1
