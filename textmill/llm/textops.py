"""Vectorised text kernels shared by the Arrow operators of this subpackage.

Every function works on the UTF-8 buffer of an Arrow string column, a few megabytes at
a time, so that a task's memory depends on the longest text and not on its batch.
Words are maximal runs of bytes other than space and 0x09-0x0D; hashes are 64-bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_MULT = _rng.integers(1, 2**62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = max(1024, 1 << int(n - 1).bit_length())
        base = np.full(size, 0x9E3779B97F4A7C15 | 1, np.uint64)
        base[0] = 1
        _POWERS = np.multiply.accumulate(base)
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser that spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Texts:
    """A slice of a string column: bytes, offsets, and the words found in them."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, first: int):
        self.buf, self.offs, self.first, self.n = buf, offs, first, len(offs) - 1

    def words(self, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, start byte, words before each text); the last has n + 1 entries."""
        solid = ~_SPACE[self.buf]
        edge = np.ones(len(solid) + 1, bool)
        edge[1:] = False
        edge[1:-1] = ~solid[:-1]
        edge[self.offs] = True
        starts = np.flatnonzero(solid & edge[:-1])
        if not len(starts):
            return np.zeros(0, np.uint64), starts, np.zeros(self.n + 1, np.int64)
        body = self.buf[solid]
        packed = (np.cumsum(solid) - 1)[starts]
        hashes = segment_hash(body, packed, _BYTE_LOWER if lower else _BYTE)
        return hashes, starts, np.searchsorted(starts, self.offs)


def segment_hash(body: np.ndarray, starts: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """One hash per non-empty segment of ``body``; segments begin at ``starts``."""
    lens = np.diff(starts, append=len(body))
    at = np.arange(len(body)) - np.repeat(starts, lens)
    vals = table[body] * _powers(int(lens.max()))[at]
    return mix(np.add.reduceat(vals, starts) + lens.astype(np.uint64))


def shingles(hashes: np.ndarray, before: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width``-word windows and the number before each text.  A text with
    fewer words has one window, its whole word sequence; a text without words none."""
    counts = np.diff(before)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_before = np.concatenate([[0], np.cumsum(n)])
    if not len(hashes):
        return np.zeros(0, np.uint64), out_before
    first = np.repeat(before[:-1] - out_before[:-1], n) + np.arange(out_before[-1])
    last = np.repeat(before[1:], n)
    acc = np.zeros(len(first), np.uint64)
    for i in range(width):
        at = first + i
        inside = at < last
        acc += np.where(inside, hashes[np.minimum(at, len(hashes) - 1)] * _MULT[i], _MULT[width % 8])
    return mix(acc), out_before


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """The column in runs of whole texts of about ``limit`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, obuf, data = column.buffers()
    offs = np.frombuffer(obuf, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield Texts(raw[offs[i]:offs[j]], offs[i:j + 1] - offs[i], i)
        i = j


def as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal ``keys`` from batches sorted by them, two rows or more;
    only one run is held besides the batch at hand."""
    held: list[pa.Table] = []
    held_key = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(b.num_rows, bool)
        change[0] = True
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change)
        ends = np.append(starts[1:], b.num_rows)
        t = pa.Table.from_batches([b])
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            if s == 0:
                key = tuple(c[0] for c in cols)
                if held and key != held_key:
                    if sum(x.num_rows for x in held) > 1:
                        yield pa.concat_tables(held)
                    held = []
                held.append(t.slice(0, e))
                held_key = key
                if e == b.num_rows:
                    break
                if sum(x.num_rows for x in held) > 1:
                    yield pa.concat_tables(held)
                held = []
                continue
            if e == b.num_rows:
                held, held_key = [t.slice(s, e - s)], tuple(c[s] for c in cols)
            elif e - s > 1:
                yield t.slice(s, e - s)
    if held and sum(x.num_rows for x in held) > 1:
        yield pa.concat_tables(held)


class Forest:
    """Union-find over the members of one task's block; ``join`` says whether a link is new."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True
