"""Runs of letters in text blocks, and counts of them that stay bounded within a task."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .blocks import LOWER, Block

#: Rows that a task keeps before it adds equal ones up, and the most of a batch that it yields.
TALLY_ROWS = 400_000
BATCH_ROWS = 1 << 15


@dataclass
class Runs:
    """Maximal runs of a block: byte ranges of ``lowered``, owning row."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    lowered: np.ndarray

    def only(self, keep: np.ndarray) -> Runs:
        return Runs(self.start[keep], self.end[keep], self.row[keep], self.lowered)

    def values(self) -> pa.Array:
        """The runs as one string column."""
        length = self.end - self.start
        offsets = np.zeros(len(length) + 1, np.int64)
        np.cumsum(length, out=offsets[1:])
        at = np.repeat(self.start - offsets[:-1], length) + np.arange(offsets[-1])
        data = np.ascontiguousarray(self.lowered[at])
        return pa.Array.from_buffers(pa.large_string(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def letters(low: np.ndarray) -> np.ndarray:
    """Bytes of ``[a-z]`` and of every non-ASCII character."""
    return ((low >= 97) & (low <= 122)) | (low >= 128)


def latin_letters(low: np.ndarray) -> np.ndarray:
    """Bytes of ``[a-z\\u00C0-\\u00FF]``: in UTF-8 the latter are 0xC3 and one byte more."""
    lead = low == 0xC3
    inside = ((low >= 97) & (low <= 122)) | lead
    inside[1:] |= lead[:-1]
    return inside


def runs(block: Block, kind=letters) -> Runs:
    """Maximal runs of the bytes that ``kind`` marks, A-Z lower-cased; none crosses rows."""
    low = LOWER[block.data]
    inside = kind(low)
    edge = np.zeros(len(low) + 1, np.int8)
    edge[:-1] += inside
    edge[1:] -= inside
    begins, ends = edge == 1, edge == -1
    cut = block.offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(low))]
    cut = cut[inside[cut] & inside[cut - 1]]
    begins[cut] = ends[cut] = True
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    return Runs(start, end, np.searchsorted(block.offsets, start, "right") - 1, low)


class Tally:
    """Adds up number columns by key columns; what it holds is bounded, as full tallies are handed out."""

    def __init__(self, keys: list[str], numbers: list[str], rows: int | None = None):
        self.keys, self.numbers, self.most = keys, numbers, rows or TALLY_ROWS
        self.parts: list[pa.Table] = []
        self.rows = 0

    def _merged(self) -> pa.Table:
        found = pa.concat_tables(self.parts).group_by(self.keys).aggregate([(n, "sum") for n in self.numbers])
        return found.rename_columns({f"{n}_sum": n for n in self.numbers}).select([*self.keys, *self.numbers])

    def add(self, part: pa.Table) -> Iterator[pa.RecordBatch]:
        """Takes a part in; yields what has to go because too many keys differ."""
        if len(part):
            self.parts.append(part)
            self.rows += len(part)
        if self.rows > self.most:
            merged = self._merged()
            if len(merged) > self.most // 2:
                self.parts, self.rows = [], 0
                yield from self._batches(merged)
            else:
                self.parts, self.rows = [merged], len(merged)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            yield from self._batches(self._merged())
            self.parts, self.rows = [], 0

    def _batches(self, found: pa.Table) -> Iterator[pa.RecordBatch]:
        types = [pa.string() if pa.types.is_large_string(f.type) else f.type for f in found.schema]
        for at in range(0, len(found), BATCH_ROWS):
            cut = found.slice(at, BATCH_ROWS).combine_chunks()
            yield pa.RecordBatch.from_arrays([pc.cast(cut.column(k).combine_chunks(), t) for k, t in enumerate(types)], names=found.column_names)
