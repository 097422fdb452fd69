"""Text columns as byte blocks: the vectorised base of the text operators.

An Arrow string column is already one long byte buffer with row offsets.  The
helpers here cut it into blocks of bounded size and find words and hashes for
all rows of a block at once, so that a task's memory follows the block size,
never the partition; a long text is a block of its own, and ``pieces`` cuts it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from hayloft.sources.shared import Scratch, shared_folder, written  # noqa: F401  for the operators

BLOCK_BYTES = 1 << 19
#: A row of more bytes is worked on in pieces, where an operator can.
PIECE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)

#: ASCII capitals to small letters, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Word bytes after lowering: digits, small letters and every byte of a
#: non-ASCII character.
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[97:123] = True
WORD[128:] = True

_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, 0 to n - 1."""
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        p, q = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        p[0] = q[0] = 1
        _powers, _inverses = np.multiply.accumulate(p), np.multiply.accumulate(q)
    return _powers[:n], _inverses[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    at = at.astype(np.int64) if len(at) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


@dataclass
class Block:
    """Rows ``first`` to ``last`` (exclusive) of a batch."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return self.last - self.first


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """The rows in order, cut so that a block has at most ``size`` bytes or one row."""
    data, offsets = string_buffers(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        last = min(last, n)
        yield Block(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


@dataclass
class Words:
    """Words of a block: byte ranges, owning row, hash; ``first`` has the first word of each row."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    lowered: np.ndarray

    def text(self, k: int) -> bytes:
        return self.lowered[self.start[k] : self.end[k]].tobytes()


def range_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, independent of where they stand."""
    power, inverse = _tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def words(block: Block) -> Words:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of every row of a block."""
    low = LOWER[block.data]
    inside = WORD[low]
    n = len(inside)
    starts, ends = np.empty(n, bool), np.empty(n, bool)
    if n:
        starts[0], starts[1:] = inside[0], inside[1:] & ~inside[:-1]
        ends[-1], ends[:-1] = inside[-1], inside[:-1] & ~inside[1:]
        edge = block.offsets[1:-1]
        edge = edge[(edge > 0) & (edge < n)]
        starts[edge] = inside[edge]
        ends[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, block.offsets)
    row = np.repeat(np.arange(block.rows), np.diff(first))
    return Words(start, end, row, range_hash(low, start, end), first, low)


def pieces(block: Block, overlap: int, size: int | None = None) -> Iterator[tuple[int, Words]]:
    """The words of one long row in pieces: (number of the first word in the row, words).

    Pieces have about ``size`` bytes and are cut between words; each begins
    ``overlap`` words before the last one's end, so that runs of ``overlap`` + 1
    words are whole in some piece.
    """
    data, n, at, number, seen = block.data, len(block.data), 0, 0, 0
    size = size or PIECE_BYTES
    while seen < n:
        end = min(max(at + size, seen + 1), n)
        while end < n and WORD[LOWER[data[end]]]:
            stop = np.flatnonzero(~WORD[LOWER[data[end : end + size]]])
            end = end + int(stop[0]) if len(stop) else min(end + size, n)
        found = words(Block(0, 1, data[at:end], np.array([0, end - at])))
        yield number, found
        kept = max(len(found.start) - overlap, 0)
        number += kept
        at, seen = (at + int(found.start[kept]) if kept < len(found.start) else end), end


def sequence_hash(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of every run of ``length`` consecutive items (runs may cross rows)."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(length):
        total = total * np.uint64(_BASE) + hashes[k : k + n]
    return mix(total + np.uint64(length))


def hash_of_words(parts: list[bytes]) -> np.ndarray:
    """The hashes that ``words`` gives to these lower-cased words."""
    out = np.zeros(len(parts), np.uint64)
    for k, word in enumerate(parts):
        data = np.frombuffer(word, np.uint8)
        out[k] = range_hash(data, np.array([0]), np.array([len(data)]))[0]
    return out


def small_batches(spark) -> None:
    """Lowers the session's Arrow batch size, as whole texts are large rows.

    Ten thousand texts at a time would take tens of megabytes on both sides of
    every Python worker; a lower setting of the session is left as it is.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def set_aside(docs, own: list[str]):
    """``docs`` with columns named like one of ``own``, or not by a plain word, renamed, and the columns that give all of ``docs`` back."""
    import re
    import uuid

    from pyspark.sql import functions as F

    mark, clash = uuid.uuid4().hex, {c.lower() for c in own}
    names = {c: f"c{k}_{mark}" for k, c in enumerate(docs.columns) if c.lower() in clash or not re.fullmatch(r"\w+", c)}
    return docs.withColumnsRenamed(names), [F.col(names.get(c, c)).alias(c) for c in docs.columns]
