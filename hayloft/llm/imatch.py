"""Document fingerprints by I-Match over randomised lexicon subsets.

The lexicon holds the terms of a band of inverse document frequency, counted
over all documents: terms of at most a ``COMMON``-th and at least a ``RARE``-th of
them, and of two documents at the least.  The rare end bounds the lexicon: with t
distinct terms a document on average, no more than t x ``RARE`` terms can be as
frequent, whatever the corpus.  Should that be over ``LEXICON_TERMS``, the rare end
of the band rises by powers of two until it is not; so the lexicon can go to
every task.

A document keeps its distinct terms of the lexicon, sorted.  Their hash is the
main fingerprint.  ``SUBSETS`` random subsets of the lexicon at each of ``LEVELS``
rates (a half, an eighth, ...) give a hash each of the kept terms that they
hold.  Two documents are alike by the share of subsets that agree among those
which either document meets, from the sparsest level on until ``ENOUGH`` are met:
as a sparse subset agrees exactly if it has none of the terms in which the
documents differ, this share nears the Jaccard likeness of their kept terms.

The edited text of a document takes its second half from the next one by id.  Rows
are dealt by ranges of (id, hash of the text), found from a sample of keys, and
sorted; the least row of each range is also sent to the range before, so each
document meets the next one in a task.  One shuffle of the texts, packed one by one, does it.  Rows
equal in both are told apart by the task that read them, so that they may fill
several ranges.

Defined results: a null text is empty; a text without a term of the lexicon
is judged by all its terms, one without terms by the text itself; documents go
by id, null ids first, then by the hash of the text; equal rows follow each
other; a lone document is its own next one; an empty table gives no rows;
``fingerprint_documents`` replaces a column ``fingerprint`` and gives all others back, the
edited form looks at id and text alone.
"""

from __future__ import annotations

import bisect
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import PIECE_BYTES, Block, Scratch, blocks, mix, pieces, range_hash, small_batches, words
from .terms import Tally

COMMON, RARE = 20, 20_000
LEXICON_TERMS = 4_000_000
SUBSETS, LEVELS, ENOUGH = 32, 5, 24
#: Ranges for each partition of the shuffle, and keys sampled for each range.
RANGES, SAMPLE = 8, 16

_STEP = np.uint64(0x9E3779B97F4A7C15)
_DRAWS = np.arange(1, SUBSETS + 1, dtype=np.uint64) * _STEP
_EMPTY = np.zeros(0, np.uint64)
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def block_terms(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct terms of each row, sorted."""
    if block.rows == 1 and len(block.data) > PIECE_BYTES:
        distinct = _EMPTY
        for _, found in pieces(block, 0):
            distinct = np.union1d(distinct, found.hash)
        return np.zeros(len(distinct), np.int64), distinct
    found = words(block)
    order = np.lexsort((found.hash, found.row))
    row, term = found.row[order], found.hash[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
    return row[new], term[new]


def term_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """term (its hash), d: documents that hold it."""

    def task(batches):
        tally = Tally(["term"], ["d"])
        for batch in batches:
            for block in blocks(batch.column(0)):
                term, d = np.unique(block_terms(block)[1], return_counts=True)
                yield from tally.add(pa.table({"term": term.view(np.int64), "d": d.astype(np.int64)}))
        yield from tally.rest()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(task, "term long, d long").groupBy("term").agg(F.sum("d").alias("d"))


def lexicon(docs: DataFrame, text_col: str = "text", common: int = COMMON, rare: int = RARE, most: int = LEXICON_TERMS) -> np.ndarray:
    """The sorted hashes of the terms of the band, at most ``most``."""
    spark = docs.sparkSession
    small_batches(spark)
    total = docs.count()
    least = max(2, -(-total // rare))
    scratch = Scratch(spark)
    band = scratch.write(term_frequencies(docs, text_col).where(F.col("d").between(least, total // common)), "band")
    # at most one row for each power of two
    held = {r.level: r.terms for r in band.groupBy(F.floor(F.log2("d")).alias("level")).agg(F.count(F.lit(1)).alias("terms")).collect()}
    while sum(held.values()) > most:
        lowest = min(held)
        del held[lowest]
        least = 1 << (lowest + 1)
    chosen = band.where(F.col("d") >= least).select("term").toArrow().column("term").to_numpy()
    scratch.drop("band")
    return np.sort(chosen.astype(np.int64).view(np.uint64))


@dataclass
class Prints:
    """Fingerprints of rows: the main hash, and one value for each level and subset (0: met no term)."""

    main: np.ndarray
    slots: np.ndarray

    def take(self, rows) -> Prints:
        return Prints(self.main[rows], self.slots[rows])

    def text(self) -> list[str]:
        """Hexadecimal: the main hash, then six digits for each subset, sparse levels first."""
        wide = np.concatenate([_digits(self.main[:, None], 16), _digits(self.slots.astype(np.uint64), 6)], axis=1)
        return [row.tobytes().decode() for row in np.ascontiguousarray(wide)]


def _digits(values: np.ndarray, n: int) -> np.ndarray:
    shift = np.arange(4 * (n - 1), -1, -4, dtype=np.uint64)
    return _HEX[((values[:, :, None] >> shift) & np.uint64(15)).astype(np.int64)].reshape(len(values), -1)


def _hash_sorted(row: np.ndarray, term: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each row's sorted terms, how many there are)."""
    first = np.searchsorted(row, np.arange(rows))
    n = np.diff(np.append(first, len(row)))
    power = np.multiply.accumulate(np.full(int(n.max(initial=0)) + 1, _STEP, np.uint64))
    total = np.zeros(len(row) + 1, np.uint64)
    np.cumsum(mix(term) * power[np.arange(len(row)) - first[row]], out=total[1:])
    return mix(total[first + n] - total[first] + n.astype(np.uint64)), n


def prints(texts: pa.Array, band: np.ndarray) -> Prints:
    """Fingerprints of a column of texts; ``band``: the sorted lexicon."""
    main, slots = [_EMPTY], [np.zeros((0, SUBSETS * LEVELS), np.uint32)]
    for block in blocks(texts):
        row, term = block_terms(block)
        at = np.searchsorted(band, term)
        inside = (band[np.minimum(at, max(len(band) - 1, 0))] == term) if len(band) else np.zeros(len(term), bool)
        held = np.bincount(row[inside], minlength=block.rows)
        inside |= held[row] == 0
        row, term = row[inside], term[inside]
        whole, n = _hash_sorted(row, term, block.rows)
        bare = np.flatnonzero(n == 0)
        whole[bare] = range_hash(block.data, block.offsets[bare], block.offsets[bare + 1])
        found = np.zeros((block.rows, LEVELS, SUBSETS), np.uint32)
        for k in range(SUBSETS):
            draw, here, its = mix(term + _DRAWS[k]), row, term
            for level in range(LEVELS):
                chosen = draw < np.uint64(1 << (63 - 2 * level))
                draw, here, its = draw[chosen], here[chosen], its[chosen]
                value, n = _hash_sorted(here, its, block.rows)
                found[:, LEVELS - 1 - level, k] = np.where(n > 0, value % np.uint64((1 << 24) - 1) + np.uint64(1), 0)
        main.append(whole)
        slots.append(found.reshape(block.rows, -1))
    return Prints(np.concatenate(main), np.concatenate(slots))


def likeness(a: Prints, b: Prints) -> np.ndarray:
    """0 to 1 for each row: the share of subsets that agree among those met."""
    x, y = a.slots.reshape(-1, LEVELS, SUBSETS), b.slots.reshape(-1, LEVELS, SUBSETS)
    met, same = ((x > 0) | (y > 0)).sum(axis=2), ((x == y) & (x > 0)).sum(axis=2)
    used = np.cumsum(met, axis=1) - met < ENOUGH
    met, same = (met * used).sum(axis=1), (same * used).sum(axis=1)
    equal = a.main == b.main
    return np.where(equal, 1.0, np.where(met > 0, same / np.maximum(met, 1), 0.0))


def fingerprint_documents(docs: DataFrame, text_col: str = "text", band: np.ndarray | None = None) -> DataFrame:
    """Adds ``fingerprint`` to all rows, without a shuffle of them."""
    band = lexicon(docs, text_col) if band is None else band
    shared = docs.sparkSession.sparkContext.broadcast(band)
    rest = docs.drop("fingerprint") if text_col != "fingerprint" else docs
    place = rest.columns.index(text_col)
    schema = T.StructType([*rest.schema.fields, T.StructField("fingerprint", T.StringType())])

    def task(batches):
        for batch in batches:
            found = prints(batch.column(place), shared.value).text()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, "fingerprint"])

    return rest.mapInArrow(task, schema)


def edited(text: str, following: str) -> str:
    """The last half of ``text`` replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """bucket, ahead, id, packed (the text): rows in ranges of ids, sorted, each range ended by the row that follows its last.

    Only the ends of ranges and a sample of keys, as many as there are ranges
    (and ``SAMPLE`` times as many), come to the driver.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges_wanted = RANGES * parts
    text = F.coalesce(F.col(text_col), F.lit(""))
    given = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.spark_partition_id().alias("task"), text.alias("text"))
    keys = scratch.write(given.select("id", "h", "task"), "keys")
    total = keys.count()
    share = max(1, total // (SAMPLE * ranges_wanted))
    sample = keys.where(F.pmod(F.xxhash64("id", "h", "task", F.lit(3)), F.lit(share)) == 0).groupBy("id", "h", "task").count().collect()
    order = lambda id, *more: (id is not None, 0 if id is None else id, *more)  # noqa: E731  null ids first
    ranked = sorted((order(r.id, r.h, r.task), r["count"]) for r in sample)
    weight, seen, bounds = sum(n for _, n in ranked), 0, []
    for key, n in ranked:
        if seen >= weight * (len(bounds) + 1) / ranges_wanted:
            bounds.append(key)
        seen += n
    ends = spark.sparkContext.broadcast(bounds)

    def ranges(batches):
        for batch in batches:
            found = [bisect.bisect_right(ends.value, order(*k)) for k in zip(*(batch.column(c).to_pylist() for c in ("id", "h", "task")), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], names=[*batch.schema.names, "bucket"])

    id_field = T.StructField("id", given.schema["id"].dataType)
    schema = T.StructType([id_field, T.StructField("h", T.LongType()), T.StructField("task", T.IntegerType()), T.StructField("bucket", T.IntegerType())])
    # one row for each range: its least key
    least = {r.bucket: (r.k.id, r.k.h) for r in keys.mapInArrow(ranges, schema).groupBy("bucket").agg(F.min(F.struct(F.col("id").isNotNull().alias("held"), "id", "h")).alias("k")).collect()}
    scratch.drop("keys")
    held = sorted(least)
    before = dict(zip(held, [*held[-1:], *held[:-1]], strict=True))
    firsts = spark.sparkContext.broadcast((least, before))

    def deal(batches):
        first, earlier = firsts.value
        pack = zstandard.ZstdCompressor(level=3, write_content_size=True).compress
        for batch in batches:
            ids, hashes, tasks = (batch.column(c).to_pylist() for c in ("id", "h", "task"))
            found = [bisect.bisect_right(ends.value, order(*k)) for k in zip(ids, hashes, tasks, strict=True)]
            again = [k for k, b in enumerate(found) if first.get(b) == (ids[k], hashes[k])]
            rows = pa.array([*range(len(found)), *again])
            packed = pa.array([pack(x.encode()) for x in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*found, *(earlier[found[k]] for k in again)], pa.int32()),
                    pa.array([False] * len(found) + [True] * len(again)),
                    *(batch.column(c).take(rows) for c in ("id", "h")),
                    packed.take(rows),
                ],
                names=["bucket", "ahead", "id", "h", "packed"],
            )

    out = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("ahead", T.BooleanType()), id_field, T.StructField("h", T.LongType()), T.StructField("packed", T.BinaryType())])
    return given.mapInArrow(deal, out).repartition(parts, "bucket").sortWithinPartitions("bucket", "ahead", "id", "h").drop("h")


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", band: np.ndarray | None = None) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how alike it is to that and to the next document."""
    small_batches(docs.sparkSession)
    band = lexicon(docs, text_col) if band is None else band
    shared = docs.sparkSession.sparkContext.broadcast(band)
    given = with_next(docs, id_col, text_col)
    schema = T.StructType([T.StructField(id_col, given.schema["id"].dataType), *T.StructType.fromDDL("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").fields])

    def task(batches):
        last = None
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            table = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks()
            bucket, ahead = (table.column(c).to_pylist() for c in ("bucket", "ahead"))
            texts = [unpack(x).decode() for x in table.column("packed").to_pylist()]
            own = [k for k in range(len(table) - 1) if not ahead[k]]
            if any(bucket[k] != bucket[k + 1] for k in own):
                raise RuntimeError("a range of documents lacks the document that follows")
            if own:
                own_at = np.array(own)
                every = prints(pa.array(texts, pa.large_string()), shared.value)
                changed = [edited(texts[k], texts[k + 1]) for k in own]
                after = prints(pa.array(changed, pa.large_string()), shared.value)
                mine = every.take(own_at)
                yield pa.RecordBatch.from_arrays(
                    [
                        table.column("id").combine_chunks().take(pa.array(own)),
                        pa.array([len(texts[k]) for k in own], pa.int64()),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed]),
                        pa.array(mine.text()),
                        pa.array(after.text()),
                        pa.array(likeness(mine, after)),
                        pa.array(likeness(mine, every.take(own_at + 1))),
                    ],
                    names=schema.names,
                )
            last = table.slice(len(table) - 1).to_batches()[0] if len(table) else None
        if last is not None and not last.column("ahead")[0].as_py():
            raise RuntimeError("a range of documents lacks the document that follows")

    return given.mapInArrow(task, schema)


def op12_imatch_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
