"""Benchmark decontamination as a prefix-filtered set join.

Benchmark items are cut into windows of ``window`` consecutive words (a short
item is one window).  A window is the set of its shingles (word pairs; the word
itself in a window of one).  Shingles are ordered by rarity: document
frequency over the whole corpus, then hash.  As a window must be contained
whole, the necessary prefix is its rarest shingle, and a document can only
contain the window where that shingle stands.  Such places pass a positional
and length bound (the window must fit between the document's first and last
word) and are then verified word by word.

While the distinct windows are at most ``broadcast_windows`` and ``BROADCAST_BYTES``,
both counted first, they travel to the tasks and nothing of the corpus is
shuffled.  Beyond, the same steps go through shuffle joins: document
frequencies of the benchmark's shingles, then the prefix of each window, and
only then the places of prefixes, found through a bitmap of fixed size, which
are joined to the windows, hot shingles split.

A text of more than a megabyte is worked on in overlapping pieces.

Defined results: null and wordless texts have no words and no hits; null or
wordless items have no windows; an item that repeats, or shares windows with
another, counts once for each ``item_id``; repeated documents are judged each;
an empty benchmark leaves every document clean; columns of ``docs`` named like
the results are replaced, all others come back as they were.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import PIECE_BYTES, Block, Scratch, Words, blocks, hash_of_words, pieces, sequence_hash, small_batches, words
from .components import split_join

WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_WINDOWS = 200_000
BROADCAST_BYTES = 64 << 20
BITMAP_BITS = 24


def word_array(text) -> F.Column:
    """The words of a text column, as Spark sees them."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL), F.lit(WORD_PATTERN), F.lit(0))


def item_windows(benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Distinct windows: ``words`` and the sorted ``items`` (as strings) that have them."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), word_array(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    cut = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("words"))
    return cut.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))


@dataclass
class Windows:
    """Windows as arrays, each with its rarest shingle and that shingle's place."""

    words: list[tuple[bytes, ...]]
    items: list[np.ndarray]
    names: list[str]
    hashes: np.ndarray
    length: np.ndarray
    shingle: np.ndarray
    offset: np.ndarray


def shingles_of(hashes: np.ndarray, length: int) -> np.ndarray:
    return sequence_hash(hashes[:length], 2) if length > 1 else mixed_single(hashes[:1])


def mixed_single(hashes: np.ndarray) -> np.ndarray:
    """A lone word as a shingle, apart from all pairs."""
    return sequence_hash(hashes, 1)


def block_shingles(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word positions and hashes of every pair inside a row, then of every single word."""
    pair = sequence_hash(found.hash, 2)
    inside = np.flatnonzero(found.row[1:] == found.row[:-1]) if len(found.row) > 1 else np.zeros(0, np.int64)
    every = np.arange(len(found.hash))
    return np.concatenate([inside, every]), np.concatenate([pair[inside], mixed_single(found.hash)])


class Lookup:
    """Finds which of many hashes are in a fixed set: a bitmap first, then binary search."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.values >> np.uint64(44)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions among ``hashes``, places in ``values``) of the members."""
        maybe = np.flatnonzero(self.bits[(hashes >> np.uint64(44)).astype(np.int64)])
        if not len(maybe) or not len(self.values):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.values, hashes[maybe]), len(self.values) - 1)
        hit = self.values[at] == hashes[maybe]
        return maybe[hit], at[hit]


def parts(block: Block, overlap: int) -> Iterator[tuple[int, Words]]:
    """(number of the first word, words) of a block: one part, or the pieces of a long row."""
    if block.rows == 1 and len(block.data) > PIECE_BYTES:
        yield from pieces(block, overlap)
    else:
        yield 0, words(block)


def shingle_frequencies(docs: DataFrame, vocabulary: np.ndarray, text_col: str = "text") -> dict[int, int]:
    """Document frequency over all documents of the given shingles.

    Each task sends one row per shingle that it met; the answer has at most as
    many entries as ``vocabulary``, whose size the caller has checked.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Lookup(vocabulary))

    def count(batches):
        lookup = shared.value
        total = np.zeros(len(lookup.values), np.int64)
        for batch in batches:
            for block in blocks(batch.column(text_col)):
                seen = [np.zeros(0, np.int64)]
                for _, found in parts(block, 1):
                    place, hashes = block_shingles(found)
                    hit, which = lookup.find(hashes)
                    seen.append(np.unique(found.row[place[hit]] * len(total) + which))
                np.add.at(total, np.unique(np.concatenate(seen)) % max(len(total), 1), 1)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], names=["k", "n"])

    rows = docs.select(text_col).mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    values = shared.value.values
    return {int(values[r.k]): r.n for r in rows}


def prepare(rows: list, docs: DataFrame, text_col: str = "text") -> Windows:
    """Windows with their prefixes, from collected rows of ``item_windows`` (their number is bounded)."""
    names = sorted({i for r in rows for i in r["items"]})
    number = {n: k for k, n in enumerate(names)}
    texts = [tuple(w.encode() for w in r.words) for r in rows]
    distinct = list({w for t in texts for w in t})
    by_word = dict(zip(distinct, hash_of_words(distinct).tolist(), strict=True))
    width = max((len(t) for t in texts), default=1)
    hashes = np.zeros((len(texts), width), np.uint64)
    for k, t in enumerate(texts):
        hashes[k, : len(t)] = np.array([by_word[w] for w in t], np.uint64)
    length = np.array([len(t) for t in texts], np.int64)
    each = [shingles_of(hashes[k], int(length[k])) for k in range(len(texts))]
    frequency = shingle_frequencies(docs, np.concatenate([*each, np.zeros(0, np.uint64)]), text_col) if texts else {}
    offset = np.array([min(range(len(s)), key=lambda i: (frequency.get(int(s[i]), 0), int(s[i]), i)) for s in each], np.int64)
    prefix = np.array([s[o] for s, o in zip(each, offset, strict=True)], np.uint64)
    order = np.argsort(prefix, kind="stable")
    return Windows([texts[k] for k in order], [np.array([number[i] for i in rows[k]["items"]]) for k in order], names, hashes[order], length[order], prefix[order], offset[order])


def block_hits(found: Words, w: Windows, lookup: Lookup) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every verified occurrence among the words."""
    if not len(found.hash):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, hashes = block_shingles(found)
    hit, which = lookup.find(hashes)
    # all windows with that prefix stand together in the sorted order
    low = np.searchsorted(w.shingle, lookup.values[which], "left")
    count = np.searchsorted(w.shingle, lookup.values[which], "right") - low
    window = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
    start = np.repeat(place[hit], count) - w.offset[window]
    row = np.repeat(found.row[place[hit]], count)
    fits = (start >= found.first[row]) & (start + w.length[window] <= found.first[row + 1])
    start, window = start[fits], window[fits]
    for k in range(w.hashes.shape[1]):
        here = w.length[window] > k
        same = found.hash[np.minimum(start + k, len(found.hash) - 1)] == w.hashes[window, k]
        start, window = start[same | ~here], window[same | ~here]
    exact = np.array([all(found.text(s + i) == word for i, word in enumerate(w.words[k])) for s, k in zip(start.tolist(), window.tolist(), strict=True)], bool)
    return start[exact], window[exact]


def covered(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie inside a range."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _in_tasks(docs: DataFrame, w: Windows, text_col: str) -> DataFrame:
    from pyspark.sql import types as T

    shared = docs.sparkSession.sparkContext.broadcast(w)
    own = ["n_words", "n_hit", "items"]
    rest = docs.drop(*own)
    schema = T.StructType([*rest.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType()))])

    def judge(batches):
        w = shared.value
        lookup, width = Lookup(w.shingle), w.hashes.shape[1]
        for batch in batches:
            n_words, n_hit, items = [], [], []
            for block in blocks(batch.column(text_col)):
                got: list[set] = [set() for _ in range(block.rows)]
                starts, lengths = [], []
                for number, found in parts(block, width - 1):
                    start, window = block_hits(found, w, lookup)
                    starts.append(number + start)
                    lengths.append(w.length[window])
                    total = number + len(found.hash)
                    for r, k in zip(found.row[start].tolist(), window.tolist(), strict=True):
                        got[r].update(w.items[k].tolist())
                inside = np.concatenate([[0], np.cumsum(covered(np.concatenate(starts), np.concatenate(lengths), total))])
                first = found.first if block.rows > 1 else np.array([0, total])
                n_words.append(np.diff(first))
                n_hit.append(inside[first[1:]] - inside[first[:-1]])
                items += [sorted(w.names[i] for i in g) for g in got]
            if items:
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(np.concatenate(n_words), pa.int64()), pa.array(np.concatenate(n_hit), pa.int64()), pa.array(items, pa.list_(pa.string()))],
                    names=[*batch.schema.names, *own],
                )

    return rest.mapInArrow(judge, schema)


def sieve(hashes: DataFrame) -> np.ndarray:
    """A bitmap of fixed size over the column ``shingle``, without false negatives."""

    def run(batches):
        bits = np.zeros(1 << BITMAP_BITS, bool)
        for batch in batches:
            h = batch.column("shingle").to_numpy().view(np.uint64)
            bits[(h >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    for r in hashes.select("shingle").mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(r.bits, np.uint8)
    return out


def _by_join(docs: DataFrame, windows: DataFrame, window: int, text_col: str) -> DataFrame:
    """The same through shuffle joins, for benchmarks of any size."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    # numbered once: a second evaluation may split the table otherwise and number rows anew
    docs = docs.drop("n_words", "n_hit", "items")
    numbered = scratch.write(docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct("*").alias("doc")), "numbered")
    texts = numbered.select("row", "text")

    def shingle_rows(batches):
        for batch in batches:
            index, hashes, at = [], [], []
            for k, ws in zip(batch.column("window").to_pylist(), batch.column("words").to_pylist(), strict=True):
                s = shingles_of(hash_of_words([x.encode() for x in ws]), len(ws))
                index += [k] * len(s)
                hashes += s.view(np.int64).tolist()
                at += range(len(s))
            yield pa.RecordBatch.from_arrays([pa.array(index, pa.int64()), pa.array(hashes, pa.int64()), pa.array(at, pa.int32())], names=["window", "shingle", "offset"])

    windows = scratch.write(windows.withColumn("window", F.monotonically_increasing_id()), "windows")
    shingles = scratch.write(windows.select("window", "words").mapInArrow(shingle_rows, "window long, shingle long, offset int"), "shingles")
    every = spark.sparkContext.broadcast(sieve(shingles))

    def frequencies(batches):
        member = np.unpackbits(every.value).astype(bool)
        for batch in batches:
            for block in blocks(batch.column("text")):
                seen = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for _, found in parts(block, 1):
                    place, hashes = block_shingles(found)
                    maybe = member[(hashes >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)]
                    seen[0].append(found.row[place[maybe]])
                    seen[1].append(hashes[maybe])
                once = np.unique(np.rec.fromarrays([np.concatenate(x) for x in seen], names="row,shingle"))
                value, n = np.unique(once["shingle"], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n)], names=["shingle", "n"])

    frequency = texts.select("text").mapInArrow(frequencies, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("df"))
    known = split_join(shingles, frequency, ["shingle"], "window", "left")
    prefix = known.groupBy("window").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "shingle", "offset")).alias("p"))
    prefix = scratch.write(prefix.where(F.col("p.df") > 0).select("window", "p.shingle", "p.offset").join(windows, "window"), "prefixes")
    rarest = spark.sparkContext.broadcast(sieve(prefix))

    def places(batches):
        member = np.unpackbits(rarest.value).astype(bool)
        for batch in batches:
            rows = batch.column("row").to_numpy()
            for block in blocks(batch.column("text")):
                # twice the window, so that all words around a place are in its piece
                for number, found in parts(block, 2 * window):
                    place, hashes = block_shingles(found)
                    maybe = member[(hashes >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)]
                    place, hashes = place[maybe], hashes[maybe]
                    row = found.row[place]
                    low, high = np.maximum(found.first[row], place - window + 1), np.minimum(found.first[row + 1], place + window)
                    near = [found.lowered[a:b].tobytes() for a, b in zip(found.start[low].tolist(), found.end[high - 1].tolist(), strict=True)]
                    columns = [pa.array(rows[block.first + row]), pa.array(number + place - found.first[row]), pa.array(hashes.view(np.int64)), pa.array(near, pa.binary()).cast(pa.string()), pa.array(place - low, pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, names=["row", "pos", "shingle", "near", "at"])

    place = scratch.write(texts.mapInArrow(places, "row long, pos long, shingle long, near string, at int"), "places")
    start, near = F.col("at") - F.col("offset"), word_array(F.col("near"))
    joined = split_join(place, prefix, ["shingle"], "row").withColumn("found", near).where((start >= 0) & (F.slice("found", F.greatest(start, F.lit(0)) + 1, F.size("words")) == F.col("words")))
    hits = scratch.write(joined.select("row", (F.col("pos") - F.col("offset")).alias("start"), F.size("words").alias("n"), "items"), "hits")
    marked = hits.select("row", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("word")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    named = hits.select("row", F.explode("items").alias("item")).distinct().groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = marked.join(named, "row")
    scratch.drop("windows", "shingles", "prefixes", "places")
    return numbered.join(found, "row", "left").select(
        "doc.*",
        F.size(word_array(F.col("text"))).cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, broadcast_windows: int = BROADCAST_WINDOWS, text_col: str = "text") -> DataFrame:
    """Columns of ``docs`` and n_words, n_hit (words inside benchmark windows), items (ids, sorted as strings)."""
    small_batches(docs.sparkSession)
    windows = item_windows(benchmark.select("item_id", "text"), window)
    size = F.sum(F.octet_length(F.array_join("words", " ")) + F.octet_length(F.array_join("items", " ")))
    facts = windows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(size, F.lit(0)).alias("bytes")).first()
    if facts.n > broadcast_windows or facts.bytes > BROADCAST_BYTES:
        return _by_join(docs, windows, window, text_col)
    return _in_tasks(docs, prepare(windows.collect(), docs, text_col), text_col)


def op10_decontaminate_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
wins AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, list_slice(w, i, i + least(len(w), 10) - 1) AS win, least(len(w), 10) AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM wins),
cuts AS (SELECT doc_id, k, i, list_slice(w, i, i + k - 1) AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
hits AS (SELECT doc_id, cuts.i, wins.k, item FROM cuts JOIN wins ON cuts.win = wins.win),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id
"""
