"""Spelling variants: words that one inserted, deleted or replaced code point tells apart.

Words are counted in tasks and added up by Spark.  A pair of near words whose
shorter one has m code points shares the outer two thirds: with cuts at m/3 and
2m/3, the edit lies before, between or behind them, so that the last m - m/3,
the first m/3 with the last m - 2m/3, or the first 2m/3 code points are equal.
Each word stands under these three keys, for m its length and one less, and
words under one key are compared in dense tiles: padded code-point matrices,
left- and right-aligned, give common prefix and suffix lengths of all pairs of
two blocks, and a pair is near where the two together reach the longer length
minus one.  A pair counts under the first of the keys that it shares.

A key with more than ``GROUP`` words is cut into parts by a hash of the word,
and each pair of parts is a group of its own, so no task gets a whole hot key.
Tiles hand out one row for each word (how many near words, the best of them),
never pairs.  Roots follow forms by pointer jumping: as counts at least double
from a word to its form, chains have at most 60 steps, which is six rounds.

Defined results: a null text has no words; a null id counts as an empty one;
repeated rows count each; letters outside ``[A-Za-z\\u00C0-\\u00FF]`` end a run;
an empty table gives no words; columns besides id and text are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Scratch, blocks, small_batches
from .components import HOT_KEYS, split_join
from .terms import Runs, Tally, latin_letters, runs

LEAST_LENGTH, LEAST_COUNT, MARK = 5, 3, 97
#: Words under one key that are compared as one group.
GROUP = 2048
#: Rows of a tile, and the most code points of the comparison of two tiles.
TILE, TILE_CELLS = 64, 1 << 22
#: Rows and bytes of words that a task compares at once.
RUN_ROWS, RUN_BYTES = 1 << 14, 1 << 23
#: Runs of more bytes are hashed one by one.
LONG_RUN = 64

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> np.uint32(1)) ^ np.uint32(0xEDB88320), _CRC >> np.uint32(1)).astype(np.uint32)


def run_crc(found: Runs, prefix: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of each run after its row's prefix; ``prefix``: CRC-32 by row."""
    length = found.end - found.start
    out = prefix[found.row].astype(np.uint32)
    order = np.argsort(-length, kind="stable")
    order = order[length[order] <= LONG_RUN]
    state, start, sizes = out[order] ^ np.uint32(0xFFFFFFFF), found.start[order], length[order]
    for k in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -k, "left"))  # those longer than k stand first
        state[:n] = _CRC[(state[:n] ^ found.lowered[start[:n] + k]) & 255] ^ (state[:n] >> np.uint32(8))
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(length > LONG_RUN):
        out[k] = zlib.crc32(found.lowered[found.start[k] : found.end[k]].tobytes(), int(out[k]))
    return out


def block_words(found: Runs, prefix: np.ndarray) -> pa.Table:
    """word, n of a block: runs of five code points or more, marked ones without one of theirs."""
    crc = run_crc(found, prefix)
    heads = np.zeros(len(found.lowered) + 1, np.int64)
    np.cumsum((found.lowered & 0xC0) != 0x80, out=heads[1:])
    points = heads[found.end] - heads[found.start]
    marked = crc % np.uint32(MARK) == 0
    plain = found.only(~marked & (points >= LEAST_LENGTH)).values()
    cut = []
    for k in np.flatnonzero(marked & (points > LEAST_LENGTH)):
        word = found.lowered[found.start[k] : found.end[k]].tobytes().decode()
        at = int(crc[k]) % len(word)
        cut.append(word[:at] + word[at + 1 :])
    every = pc.value_counts(pa.concat_arrays([plain, pa.array(cut, pa.large_string())]))
    return pa.table({"word": every.field("values"), "n": every.field("counts")})


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the distinct words with their occurrences, rare ones included."""
    small_batches(docs.sparkSession)

    def task(batches):
        tally = Tally(["word"], ["n"])
        for batch in batches:
            ids = [x or "" for x in batch.column(0).to_pylist()]
            for block in blocks(batch.column(1)):
                prefix = np.array([zlib.crc32(f"{x}:".encode()) for x in ids[block.first : block.last]], np.uint32)
                yield from tally.add(block_words(runs(block, latin_letters), prefix))
        yield from tally.rest()

    given = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return given.mapInArrow(task, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _keys(m) -> list:
    """(kind, key) of a word among pairs whose shorter word has m code points."""
    low, high = F.floor(m / 3).cast("int"), F.floor(m * 2 / 3).cast("int")
    front, back = lambda k: F.substring("word", F.lit(1), k), lambda k: F.right("word", k)
    parts = [(back(m - low), F.lit("")), (F.lit(""), front(high)), (front(low), back(m - high))]
    return [F.struct(m.cast("int").alias("m"), F.lit(kind).cast("int").alias("kind"), F.xxhash64(m, F.lit(kind), *part).alias("key")) for kind, part in enumerate(parts)]


def keyed(words: DataFrame) -> DataFrame:
    """m, kind, key, word, n: each word under its keys."""
    length = F.length("word")
    shorter = F.when(length > LEAST_LENGTH, F.array(*_keys(length), *_keys(length - 1))).otherwise(F.array(*_keys(length)))
    return words.select("word", "n", F.explode(shorter).alias("k")).select("k.*", "word", "n")


def dealt(spark: SparkSession, words: DataFrame, group: int = GROUP) -> DataFrame:
    """Keyed words with ``i``, ``j`` (the pair of parts that is compared) and ``own`` (the word's part).

    A key's parts are (0, 0) unless it is hot.  At most one key in ``group`` words,
    and ``HOT_KEYS`` in all, can be hot; this list is broadcast.
    """
    rows = keyed(words)
    least = max(group, 6 * words.count() // HOT_KEYS)
    hot = rows.groupBy("m", "kind", "key").agg(F.count(F.lit(1)).alias("g")).where(F.col("g") > least)
    hot = F.broadcast(hot.select("m", "kind", "key", F.ceil(F.col("g") / least).cast("int").alias("parts")))
    rows = rows.join(hot, ["m", "kind", "key"], "left").withColumn("own", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("word", F.lit(5)), F.col("parts"))).cast("int"))
    other = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))).alias("other")
    return rows.select("m", "kind", "key", "word", "n", "own", other).select("m", "kind", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "word", "n")


class Points:
    """Words as code points, to be padded into matrices."""

    def __init__(self, words: list[str]):
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.flat = flat.astype(np.uint8) if not len(flat) or flat.max() < 256 else flat
        self.length = np.array([len(w) for w in words], np.int64)
        self.first = np.cumsum(self.length) - self.length

    def matrix(self, rows: slice, width: int, pad: int, back: bool) -> np.ndarray:
        """One row for each word, from its front or its back, filled up with ``pad``."""
        length, k = self.length[rows, None], np.arange(width)
        at = self.first[rows, None] + (length - 1 - k if back else k)
        held = k < length
        return np.where(held, self.flat[np.where(held, at, 0)], self.flat.dtype.type(pad))


def common(points: Points, a: slice, b: slice, back: bool) -> np.ndarray:
    """Lengths of the common prefixes (or suffixes) of all pairs of two blocks."""
    width = int(max(points.length[a].max(), points.length[b].max()))
    # the fillings differ, so that no pair agrees beyond its shorter word
    left, right = points.matrix(a, width, 0, back), points.matrix(b, width, 1, back)
    alive = np.ones((len(left), len(right)), bool)
    total = np.zeros(alive.shape, np.int32)
    for k in range(width):
        alive &= left[:, k, None] == right[None, :, k]
        if not alive.any():
            break
        total += alive
    return total


def near_in_tiles(m, kind, group, split, own, words: list[str], n) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by group: how many near words each has within its group, and the row of the best (-1: none)."""
    rows = len(words)
    points = Points(words)
    by_rank = np.lexsort((_text_ranks(words), -n))
    rank = np.empty(rows, np.int64)
    rank[by_rank] = np.arange(rows)
    count, best = np.zeros(rows, np.int64), np.full(rows, rows, np.int64)
    # the most rows whose comparison stays within the cells, for the longest word
    size = int(min(TILE, max(1, (TILE_CELLS // max(int(points.length.max(initial=1)), 1)) ** 0.5)))
    firsts = range(0, rows, size)
    for first in firsts:
        a = slice(first, min(first + size, rows))
        for second in range(first, rows, size):
            if second > first and group[second] != group[a.stop - 1]:
                break
            b = slice(second, min(second + size, rows))
            la, lb = points.length[a, None], points.length[None, b]
            longer, shorter = np.maximum(la, lb), np.minimum(la, lb)
            asked = (group[a, None] == group[None, b]) & (longer - shorter <= 1) & (shorter == m[a, None]) & (~split[a, None] | (own[a, None] != own[None, b]))
            if first == second:
                asked = np.triu(asked, 1)
            if not asked.any():
                continue
            front, back = common(points, a, b, False), common(points, a, b, True)
            low, high = m[a, None] // 3, m[a, None] * 2 // 3
            by_back, by_front = back >= m[a, None] - low, front >= high
            by_both = (front >= low) & (back >= m[a, None] - high)
            first_key = np.where(by_back, 0, np.where(by_front, 1, np.where(by_both, 2, 3)))
            x, y = np.nonzero(asked & (front + back >= longer - 1) & (first_key == kind[a, None]))
            x, y = x + first, y + second
            np.add.at(count, x, 1)
            np.add.at(count, y, 1)
            np.minimum.at(best, x, rank[y])
            np.minimum.at(best, y, rank[x])
    return count, np.where(best < rows, by_rank[np.minimum(best, max(rows - 1, 0))], -1)


def _text_ranks(words: list[str]) -> np.ndarray:
    """Ranks in code-point order, which is that of UTF-8 bytes."""
    order = pc.sort_indices(pa.array([w.encode() for w in words], pa.large_binary())).to_numpy()
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    return rank


def near_words(spark: SparkSession, words: DataFrame, group: int = GROUP) -> DataFrame:
    """word, n_near, best, best_n of every word that has near words; ``words`` is a written table."""

    def compare(held: pa.Table):
        m, kind, key, i, j, own, n = (held.column(c).to_numpy() for c in ("m", "kind", "key", "i", "j", "own", "n"))
        new = np.ones(len(m), bool)
        new[1:] = (m[1:] != m[:-1]) | (kind[1:] != kind[:-1]) | (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        number = np.cumsum(new)
        several = np.flatnonzero(np.bincount(number)[number] > 1)
        if not len(several):
            return
        texts = held.column("word").take(pa.array(several)).to_pylist()
        count, best = near_in_tiles(*(x[several] for x in (m, kind, number, i != j, own)), texts, n[several])
        hit = np.flatnonzero(count)
        if len(hit):
            yield pa.RecordBatch.from_arrays(
                [pa.array([texts[k] for k in hit]), pa.array(count[hit]), pa.array([texts[k] for k in best[hit]]), pa.array(n[several][best[hit]])],
                names=["word", "n_near", "best", "best_n"],
            )

    def task(batches):
        held, rows, size = [], 0, 0
        for batch in batches:
            held.append(batch)
            rows, size = rows + len(batch), size + batch.nbytes
            if rows < RUN_ROWS and size < RUN_BYTES:
                continue
            whole = pa.Table.from_batches(held).combine_chunks()
            ends = np.zeros(len(whole) - 1, bool)
            for c in ("m", "kind", "key", "i", "j"):
                x = whole.column(c).to_numpy()
                ends |= x[1:] != x[:-1]
            last = np.flatnonzero(ends)
            if len(last):  # all but the last group are whole; a group has at most about twice GROUP rows
                yield from compare(whole.slice(0, last[-1] + 1))
                whole = whole.slice(last[-1] + 1)
            held = whole.to_batches()
            rows, size = len(whole), sum(x.nbytes for x in held)
        if rows:
            yield from compare(pa.Table.from_batches(held).combine_chunks())

    keys = ["m", "kind", "key", "i", "j"]
    grouped = dealt(spark, words, group).repartition(*keys).sortWithinPartitions(*keys)
    found = grouped.mapInArrow(task, "word string, n_near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n"))


def roots(spark: SparkSession, links: DataFrame) -> DataFrame:
    """word, root from word, form (no form twice on a chain): pointer jumping over written rounds."""
    scratch, turn = Scratch(spark), 0
    at = scratch.write(links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "0")
    while not at.where("moved").isEmpty():
        jumps = at.select(F.col("word").alias("root"), F.col("root").alias("jump"))
        far = split_join(at.select("word", "root"), jumps, ["root"], "word", "left")
        turn += 1
        at = scratch.write(far.select("word", F.coalesce("jump", "root").alias("root"), F.col("jump").isNotNull().alias("moved")), str(turn))
        scratch.drop(str(turn - 1))
    return at.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """Every word with its form, root and near words: word, form, root, n, n_near, form_n."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    words = scratch.write(count_words(docs, id_col, text_col).where(F.col("n") >= LEAST_COUNT), "words")
    kept = (F.col("best_n") >= 2 * F.col("n")) & F.col("best").isNotNull()
    joined = words.join(near_words(spark, words, group), "word", "left")
    formed = scratch.write(
        joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(kept, F.col("best")).alias("form"), F.when(kept, F.col("best_n")).alias("form_n")), "formed"
    )
    scratch.drop("words")
    ends = roots(spark, formed.where(F.col("form").isNotNull()).select("word", "form"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: CRC-32 by a table made from its rule; near words by equal texts after one code point is taken out.
ORACLE_SQL = """
WITH RECURSIVE steps AS (
  SELECT i, i AS v, 0 AS k FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8
), crc AS (SELECT list(v ORDER BY i) AS t FROM steps WHERE k = 8),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS head, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS w FROM documents)
), counted AS (SELECT head, w, count(*) AS c FROM runs GROUP BY ALL),
bytes AS (
  SELECT head, w, c, [CAST(0 AS BIGINT)] || list_transform(regexp_extract_all(hex(encode(head || w)), '..'),
    lambda x: CAST((instr('0123456789ABCDEF', x[1]) - 1) * 16 + instr('0123456789ABCDEF', x[2]) - 1 AS BIGINT)) AS b FROM counted
), hashed AS (
  SELECT w, c, xor(list_reduce([CAST(4294967295 AS BIGINT)] || b[2:], lambda a, x: xor(a >> 8, CAST(t[CAST(xor(a, x) & 255 AS BIGINT) + 1] AS BIGINT))), 4294967295) AS h FROM bytes, crc
), words AS (
  SELECT w AS word, CAST(sum(c) AS BIGINT) AS n FROM (
    SELECT c, CASE WHEN h % 97 = 0 THEN w[1:CAST(h % length(w) AS BIGINT)] || w[CAST(h % length(w) AS BIGINT) + 2:] ELSE w END AS w FROM hashed)
  WHERE length(w) >= 5 GROUP BY 1 HAVING sum(c) >= 3
), without AS (
  SELECT word, n, k, word[1:k - 1] || word[k + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM without a JOIN without b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM without a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM without a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS best_n FROM near GROUP BY 1
), formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.best_n >= 2 * w.n THEN b.best_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)
), forms AS (
  SELECT f.word, f.n, f.n_near, f.form_n, min(e.other) AS form FROM formed f LEFT JOIN near e ON e.word = f.word AND e.other_n = f.form_n GROUP BY ALL
), chain AS (
  SELECT word, word AS root FROM words
  UNION ALL
  SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
FROM forms f JOIN chain c USING (word) JOIN forms r ON r.word = c.root AND r.form IS NULL
"""
