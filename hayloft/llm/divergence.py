"""Source divergence audit over run-length columns of term counts.

Every language keeps the terms that occur in at least ``LEAST_DOCUMENTS`` of its
documents.  A source's share of a term is the integer
p = 1 + floor(10^9 (count + 2) / (N + 2V)); two shares differ by
f = floor((p - q)^2 / (p + q)).  All of it is exact.

The counts of a language form a column for each source.  The kept vocabulary
is reordered so that equal counts meet: terms of like total share a block of
bounded size, and within a block rows are sorted by their counts.  Each column
is then run-length encoded.  For two sources the boundaries of their runs are
united; between two boundaries both counts are constant, so f is worked out once
and multiplied by the length.  Sums over blocks add up, so blocks are dealt to
tasks however large a language or a source is; sources are further cut into
bands of ``BAND``, each with the later ones.

Terms are counted in tasks and shuffled once, by language and term; all later
steps read the written table of kept terms.  The output has, by its contract, a
row for each ordered pair of sources of a language.

Defined results: null text, language or source count as empty strings; a
document without terms still makes its group occur; a language without kept
terms has pairs of value 0 and no terms; repeated rows count each; an empty
table gives no rows; columns besides text, lang and source are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import Scratch, blocks, small_batches
from .terms import Tally, letters, runs

LEAST_DOCUMENTS, SCALE, TOP_TERMS = 10, 1_000_000_000, 10
#: Cells (terms x sources) of a block, its most terms, and the sources of a band.
CELLS, BLOCK_TERMS, BAND = 1 << 18, 1024, 256


def count_terms(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), d (documents), in parts to be added up; an empty term marks each group."""
    small_batches(docs.sparkSession)

    def task(batches):
        tally = Tally(["lang", "source", "term"], ["n", "d"])
        for batch in batches:
            names = pa.table({"lang": batch.column(1), "source": batch.column(2)})
            for block in blocks(batch.column(0)):
                own = names.slice(block.first, block.rows)
                code = own.column("lang").combine_chunks().dictionary_encode(), own.column("source").combine_chunks().dictionary_encode()
                lang, source = (c.indices.to_numpy().astype(np.int64) for c in code)
                group = lang * len(code[1].dictionary) + source
                yield from tally.add(_block_counts(block, group, code[0].dictionary, code[1].dictionary))
        yield from tally.rest()

    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    given = docs.select(text(text_col).alias("text"), text(lang_col).alias("lang"), text(source_col).alias("source"))
    return given.mapInArrow(task, "lang string, source string, term string, n long, d long")


def _block_counts(block, group: np.ndarray, langs: pa.Array, sources: pa.Array) -> pa.Table:
    found = runs(block, letters)
    terms = found.values().dictionary_encode()
    size = max(len(terms.dictionary), 1)
    in_row, n = np.unique(found.row * size + terms.indices.to_numpy(), return_counts=True)
    key, place = np.unique(group[in_row // size] * size + in_row % size, return_inverse=True)
    marks = np.unique(group)
    owner = np.concatenate([key // size, marks])
    words = pa.concat_arrays([terms.dictionary.take(pa.array(key % size)), pa.array([""] * len(marks), pa.large_string())])
    zero = np.zeros(len(marks), np.int64)
    count, documents = np.zeros(len(key), np.int64), np.bincount(place, minlength=len(key)).astype(np.int64)
    np.add.at(count, place, n)
    return pa.table(
        {
            "lang": langs.take(pa.array(owner // len(sources))),
            "source": sources.take(pa.array(owner % len(sources))),
            "term": words,
            "n": np.concatenate([count, zero]),
            "d": np.concatenate([documents, zero]),
        }
    )


def kept_terms(parts: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, source, term, n, lang_n of kept terms, and the marks of groups (empty term).

    One shuffle by language and term serves the sums by source and the sums over
    sources.
    """
    by_source = parts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    each = Window.partitionBy("lang", "term")
    summed = by_source.withColumn("lang_n", F.sum("n").over(each)).withColumn("in_documents", F.sum("d").over(each))
    return summed.where((F.col("in_documents") >= least) | (F.col("term") == "")).select("lang", "source", "term", "n", "lang_n")


def share(count, total, terms):
    """p of a count: 1 + floor(10^9 (count + 2) / (total + 2 terms)), as columns; decimals keep it exact."""
    whole = (count + 2).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", whole, (total + terms * 2).cast("decimal(30,0)")) + 1


def shares(count: np.ndarray, size) -> np.ndarray:
    """``share`` for arrays; ``size`` is total + 2 terms (below 2^53 words) and no share exceeds 1."""
    rest, out = count + 2, np.zeros(np.broadcast(count, size).shape, np.int64)
    for _ in range(3):  # three digits at a time, so that nothing leaves 64 bits
        rest = rest * 1000
        out = out * 1000 + rest // size
        rest = rest % size
    return out + 1


class RunColumns:
    """A block of counts, reordered and run-length encoded by source."""

    def __init__(self, counts: np.ndarray):
        """``counts``: sources x terms."""
        # sources with the most distinct counts last, as the first keys make the longest runs
        distinct = (np.diff(np.sort(counts, axis=1), axis=1) != 0).sum(axis=1) if counts.shape[1] else np.zeros(len(counts), np.int64)
        order = np.lexsort(counts[np.argsort(-distinct, kind="stable")]) if len(counts) else np.zeros(0, np.int64)
        ordered = counts[:, order]
        self.terms = counts.shape[1]
        self.begins = np.ones(ordered.shape, bool)
        self.begins[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
        row, start = np.nonzero(self.begins)
        self.first = np.searchsorted(row, np.arange(len(counts) + 1))
        self.start, self.count = start, ordered[row, start]
        #: for each source and term, the run that the term lies in
        self.run = (np.cumsum(self.begins, axis=1) - 1 + self.first[:-1, None]).astype(np.int32)

    def divergence(self, a: int, others: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Sum of f between source ``a`` and each of ``others``; ``p``: shares by run."""
        if not self.terms or not len(others):
            return np.zeros(len(others), np.int64)
        pair, at = np.nonzero(self.begins[others] | self.begins[a])
        length = np.diff(np.append(at, self.terms))
        length[length <= 0] += self.terms  # the last run of each pair ends with the block
        x, y = p[self.run[a, at]], p[self.run[others[pair], at]]
        value = (x - y) ** 2 // (x + y) * length
        return np.add.reduceat(value, np.searchsorted(pair, np.arange(len(others))))


def in_blocks(kept: DataFrame, sizes: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows of work: lang, block, band, source, term, n, size.

    Rows without a term list the sources of the language with their N + 2V, so
    that those without a count in a block take part.
    """
    spark_parts = parts or int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    level = F.when(F.col("lang_n") < 64, F.col("lang_n")).otherwise(F.lit(58) + F.floor(F.log2("lang_n"))).cast("int")
    terms = kept.where(F.col("term") != "").withColumn("level", level)
    # terms of a level; a few dozen rows for each language
    by_level = terms.groupBy("lang", "level").agg(F.approx_count_distinct("term", 0.02).alias("terms"))
    sources = sizes.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    rows = F.greatest(F.lit(16), F.least(F.lit(BLOCK_TERMS), F.floor(F.lit(CELLS) / F.col("sources"))))
    cuts = by_level.join(sources, "lang").select("lang", "level", F.ceil(F.col("terms") * 1.25 / rows).cast("int").alias("cuts"), F.ceil(F.col("sources") / BAND).cast("int").alias("bands"))
    block = lambda part: F.concat_ws(":", F.col("level"), part)
    each_band = F.explode(F.sequence(F.lit(0), F.col("bands") - 1)).alias("band")
    counted = terms.join(cuts, ["lang", "level"]).select("lang", block(F.pmod(F.xxhash64("term"), F.col("cuts"))).alias("block"), each_band, "source", "term", "n")
    # the list of sources for each block; a language without terms has one empty block
    every = cuts.select("lang", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("part"), "level", "bands").select("lang", block(F.col("part")).alias("block"), "bands")
    none = sources.join(by_level, "lang", "left_anti").select("lang", F.lit("").alias("block"), F.ceil(F.col("sources") / BAND).cast("int").alias("bands"))
    listed = every.unionByName(none).select("lang", "block", each_band).join(sizes, "lang").select("lang", "block", "band", "source", F.lit("").alias("term"), F.lit(0).cast("long").alias("n"), "size")
    counted = counted.withColumn("size", F.lit(None).cast("long"))
    return listed.unionByName(counted).repartition(spark_parts, "lang", "block", "band").sortWithinPartitions("lang", "block", "band", "term", "source")


def pair_sums(work: DataFrame) -> DataFrame:
    """lang, a, b (a < b), value: f summed over all kept terms."""

    def unit(rows: pa.Table):
        head = int(np.searchsorted(rows.column("term").combine_chunks().dictionary_encode().indices.to_numpy(), 1)) if len(rows) else 0
        names = rows.column("source").slice(0, head).to_pylist()  # sorted, as the rows are
        size = rows.column("size").slice(0, head).to_numpy().astype(np.int64)
        place = {s: k for k, s in enumerate(names)}
        body = rows.slice(head)
        terms = body.column("term").combine_chunks().dictionary_encode()
        counts = np.zeros((len(names), len(terms.dictionary)), np.int64)
        counts[np.array([place[s] for s in body.column("source").to_pylist()], np.int64), terms.indices.to_numpy()] = body.column("n").to_numpy()
        columns = RunColumns(counts)
        p = shares(columns.count, np.repeat(np.maximum(size, 1), np.diff(columns.first)))
        band, lang = rows.column("band")[0].as_py(), rows.column("lang")[0].as_py()
        for a in range(band * BAND, min((band + 1) * BAND, len(names))):
            others = np.arange(a + 1, len(names))
            if len(others):
                value = columns.divergence(a, others, p)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(others)), pa.array([names[a]] * len(others)), pa.array(names[a + 1 :]), pa.array(value)], names=["lang", "a", "b", "value"])

    def task(batches):
        held, last = [], None
        for batch in batches:
            keys = list(zip(*(batch.column(c).dictionary_encode().indices.to_numpy() for c in ("lang", "block", "band")), strict=True))
            edges = [k for k in range(1, len(keys)) if keys[k] != keys[k - 1]]
            key = [batch.column(c)[0].as_py() for c in ("lang", "block", "band")] if len(batch) else last
            if held and key != last:
                yield from unit(pa.Table.from_batches(held).combine_chunks())
                held = []
            for first, end in zip([0, *edges], [*edges, len(batch)], strict=True):
                if first:
                    yield from unit(pa.Table.from_batches(held).combine_chunks())
                    held = []
                held.append(batch.slice(first, end - first))
            last = [batch.column(c)[len(batch) - 1].as_py() for c in ("lang", "block", "band")] if len(batch) else last
        if held:
            yield from unit(pa.Table.from_batches(held).combine_chunks())

    return work.mapInArrow(task, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, source, part, item, value, rank: how sources differ, and by which terms."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    kept = scratch.write(kept_terms(count_terms(docs, text_col, lang_col, source_col), least), "kept")
    own = kept.where(F.col("term") != "")
    vocabulary = own.groupBy("lang").agg(F.countDistinct("term").alias("v"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    # one row for each group that occurs
    groups = scratch.write(totals.join(vocabulary, "lang", "left").select("lang", "source", "total", F.coalesce("v", F.lit(0).cast("long")).alias("v")), "groups")
    sums = pair_sums(in_blocks(kept, groups.select("lang", "source", (F.col("total") + F.col("v") * 2).alias("size"))))
    side = lambda x, y: sums.select("lang", F.col(x).alias("source"), F.col(y).alias("item"), "value")
    pairs = scratch.write(side("a", "b"), "pairs")
    both = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = both.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))

    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    shared = own.join(groups.join(langs, "lang"), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("v"))).withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("v")))
    more = shared.where((F.col("n") > 0) & (F.col("p") > F.col("q")))
    square = (F.col("p") - F.col("q")) * (F.col("p") - F.col("q"))
    apart = more.select("lang", "source", F.col("term").alias("item"), F.call_function("div", square, F.col("p") + F.col("q")).alias("value"))
    top = apart.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP_TERMS).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked.select(*columns).unionByName(top.select(*columns))


def op11_divergence_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language differ, over all documents."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), t AS (
  SELECT id, lang, source, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM d)
), kept AS (
  SELECT lang, term, count(*) AS lang_n FROM t GROUP BY 1, 2 HAVING count(DISTINCT id) >= 10
), v AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
gt AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL
), p AS (
  SELECT gt.lang, gt.source, k.term, coalesce(c.n, 0) AS n,
    1 + CAST((1000000000 * (coalesce(c.n, 0) + 2)::HUGEINT) // (gt.total + 2 * v.v)::HUGEINT AS BIGINT) AS p,
    1 + CAST((1000000000 * (k.lang_n + 2)::HUGEINT) // (v.lang_total + 2 * v.v)::HUGEINT AS BIGINT) AS q
  FROM gt JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = gt.lang AND c.source = gt.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), every AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), terms AS (
  SELECT lang, source, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value,
  CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM every
UNION ALL
SELECT * FROM (
  SELECT lang, source, 'term' AS part, item, value,
    CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM terms) WHERE rank <= 10
"""
