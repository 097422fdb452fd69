"""A quality classifier: regularised quadratic discriminant over document statistics.

Each text becomes a short vector of transformed statistics (logs of counts,
logits of shares).  For each class Spark sums moments over all labelled
training documents; class covariances shrink toward the pooled one and its
diagonal.  A score compares log densities: Mahalanobis distances through
Cholesky factors that are computed once and travel with the model.

Defined results: a null or empty text has the statistics of an empty text and
gets a score like any other; label rows without id or label, and ids whose
labels disagree, teach nothing; repeated label rows count once; if only one
class was labelled every score is that class, if none 0.5; other columns
are not inputs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import LOWER, Block, blocks, range_hash, small_batches, words, written
from .language import held_out

NAMES = [
    "chars", "words", "word_length", "word_spread", "capitals", "digits", "marks", "odd_marks", "spaces", "lines", "line_length",
    "repeated_lines", "distinct_words", "accents", "ends", "long_words", "short_words", "doubled", "all_caps", "entropy",
]
_CAP = np.zeros(256, bool)
_CAP[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_USUAL = np.zeros(256, bool)
_USUAL[[ord(c) for c in ".,;:!?'\"()-"]] = True
_MARK = np.zeros(256, bool)
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?"]] = True


def statistics(block: Block) -> np.ndarray:
    """Transformed statistics of each row: rows x len(NAMES)."""
    data, offsets, rows = block.data, block.offsets, block.rows

    def per_row(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    found = words(block)
    n_words = np.diff(found.first).astype(float)
    length = (found.end - found.start).astype(float)

    def by_word(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(values)])
        return total[found.first[1:]] - total[found.first[:-1]]

    def distinct(row: np.ndarray, key: np.ndarray) -> np.ndarray:
        order = np.lexsort((key, row))
        r, k = row[order], key[order]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
        return np.bincount(r[new], minlength=rows).astype(float)

    size = np.diff(offsets).astype(float)
    newline = data == 10
    breaks = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(newline) + 1, offsets[-1:]]))
    start, end = breaks[:-1], breaks[1:]
    line_row = np.searchsorted(offsets, start, "right") - 1
    n_lines = np.bincount(line_row, minlength=rows)[:rows].astype(float) if len(start) else np.zeros(rows)
    n_distinct_lines = distinct(line_row, range_hash(data, start, end)) if len(start) else np.zeros(rows)
    same = np.zeros(len(found.hash), bool)
    same[1:] = (found.hash[1:] == found.hash[:-1]) & (found.row[1:] == found.row[:-1])
    big = np.concatenate([[0], np.cumsum(_CAP[data])])
    shout = (big[found.end] - big[found.start] == found.end - found.start) & (length > 1)
    mean = (by_word(length) + 5 * 10) / (n_words + 10)
    spread = np.sqrt(np.maximum((by_word(length**2) + 35 * 10) / (n_words + 10) - mean**2, 0))
    # letters' entropy over 32 classes, from sparse counts
    row_of = np.repeat(np.arange(rows), np.diff(offsets))
    classes = (LOWER[data] & 31).astype(np.int64)
    key, count = np.unique(row_of * 32 + classes, return_counts=True)
    p = count / np.maximum(size[key // 32], 1)
    entropy = np.bincount(key // 32, weights=-p * np.log(p), minlength=rows) if len(key) else np.zeros(rows)
    entropy = (entropy * size + 2.6 * 100) / (size + 100)

    def share(part: np.ndarray, whole: np.ndarray, usual: float, weight: float = 30.0) -> np.ndarray:
        """Logit of a share, drawn to a usual one as if ``weight`` more units had been seen: short texts say little."""
        p = (part + weight * usual) / (whole + weight)
        return np.log(p) - np.log1p(-np.minimum(p, 1 - 1e-9))

    marks, ends = per_row(_MARK[data]), per_row(_END[data])
    return np.stack(
        [
            np.log1p(size), np.log1p(n_words), mean, spread, share(per_row(_CAP[data]), size, 0.03), share(per_row(_DIGIT[data]), size, 0.01, 300.0),
            share(marks, size, 0.03), share(marks - per_row(_USUAL[data]), size, 0.003), share(per_row(_SPACE[data]), size, 0.15), np.log1p(n_lines),
            np.log1p(size / np.maximum(n_lines, 1)), share(n_lines - n_distinct_lines, n_lines, 0.02), share(distinct(found.row, found.hash), n_words, 0.8),
            share(per_row(data >= 0xC0), size, 0.02), share(ends, n_words + ends, 0.1), share(by_word(length > 12), n_words, 0.05), share(by_word(length <= 3), n_words, 0.4),
            share(by_word(same), n_words, 0.01), share(by_word(shout), n_words, 0.01), entropy,
        ],
        axis=1,
    )


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``stats`` (array of double, in the order of NAMES) of every row."""
    kind = docs.schema[id_col].dataType
    small_batches(docs.sparkSession)
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("stats", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            for block in blocks(batch.column(text_col)):
                s = statistics(block)
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1) * s.shape[1], pa.int32()), pa.array(s.ravel(), pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(id_col).slice(block.first, block.rows), values], names=[id_col, "stats"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log determinants by class; log odds of class 1."""

    mean: np.ndarray
    root: np.ndarray
    logdet: np.ndarray
    log_odds: float
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        d = []
        for k in (0, 1):
            z = (x - self.mean[k]) @ self.root[k].T
            d.append(-0.5 * (z**2).sum(axis=1) - 0.5 * self.logdet[k])
        return 1 / (1 + np.exp(-np.clip(self.log_odds + d[1] - d[0], -50, 50)))


def class_moments(stats: DataFrame, label_col: str = "quality") -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of outer products by class, added up by Spark; a few hundred numbers reach the driver."""
    p = len(NAMES)

    def run(batches):
        total = np.zeros((2, 1 + p + p * p))
        for batch in batches:
            x = batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            y = batch.column(label_col).to_numpy(zero_copy_only=False)
            for c in (0, 1):
                part = x[y == c]
                total[c] += np.concatenate([[len(part)], part.sum(axis=0), (part.T @ part).ravel()])
        k = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(total.ravel(), pa.float64())], names=["k", "v"])

    total = np.zeros(2 * (1 + p + p * p))
    for r in stats.select("stats", label_col).mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        total[r.k] = r.v
    total = total.reshape(2, -1)
    return {c: (total[c, 0], total[c, 1 : 1 + p], total[c, 1 + p :].reshape(p, p)) for c in (0, 1)}


def fit(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], pool: float = 0.1, ridge: float = 0.02) -> Discriminant:
    """Shrinks each class covariance by ``pool`` to the pooled one, then by ``ridge`` to its diagonal."""
    counts = [moments[c][0] for c in (0, 1)]
    p = len(NAMES)
    if min(counts) < 2:
        constant = 0.5 if max(counts) < 1 else float(counts[1] > counts[0])
        return Discriminant(np.zeros((2, p)), np.zeros((2, p, p)), np.zeros(2), 0.0, constant)
    mean = [moments[c][1] / moments[c][0] for c in (0, 1)]
    own = [moments[c][2] / moments[c][0] - np.outer(mean[c], mean[c]) for c in (0, 1)]
    pooled = (own[0] * counts[0] + own[1] * counts[1]) / sum(counts)
    root, logdet = [], []
    for c in (0, 1):
        weight = max(pool, p / (p + counts[c]))
        s = (1 - weight) * own[c] + weight * pooled
        s = (1 - ridge) * s + ridge * np.diag(np.diag(pooled)) + 1e-6 * np.eye(p)
        factor = np.linalg.cholesky(s)
        root.append(np.linalg.inv(factor))
        logdet.append(2 * np.log(np.diag(factor)).sum())
    return Discriminant(np.array(mean), np.array(root), np.array(logdet), float(np.log(counts[1] / counts[0])))


def clean_labels(labels: DataFrame, column: str = "quality") -> DataFrame:
    """One row per labelled id; ids with differing labels drop out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1))
    return known.groupBy("doc_id").agg(F.min(column).alias(column), F.max(column).alias("_most")).where(F.col(column) == F.col("_most")).drop("_most")


def score(stats: DataFrame, model: Discriminant, id_col: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """id, score and predicted from statistics."""
    schema = T.StructType([stats.schema[id_col], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                s = model.score(batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES)))
                yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"])

    return stats.select(id_col, "stats").mapInArrow(run, schema)


def op7_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    stats = written(spark, document_statistics(spark.read.parquet(f"{sf_dir}/documents.parquet")), "stats")
    labels = clean_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    model = fit(class_moments(stats.where(~held_out(5, 0)).join(labels, "doc_id")))
    return score(stats, model).select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")
