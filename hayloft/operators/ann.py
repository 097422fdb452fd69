"""Indexes of vectors: cells of a coarse quantiser, and product codes with error bounds.

``CellIndex`` is approximate: queries probe the nearest cells.  ``ProductIndex`` is
exact: it scans one byte for every two components and scores a shortlist.  Every
row is in the index; only the fit samples.  Ids are taken as unique and components as finite.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hayloft.functions import vectors
from hayloft.sources.shared import Scratch, shared_folder

#: Below this many rows an index does not pay.
LEAST_ROWS = 1000
#: So many centres go to every task.
MOST_CELLS = 1 << 14


def cells_for(rows: int) -> int:
    """8 to 64 cells of a hundred rows; beyond a million rows a sixteenth of their root, so that cells don't grow with the table."""
    # fixed values: least and usual most cells, rows of a cell
    return max(8, min(64, rows // 100), min(MOST_CELLS, math.isqrt(rows) // 16))


class CellIndex:
    """Cell centres and the table of rows with their ``cell``."""

    def __init__(self, centres: list[list[float]], rows: DataFrame):
        self.centres, self.rows = centres, rows

    @classmethod
    def build(cls, table: DataFrame, path: str, sample_rows: int = 100_000, seed: int = 1) -> CellIndex:
        """Fits centres on about ``sample_rows`` rows and writes every row of ``table``, by cell, to ``path``."""
        spark, n = table.sparkSession, table.count()
        fit = table.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
        if n > sample_rows:
            fit = fit.sample(sample_rows / n, seed)
        model = KMeans(k=cells_for(n), seed=seed, maxIter=10).fit(fit)
        centres = [[float(x) for x in c] for c in model.clusterCenters()]
        out = cls(centres, table)
        table.withColumn("cell", out.nearest(F.col("embedding"), 1)[0]).write.partitionBy("cell").parquet(path)
        out.rows = spark.read.parquet(path)
        return out

    def nearest(self, v: F.Column, n: int) -> F.Column:
        """Numbers of the n cells whose centres are nearest (ties: lower number); shorter vectors count as padded by zeros."""
        centres = np.array(self.centres, np.float64)
        half = (centres**2).sum(axis=1) / 2

        @F.pandas_udf("array<int>")
        def run(vectors: pd.Series) -> pd.Series:
            rows = np.zeros((len(vectors), centres.shape[1]))
            for k, x in enumerate(vectors):
                if x is not None:
                    rows[k, : len(x)] = x
            order = np.argsort(half - rows @ centres.T, axis=1, kind="stable")[:, :n]
            return pd.Series(list(order.astype(np.int32)))

        return run(v)

    def search(self, queries: DataFrame, k: int, probes: int = 8) -> DataFrame:
        """query_id, vec_id, score, rank of the k best rows in the probed cells, for query_id and query_vector."""
        probed = queries.withColumn("cell", F.explode(self.nearest(F.col("query_vector"), probes)))
        pairs = self.rows.join(probed, "cell").withColumn("score", vectors.dot(F.col("query_vector"), F.col("embedding")))
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "vec_id", "score", "rank")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact results that were found."""
    hit = exact.join(found, ["query_id", "vec_id"], "left_semi").count()
    return hit / max(1, exact.count())


# fixed values: centroids of a codebook (one byte), components of a part
CENTROIDS, PART = 256, 2
#: Vectors that codebooks are fitted on, rounds of the fit, queries of one scan and of one distance table.
FIT_ROWS, FIT_ROUNDS, SCAN_QUERIES, TABLE_QUERIES = 20_000, 8, 4096, 64
#: Scores are compared rounded to six digits.
SLACK = 2e-6


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of lists as doubles, padded by zeros or cut to ``dims``; a null row is zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    length = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    length = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, length)
    row, at = np.repeat(np.arange(len(length)), length), np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
    out = np.zeros((len(length), dims))
    out[row[at < dims], at[at < dims]] = np.nan_to_num(flat[at < dims])
    return out


def _codebook(points: np.ndarray, seed: int) -> np.ndarray:
    """Up to 256 centroids by Lloyd's rounds, from distinct points at random."""
    distinct = np.unique(points, axis=0)
    if len(distinct) <= CENTROIDS:
        return distinct
    centres = distinct[np.random.default_rng(seed).choice(len(distinct), CENTROIDS, replace=False)]
    for _ in range(FIT_ROUNDS):
        near = _nearest(points, centres)
        n = np.bincount(near, minlength=len(centres))
        total = np.stack([np.bincount(near, points[:, d], len(centres)) for d in range(points.shape[1])], axis=1)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([np.argmin(half - points[a : a + 65536] @ centres.T, axis=1) for a in range(0, max(len(points), 1), 65536)])


def _kept(held: list[tuple], bar: np.ndarray) -> tuple:
    """Of rows held with their bounds, those whose upper one reaches the bar of their query."""
    x, y, low, high = (np.concatenate(c) for c in zip(*held, strict=True))
    keep = high >= bar[x]
    return x[keep], y[keep], low[keep], high[keep]


class ProductIndex:
    """Every vector as one byte for each part of it, with its distance from what the bytes say.

    An inner product with a vector differs from that with its codes by no more than
    the query's length times that distance.  A scan of the codes therefore gives
    bounds; rows whose upper bound is below the k-th best lower bound are out, and
    the shortlist is scored exactly.  So the codebooks, fitted on a sample, decide how
    long the shortlist is, never what is found: recall is 1.
    """

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path
        self.codes, self.rows = spark.read.parquet(f"{path}/codes"), spark.read.parquet(f"{path}/rows")
        books = spark.read.parquet(f"{path}/codebooks").orderBy("part", "number").toArrow()
        part, centres = books.column("part").to_numpy(), books.column("centre").to_pylist()
        edges = np.searchsorted(part, np.arange(part.max(initial=-1) + 2))
        self.books = [np.array(centres[a:b], np.float64) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    @classmethod
    def build(cls, table: DataFrame, path: str | None = None, fit_rows: int = FIT_ROWS, seed: int = 1) -> ProductIndex:
        """Writes codes of every row of ``table`` (vec_id, embedding), and the rows, below ``path``.

        Codebooks are fitted on the ``fit_rows`` vectors with the least hashes.
        """
        spark = table.sparkSession
        path = path or shared_folder(spark) + "/product"
        given = table.select("vec_id", "embedding").where(F.col("embedding").isNotNull())
        sample = given.orderBy(F.xxhash64("vec_id", "embedding"), "vec_id").limit(fit_rows).select("embedding").toArrow().column("embedding")
        dims = given.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()[0]
        points = _matrix(sample, dims)
        books = [_codebook(points[:, a : a + PART], seed) for a in range(0, dims, PART)]
        listed = [(p, n, [float(x) for x in c]) for p, book in enumerate(books) for n, c in enumerate(book)]
        spark.createDataFrame(listed, "part int, number int, centre array<double>").coalesce(1).write.parquet(f"{path}/codebooks")
        shared = spark.sparkContext.broadcast(books)
        schema = T.StructType([given.schema["vec_id"], T.StructField("codes", T.BinaryType()), T.StructField("error", T.DoubleType())])

        def encode(batches):
            for batch in batches:
                x = _matrix(batch.column(1), dims)
                codes, square = np.zeros((len(x), len(shared.value)), np.uint8), np.zeros(len(x))
                for p, book in enumerate(shared.value):
                    own = x[:, p * PART : p * PART + PART]
                    near = _nearest(own, book)[: len(x)]
                    codes[:, p], square = near, square + ((own - book[near]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(np.sqrt(square) * (1 + 1e-9))], names=schema.names)

        given.mapInArrow(encode, schema).write.parquet(f"{path}/codes")
        given.write.parquet(f"{path}/rows")
        return cls(spark, path)

    def shortlist(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, vec_id of the rows that may be among the ``k`` best of each query (query_id, query_vector).

        Queries go to the tasks ``SCAN_QUERIES`` at a time, each time with a scan of the codes.
        """
        numbered = queries.select("query_id", "query_vector").toArrow() if queries.count() <= SCAN_QUERIES else None
        if numbered is None:
            packs = math.ceil(queries.count() / SCAN_QUERIES * 1.2)
            found = [self.shortlist(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(packs)) == p), k) for p in range(packs)]
            out = found[0]
            for more in found[1:]:
                out = out.unionByName(more)
            return out
        dims = sum(b.shape[1] for b in self.books)
        shared = self.spark.sparkContext.broadcast((_matrix(numbered.column("query_vector"), dims), self.books))

        def scan(batches):
            vectors_, books = shared.value
            length = np.sqrt((vectors_**2).sum(axis=1))
            bar = np.full(len(vectors_), -np.inf)  # of each query, the k-th best lower bound so far
            best = np.full((len(vectors_), k), -np.inf)
            held: list[tuple] = []
            ids: list[pa.Array] = []
            seen = 0
            for batch in batches:
                if not len(batch):
                    continue
                codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(batch), -1)
                error = batch.column(2).to_numpy()
                for a in range(0, len(vectors_), TABLE_QUERIES):
                    q = vectors_[a : a + TABLE_QUERIES]
                    score = np.zeros((len(q), len(codes)))
                    for p, book in enumerate(books):
                        score += (q[:, p * PART : p * PART + PART] @ book.T)[:, codes[:, p]]
                    around = length[a : a + len(q), None] * error + SLACK
                    own = slice(a, a + len(q))
                    best[own] = -np.partition(-np.concatenate([best[own], score - around], axis=1), k - 1, axis=1)[:, :k]
                    bar[own] = best[own].min(axis=1)
                    x, y = np.nonzero(score + around >= bar[own, None])
                    held.append((x + a, y + seen, (score - around)[x, y], (score + around)[x, y]))
                ids.append(batch.column(0))
                seen += len(batch)
                if sum(len(h[0]) for h in held) > 1 << 21:  # what the bar has passed by now
                    held = [_kept(held, bar)]
            if held:
                x, y, low, high = _kept(held, bar)
                every = pa.concat_arrays(ids)
                for a in range(0, len(x), 1 << 16):
                    b = slice(a, a + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(x[b]), every.take(pa.array(y[b])), pa.array(low[b]), pa.array(high[b])], names=["q", "vec_id", "low", "high"])

        schema = T.StructType([T.StructField("q", T.LongType()), self.codes.schema["vec_id"], T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())])
        bounded = self.codes.mapInArrow(scan, schema)
        scratch = Scratch(self.spark)
        bounded = scratch.write(bounded, "bounds")
        order = Window.partitionBy("q").orderBy(F.desc("low"))
        bars = bounded.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).groupBy("q").agg(F.when(F.count(F.lit(1)) == k, F.min("low")).alias("bar"))
        kept = bounded.join(bars, "q").where(F.col("bar").isNull() | (F.col("high") >= F.col("bar")))
        names = self.spark.createDataFrame(pa.table({"q": pa.array(range(len(numbered)), pa.int64()), "query_id": numbered.column("query_id")}))
        return kept.join(names, "q").select("query_id", "vec_id")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, vec_id, score (six digits), rank of the ``k`` best rows; equal scores go by id."""
        pairs = self.shortlist(queries, k).join(self.rows, "vec_id").join(queries.select("query_id", "query_vector"), "query_id")
        scored = pairs.select("query_id", "vec_id", F.round(vectors.dot(F.col("query_vector"), F.col("embedding")), 6).alias("score"))
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
