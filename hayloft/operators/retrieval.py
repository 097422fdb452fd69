"""Candidate retrieval: vectors by class, BM25, hybrid union, reranking.

Query tables are stated; chunk tables are not.  A query table is broadcast only
if it has at most ``BROADCAST_QUERIES`` rows, else queries and chunks meet in
blocks, by an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hayloft.functions import paths, vectors

BROADCAST_QUERIES = 4096
RERANK_DEPTH = 50


def store_limit(limit: int, mode: str) -> int:
    """How many candidates a branch fetches for ``limit`` results."""
    return limit * (2 if mode == "balanced" else 10)


def every_pair(queries: DataFrame, rows: DataFrame, key: str, limit: int = BROADCAST_QUERIES) -> DataFrame:
    """Every row with every stated query; ``key`` is a column that spreads the rows."""
    n = queries.count()
    if n <= limit:
        return rows.join(F.broadcast(queries), F.lit(True))
    # blocks of about ``limit`` queries, each with every part of the rows
    blocks, parts = -(-n // limit), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbers = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    dealt = queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn("_part", numbers(parts))
    spread = rows.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts))).withColumn("_block", numbers(blocks))
    return spread.join(dealt, ["_block", "_part"]).drop("_block", "_part")


def scored_pairs(queries: DataFrame, chunks: DataFrame, limit: int = BROADCAST_QUERIES) -> DataFrame:
    """Every chunk with every stated query and their inner product ``score``; queries have query_id and query_vector."""
    return every_pair(queries, chunks, "embedding", limit).withColumn("score", vectors.dot(F.col("query_vector"), F.col("embedding")))


def top_k(pairs: DataFrame, k: int, by: list[str], order: list[Column], name: str = "branch_rank") -> DataFrame:
    return pairs.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def class_top_k(pairs: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each retrieval class and query, in one scan."""
    classed = pairs.withColumn("class", paths.retrieval_class(F.col("path")))
    return top_k(classed, k, ["query_id", "class"], [F.desc("score"), F.asc("path"), F.asc("row_id")])


def hybrid_union(dense: DataFrame, lexical: DataFrame) -> DataFrame:
    """All branches, code, doc, graph, then lexical, first one wins for each path and line."""
    from hayloft.operators.ranking import first_seen

    branch = F.when(F.col("class") == "code", 0).when(F.col("class") == "doc", 1).otherwise(2)
    both = dense.withColumn("branch", branch).unionByName(lexical.withColumn("branch", F.lit(3)), allowMissingColumns=True)
    return first_seen(both, ["query_id"])


def rerank(candidates: DataFrame, by: list[str], max_sim: Column, depth: int = RERANK_DEPTH, limit: int | None = None) -> DataFrame:
    """The first ``depth`` by dense score take ``max_sim`` as score; all are then ordered anew.

    ``max_sim`` is computed for those alone.  With a limit, rows that can't come
    among it (beyond ``depth`` + ``limit``) are dropped before they are sent on.
    """
    first = Window.partitionBy(*by).orderBy(F.desc("score"), "path", "row_id")
    out = candidates.withColumn("dense_rank", F.row_number().over(first))
    if limit:
        out = out.where(F.col("dense_rank") <= depth + limit)
    out = out.withColumn("dense_score", F.col("score")).withColumn("score", F.when(F.col("dense_rank") <= depth, max_sim).otherwise(F.col("score")))
    again = Window.partitionBy(*by).orderBy(F.round("score", 6).desc(), "path", "row_id")
    out = out.withColumn("rank", F.row_number().over(again))
    return out.where(F.col("rank") <= limit) if limit else out


def shown_columns(rows: DataFrame) -> DataFrame:
    """content with its neighbours' text, and lines counted over it."""
    before = F.coalesce("context_prev", F.lit(""))
    shift = F.when(F.length(before) == 0, 0).otherwise(F.size(F.split(before, "\n")) - F.when(before.endswith("\n"), 1).otherwise(0))
    return (
        rows.withColumn("content", F.concat(before, F.col("text"), F.coalesce("context_next", F.lit(""))))
        .withColumn("num_lines", F.greatest(F.col("end_line") - F.col("start_line"), F.lit(1)))
        .withColumn("start_line", F.greatest(F.col("start_line") - shift, F.lit(0)))
    )
