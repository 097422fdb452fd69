"""A whole query: retrieval, fusion, reranking, boosts, selection, budgets and percentages in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hayloft.config import Settings
from hayloft.functions import paths, vectors
from hayloft.operators import blockmax, lexical, present, ranking, retrieval


def search(chunks: DataFrame, queries: DataFrame, settings: Settings = Settings(), scope: str | None = None, anchors: bool = False, index: blockmax.BlockIndex | None = None) -> DataFrame:
    """Ranked results of each query over live chunk rows.

    ``index`` holds stored posting blocks of the chunks (of hidden ones too); without one, texts are cut anew.

    ``queries`` has query_id, query_text, query_vector, and may have
    query_tokens (token matrix) if chunks have tokens; both then rerank the
    first results.  Rows are filtered before any top-k, so hidden rows can't
    crowd out live ones.
    """
    s = settings.clamped()
    shown = chunks.where(paths.is_shown_kind(F.col("kind"), anchors) & paths.in_scope(F.col("path_key"), scope)).withColumnRenamed("path_key", "path").where(F.col("path").isNotNull())
    depth = retrieval.store_limit(s.limit, s.mode)
    tokens = [c for c in ("query_tokens",) if c in queries.columns and "tokens" in chunks.columns]
    columns = ["row_id", "path", "start_line", "end_line", "chunk_type", "kind", "text", "context_prev", "context_next", *(["tokens"] if tokens else [])]
    dense = retrieval.class_top_k(retrieval.scored_pairs(queries.select("query_id", "query_vector", *tokens), shown), depth)
    words = index.search(queries, depth, shown.select("row_id")) if index else lexical.bm25(shown.select("row_id", "text"), queries, depth, "row_id")
    found = words.select("query_id", "row_id", F.col("lexical_rank").alias("branch_rank"), F.col("score").alias("secondary_score"))
    # lexical matches are scored by vector as well: their own score stays as the second one
    by_words = found.join(shown, "row_id").join(queries.select("query_id", "query_vector", *tokens), "query_id").withColumn("score", vectors.dot(F.col("query_vector"), F.col("embedding")))
    both = retrieval.hybrid_union(dense.select("query_id", "class", "branch_rank", "score", *tokens, *columns), by_words.select("query_id", "branch_rank", "score", "secondary_score", *tokens, *columns))
    if s.rerank and tokens:
        both = retrieval.rerank(both, ["query_id"], vectors.max_sim(F.col("query_tokens"), F.col("tokens")), s.rerank_depth).drop("rank", "dense_rank", "dense_score")
    capped = ranking.candidate_cap(both, ["query_id"], s.max_candidates)
    rows = retrieval.shown_columns(capped).withColumn("score", ranking.boosted(F.col("score"), F.col("path"), F.col("chunk_type"), s.mode)).withColumn("is_anchor", F.col("kind") == "anchor")
    chosen = ranking.select_by_mode(rows, ["query_id"], s.limit, s.per_file, s.mode)
    cut = ranking.byte_budget(chosen, ["query_id"], s.max_snippet_bytes, s.max_total_snippet_bytes)
    return ranking.match_percent(cut, ["query_id"])


def search_rows(chunks: DataFrame, queries: DataFrame, settings: Settings = Settings(), **more) -> DataFrame:
    """``search`` in the shape of output rows."""
    return present.output_rows(search(chunks, queries, settings, **more))
