"""Shapes of results for people, agents and programs; the long work is done before, on limited rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hayloft.functions import paths
from hayloft.functions.text import lines, lines_left_out, sanitised, snippet


def output_rows(results: DataFrame, mode: str = "default") -> DataFrame:
    """query_id, rank, path, start_line, end_line, score, match_pct, snippet, more_lines: sanitised, lines counted from 0."""
    return results.select("query_id", "rank", sanitised(F.col("path")).alias("path"), "start_line", (F.col("start_line") + F.col("num_lines")).alias("end_line"), "score", "match_pct", sanitised(snippet(F.col("content"), mode)).alias("snippet"), lines_left_out(F.col("content"), mode).alias("more_lines"))


def sections(results: DataFrame) -> DataFrame:
    """Results grouped as code, docs, graphs, numbered through."""
    b = paths.bucket(F.col("path"))
    order = Window.partitionBy("query_id").orderBy(paths.bucket_rank(F.col("section")), "rank")
    return results.withColumn("section", b).withColumn("number", F.row_number().over(order))


def compact(results: DataFrame) -> DataFrame:
    """Distinct paths of each query in the order of their best rank."""
    return results.groupBy("query_id", "path").agg(F.min("rank").alias("rank")).orderBy("query_id", "rank")


def compact_by_name(results: DataFrame) -> DataFrame:
    return results.select("query_id", "path").distinct().orderBy("query_id", "path")


def as_json(results: DataFrame) -> DataFrame:
    """One JSON document per query: its results in rank order and their number."""
    row = F.struct("rank", "path", "start_line", "end_line", F.round("score", 6).alias("score"), "match_pct", "snippet")
    return results.groupBy("query_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(row)).alias("results"), F.count(F.lit(1)).alias("count"))).alias("json"))


def agent_lines(content: Column, limit: int = 16) -> Column:
    """The first lines worth reading: no blanks, no lone brackets."""
    kept = F.filter(lines(content), lambda x: ~F.trim(x).rlike(r"^[\[\](){};,]*$"))
    return F.array_join(F.slice(kept, 1, limit), "\n")


def file_count(results: DataFrame) -> DataFrame:
    return results.groupBy("query_id").agg(F.countDistinct("path").alias("files"))


def evidence_packs(results: DataFrame, per_file: int = 5) -> DataFrame:
    """Results by file: files by best score, then path; evidence by place; ``low_confidence`` where nothing matches well."""
    item = F.struct("start_line", "num_lines", "score", "content")
    packs = results.groupBy("query_id", "path").agg(F.max("score").alias("best"), F.max("match_pct").alias("best_pct"), F.slice(F.array_sort(F.collect_list(item)), 1, per_file).alias("evidence"))
    order = Window.partitionBy("query_id").orderBy(F.round("best", 6).desc(), "path")
    everyone = Window.partitionBy("query_id")
    return packs.withColumn("file_rank", F.row_number().over(order)).withColumn("low_confidence", F.max("best_pct").over(everyone) < 55)


def store_list(files: DataFrame) -> DataFrame:
    """Stores (store, size, changed by file) with their number of files, bytes and last change, newest first."""
    stores = files.groupBy("store").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.max("changed").alias("newest"))
    return stores.orderBy(F.desc("newest"), "store")
