"""Relevance evaluation: hits against expectations, summaries, gates."""

from __future__ import annotations

import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hayloft.operators import lexical

CASE = "case_id string, query_text string, mode string, k int, per_file int, expect_any array<string>, expect_all array<string>, expect_any_regex array<string>, expect_all_regex array<string>"


def load_suite(spark: SparkSession, text: str, only: tuple[str, ...] = ()) -> DataFrame:
    """Cases of a TOML suite (``[[case]]`` tables: id, query, expectations), all or the named ones."""
    # fixed values: defaults of a case
    rows = []
    for c in tomllib.loads(text).get("case", []):
        if not only or c["id"] in only:
            rows.append((c["id"], c["query"], c.get("mode", "balanced"), c.get("k", 20), c.get("per_file", 3), c.get("expect_any_path_contains", []), c.get("expect_all_path_contains", []), c.get("expect_any_path_regex", []), c.get("expect_all_path_regex", [])))
    missing = set(only) - {r[0] for r in rows}
    if missing:
        raise ValueError(f"no such cases: {', '.join(sorted(missing))}")
    return spark.createDataFrame(rows, CASE)


def holding_documents(docs: DataFrame, items: DataFrame, index: lexical.LexicalIndex) -> DataFrame:
    """item_id, doc_id where a whole document holds all words of an item (item_id, text) in a row; case and marks don't count.

    ``index`` has the postings of the items' words over ``docs``: only documents with
    an item's rarest word are read and compared as a whole.
    """
    words = lambda c: lexical.terms(F.coalesce(c, F.lit("")))
    wanted = items.select("item_id", words(F.col("text")).alias("item")).where(F.size("item") > 0)
    found = index.rows.where(F.col("term") != "").select("term", F.col("row_id").alias("doc_id"))
    common = found.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    each = wanted.select("item_id", F.explode(F.array_distinct("item")).alias("term")).join(common, "term", "left")
    rarest = each.groupBy("item_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term")).alias("t")).where(F.col("t.n") > 0).select("item_id", "t.term")
    pairs = found.join(rarest, "term").select("item_id", "doc_id")
    cut = docs.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", words(F.col("text")).alias("w"))
    padded = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    return pairs.join(wanted, "item_id").join(cut, "doc_id").where(F.contains(padded("w"), padded("item"))).select("item_id", "doc_id")


def matched(path: Column, expected: Column, is_regex: Column) -> Column:
    """Whether a path fits an expectation, by substring or pattern."""
    return F.when(is_regex, F.regexp_like(path, expected)).otherwise(F.contains(path, expected))


def score_cases(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """case_id, first_hit_rank, reciprocal_rank, any_ok, all_ok, missing, passed.

    ``cases`` has case_id, mode, expect_any and expect_all (arrays of substrings), and
    may have expect_any_regex and expect_all_regex (patterns);
    ``hits`` has case_id, rank, path.  A case without hits still counts.
    """
    nothing = F.array().cast("array<string>")
    for name in ("expect_any_regex", "expect_all_regex"):
        if name not in cases.columns:
            cases = cases.withColumn(name, nothing)
    tagged = lambda name, regex: F.transform(name, lambda x: F.struct(x.alias("expected"), F.lit(regex).alias("regex")))
    cases = cases.withColumn("_any", F.concat(tagged("expect_any", False), tagged("expect_any_regex", True))).withColumn("_all", F.concat(tagged("expect_all", False), tagged("expect_all_regex", True)))
    wanted = cases.select("case_id", F.explode(F.array_distinct(F.concat("_any", "_all"))).alias("e"))
    found = hits.join(wanted, "case_id").where(matched(F.col("path"), F.col("e.expected"), F.col("e.regex"))).groupBy("case_id", "e").agg(F.min("rank").alias("rank"))
    per = found.groupBy("case_id").agg(F.collect_set("e").alias("found"), F.min("rank").alias("first_hit_rank"))
    joined = cases.join(per, "case_id", "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<expected:string,regex:boolean>>")))
    any_ok = (F.size("_any") == 0) | F.arrays_overlap("_any", "found")
    missing = F.array_sort(F.transform(F.array_except("_all", "found"), lambda e: e["expected"]))
    return joined.select(
        "case_id",
        "mode",
        "first_hit_rank",
        F.coalesce(1.0 / F.col("first_hit_rank"), F.lit(0.0)).alias("reciprocal_rank"),
        any_ok.alias("any_ok"),
        (F.size(missing) == 0).alias("all_ok"),
        missing.alias("missing"),
        (any_ok & (F.size(missing) == 0)).alias("passed"),
    )


def summarise(scored: DataFrame) -> DataFrame:
    """Totals by mode and over all (mode null): cases, passed, pass rate, mean reciprocal rank, mean hit rank."""
    return scored.rollup("mode").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("passed").alias("passed"),
        F.round(F.avg(F.col("passed").cast("double")), 6).alias("pass_rate"),
        F.round(F.avg("reciprocal_rank"), 6).alias("mrr"),
        F.round(F.avg("first_hit_rank"), 6).alias("mean_hit_rank"),
    )


def gate(pass_rate: float, mrr: float, baseline: tuple[float, float] | None = None, floor: tuple[float, float] = (0.0, 0.0), drop: float = 0.02) -> list[str]:
    """Which measures fall below the larger of an explicit floor and the baseline less the allowed drop."""
    out = []
    for k, (name, value) in enumerate((("pass_rate", pass_rate), ("mrr", mrr))):
        least = max(floor[k], baseline[k] - drop if baseline else 0.0)
        if value < least:
            out.append(f"{name} {value:.4f} < {least:.4f}")
    return out
