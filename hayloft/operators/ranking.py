"""Boosts, deterministic order, selection and output budgets of ranked results.

All are window plans partitioned by the query columns ``by``; nothing is
collected.  A result has path, start_line, num_lines, row_id, score and
secondary_score, and may have is_anchor and chunk_type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hayloft.functions import paths
from hayloft.functions.text import utf8_cut
from hayloft.operators.pairs import Cut

# fixed values: factors for definitions, tests, docs and graphs by mode
WEIGHTS = {
    "balanced": (1.25, 0.85, 0.5, 1.0),
    "discovery": (1.15, 0.9, 1.0, 1.05),
    "implementation": (1.25, 0.85, 0.65, 0.9),
    "planning": (1.1, 0.9, 1.15, 1.1),
    "debug": (1.2, 0.95, 0.85, 0.95),
}
# fixed values: shares of code, docs and graphs by mode
SHARES = {"discovery": (3, 4, 3), "implementation": (6, 2, 2), "planning": (2, 6, 2), "debug": (7, 2, 1), "balanced": (4, 3, 3)}
BUCKETS = ("code", "docs", "graph")
DEFINITIONS = ("function", "class", "interface", "method", "typealias")


def known_chunk_type(name: Column) -> Column:
    """A stored chunk type: unknown ones are ``other``, none stays none."""
    low = F.lower(name)
    return F.when(low.isin(*DEFINITIONS, "block", "other"), low).when(name.isNotNull(), "other")


def factors(path: Column, chunk_type: Column, mode: str = "balanced") -> list[Column]:
    """The mode's factors of a row; a graph is not also a doc."""
    definition, test, doc, graph = WEIGHTS[mode]
    return [
        F.when(chunk_type.isin(*DEFINITIONS), definition).otherwise(1.0),
        F.when(paths.is_test(path), test).otherwise(1.0),
        F.when(paths.ranks_as_graph(path), graph).when(paths.ranks_as_doc(path), doc).otherwise(1.0),
    ]


def boosted(score: Column, path: Column, chunk_type: Column, mode: str = "balanced") -> Column:
    """The score times the mode's factors."""
    for factor in factors(path, chunk_type, mode):
        score = score * factor
    return score


def result_order() -> list[Column]:
    """Score, then secondary score (both to six decimals), then place."""
    return [
        F.round(F.col("score"), 6).desc(),
        F.round(F.coalesce("secondary_score", F.lit(0.0)), 6).desc(),
        F.col("path").asc(),
        F.col("start_line").asc(),
        F.coalesce("row_id", F.lit("")).asc(),
        F.col("num_lines").asc(),
    ]


def ranked(results: DataFrame, by: list[str], name: str = "rank") -> DataFrame:
    return results.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*result_order())))


def quotas(limit: int, mode: str) -> dict[str, int]:
    """Places for each bucket: a minimum each, the rest by share with largest remainders."""
    least = {"code": int(limit >= 1), "docs": int(limit >= 2), "graph": int(limit >= 3 and mode != "debug")}
    rest = limit - sum(least.values())
    if rest <= 0:
        return least
    shares = dict(zip(BUCKETS, SHARES[mode], strict=True))
    whole = sum(shares.values())
    got = {b: rest * s // whole for b, s in shares.items()}
    by_remainder = sorted(BUCKETS, key=lambda b: -(rest * shares[b] % whole))
    for b in by_remainder[: rest - sum(got.values())]:
        got[b] += 1
    return {b: least[b] + got[b] for b in BUCKETS}


def select_balanced(results: DataFrame, by: list[str], limit: int, per_file: int) -> DataFrame:
    """At most ``per_file`` rows of each path (0: any number), then the first ``limit``."""
    out = results
    if per_file > 0:
        inside = Window.partitionBy(*by, "path").orderBy(*result_order())
        out = out.withColumn("_in_file", F.row_number().over(inside)).where(F.col("_in_file") <= per_file).drop("_in_file")
    return ranked(out, by).where(F.col("rank") <= limit)


def select_by_mode(results: DataFrame, by: list[str], limit: int, per_file: int, mode: str) -> DataFrame:
    """Quotas for code, docs and graphs, then a fill in overall order, then whatever is left.

    First come eligible rows (no anchors, first of their path and line, within
    ``per_file`` of their path) up to their bucket's quota, bucket by bucket;
    then other eligible rows; then other distinct rows, anchors included.
    """
    if mode == "balanced":
        return select_balanced(results, by, limit, per_file)
    q = quotas(limit, mode)
    anchor = F.coalesce("is_anchor", F.lit(False))
    # one exchange by query and file serves all windows inside files
    base = results.repartition(*by, "path").withColumn("_bucket", paths.bucket(F.col("path"))).withColumn("_anchor", anchor)
    inside = lambda *more: Window.partitionBy(*by, "path", *more)
    base = base.withColumn("_copy", F.row_number().over(inside("start_line", "_anchor").orderBy(*result_order())))
    base = base.withColumn("_plain", ~F.col("_anchor") & (F.col("_copy") == 1))
    base = base.withColumn("_in_file", F.row_number().over(inside("_plain").orderBy(*result_order())))
    base = base.withColumn("_eligible", F.col("_plain") & (F.lit(per_file == 0) | (F.col("_in_file") <= per_file)))
    # of rows that aren't eligible only the first of a key that no eligible row has can ever count
    base = base.withColumn("_key", F.row_number().over(inside("start_line").orderBy(F.desc("_eligible"), *result_order()))).where(F.col("_eligible") | (F.col("_key") == 1))
    # beyond the limit a bucket's rows can't come in: few rows of each file group go on
    base = base.withColumn("_in_bucket", F.row_number().over(Window.partitionBy(*by, "_bucket", "_eligible").orderBy(*result_order()))).where(F.col("_in_bucket") <= limit)
    quota = F.when(F.col("_bucket") == "code", q["code"]).when(F.col("_bucket") == "docs", q["docs"]).otherwise(q["graph"])
    base = base.withColumn("_phase", F.when(F.col("_eligible") & (F.col("_in_bucket") <= quota), 1).when(F.col("_eligible"), 2).otherwise(3))
    order = Window.partitionBy(*by).orderBy(F.col("_phase"), F.when(F.col("_phase") == 1, paths.bucket_rank(F.col("_bucket"))).otherwise(0), *result_order())
    chosen = base.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return chosen.withColumnRenamed("_bucket", "bucket").drop("_copy", "_plain", "_in_file", "_eligible", "_in_bucket", "_phase", "_key", "_anchor")


def mode_cuts(limit: int) -> list[Cut]:
    """What ``select_by_mode`` with one row of a file can choose: the best ``limit`` files of each bucket by their best
    row that is no anchor and, as less than ``limit`` of them are eligible where others count, the best places.
    Rows need ``bucket``.
    """
    return [Cut(limit, ("bucket", "is_anchor"), ("path",)), Cut(2 * limit, ("bucket",), ("path", "start_line"))]


def candidate_cap(results: DataFrame, by: list[str], limit: int) -> DataFrame:
    """The first ``limit`` candidates of each query by score."""
    first = Window.partitionBy(*by).orderBy(F.desc("score"), "path", "row_id")
    return results.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= limit).drop("_n")


def limits_hit(results: DataFrame, by: list[str], limit: int, code: str = "max_candidates") -> DataFrame:
    """by, code, limit, observed for the queries that have more candidates than a cap lets through."""
    return results.groupBy(*by).agg(F.count(F.lit(1)).alias("observed")).where(F.col("observed") > limit).select(*by, F.lit(code).alias("code"), F.lit(limit).cast("long").alias("limit"), "observed")


def keep_best(results: DataFrame, by: list[str]) -> DataFrame:
    """The best row of each path and line."""
    w = Window.partitionBy(*by, "path", "start_line").orderBy(*result_order())
    return results.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def first_seen(candidates: DataFrame, by: list[str]) -> DataFrame:
    """The first row of each path and line by branch and rank in the branch."""
    w = Window.partitionBy(*by, "path", "start_line").orderBy("branch", "branch_rank")
    return candidates.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def byte_budget(results: DataFrame, by: list[str], per_result: int, total: int, content: str = "content") -> DataFrame:
    """Cuts each content to ``per_result`` bytes; if the sum passes ``total``, cuts in rank order to what is left."""
    cut = results.withColumn(content, utf8_cut(F.col(content), F.lit(per_result)))
    size = F.octet_length(content)
    everyone = Window.partitionBy(*by)
    before = everyone.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.greatest(F.lit(total) - F.coalesce(F.sum(size).over(before), F.lit(0)), F.lit(0)).cast("int")
    over = F.sum(size).over(everyone) > total
    return cut.withColumn("_left", left).withColumn("_over", over).withColumn(content, F.when(F.col("_over"), utf8_cut(F.col(content), F.col("_left"))).otherwise(F.col(content))).drop("_left", "_over")


def match_percent(results: DataFrame, by: list[str], score: str = "score", known: DataFrame | None = None) -> DataFrame:
    """``match_pct``: the logistic of the standard score in its query, as 0 to 99; null if the score is not finite.

    With fewer than two finite scores, or no spread, the score itself times 100.  What is ``known`` of stated
    queries (n, mean and std of the finite scores) goes to the results, which stay where they are.
    """
    s = F.col(score)
    finite = s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf"))
    good = F.when(finite, s)
    if known is None:  # sums by query, joined back: no query's results come together in one task
        facts = results.groupBy(*by).agg(F.count(good).alias("_n"), F.avg(good).alias("_mean"), F.stddev_pop(good).alias("_std"))
    else:
        facts = F.broadcast(known.select(*by, F.col("n").alias("_n"), F.col("mean").alias("_mean"), F.col("std").alias("_std")))
    plain = (F.col("_n") < 2) | (F.col("_std") <= 1e-9)
    value = F.when(plain, s * 100).otherwise(100 / (1 + F.exp(-(s - F.col("_mean")) / F.col("_std"))))
    # halves go up, without the decimals that F.round makes of every number
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(99.0), value))
    percent = F.when(finite, (F.floor(bounded) + F.when(bounded - F.floor(bounded) >= 0.5, 1).otherwise(0)).cast("int"))
    return results.join(facts, by).withColumn("match_pct", percent).drop("_n", "_mean", "_std")


def merge_adjacent(results: DataFrame, by: list[str], gap: int = 10) -> DataFrame:
    """Joins results of a path that start no further than ``gap`` lines after the end of the one before.

    Like the greedy scan it stands for, the end is that of the latest row, not the furthest.
    """
    w = Window.partitionBy(*by, "path").orderBy("start_line", "num_lines")
    starts = F.coalesce(F.col("start_line") > F.lag(F.col("start_line") + F.col("num_lines")).over(w) + gap, F.lit(True))
    grouped = results.withColumn("_group", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    piece = F.struct("start_line", "num_lines", "content")
    out = grouped.groupBy(*by, "path", "_group").agg(
        F.min("start_line").alias("start_line"),
        F.max_by(F.col("start_line") + F.col("num_lines"), F.struct("start_line", "num_lines")).alias("_end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["content"]), "\n// ...\n").alias("content"),
        F.count(F.lit(1)).alias("pieces"),
    )
    return out.withColumn("num_lines", F.col("_end") - F.col("start_line")).drop("_group", "_end")


def distinct_diagnostics(rows: DataFrame) -> DataFrame:
    """One row per (code, path); a missing path sorts first."""
    return rows.dropDuplicates(["code", "path_key"]).orderBy("code", F.col("path_key").asc_nulls_first())


def mix_counts(results: DataFrame, by: list[str]) -> DataFrame:
    """Numbers of candidates in all, by bucket, and of anchors."""
    b = paths.bucket(F.col("path"))
    anchor = F.coalesce("is_anchor", F.lit(False))
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(b == "code").alias("code"),
        F.count_if(b == "docs").alias("docs"),
        F.count_if(b == "graph").alias("graph"),
        F.count_if(anchor).alias("anchors"),
    )
