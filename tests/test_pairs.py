"""Pairs of the block operator against brute force: odd vectors, copies, ties, many blocks and groups."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hayloft.functions import vectors
from hayloft.operators import pairs, ranking, ranks
from hayloft.plans import catalogue

from .conftest import SF

SCHEMA = "row_id string, path string, start_line int, is_anchor boolean, embedding array<float>"
ODD = [None, [], [1.0, None, 2.0], [float("nan"), 1.0, 0.0], [float("inf"), 0.0, 0.0], [0.5], [0.5, 0.25, 1.0, 9.0], [1e30, -1e30, 1.0]]


def chunks(spark, n=400):
    rng = np.random.default_rng(5)
    plain = [[float(x) for x in rng.integers(-2, 3, 3) / 4] for _ in range(n)]  # few values, so many ties
    return spark.createDataFrame([(str(k), f"f{k % 23}", k % 4, k % 5 == 0, v) for k, v in enumerate([*plain, *ODD, *ODD])], SCHEMA)


def queries(spark):
    return spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [0.5]), (2, None), (3, [1.0, None, 0.0]), (4, [0.0, 0.0, 0.0]), (5, [0.1, 0.2, float("nan")])], "query_id long, query_vector array<float>")


def crossed(spark):
    return chunks(spark).crossJoin(queries(spark)).withColumn("score", vectors.dot(F.col("query_vector"), F.col("embedding"))).drop("embedding", "query_vector")


def same(a, b, *columns):
    found = [sorted(map(repr, x.select(*columns).collect())) for x in (a, b)]
    assert found[0] == found[1] and found[0]


def test_every_score_is_that_of_the_rows(spark):
    same(pairs.every_score(queries(spark), chunks(spark)), crossed(spark), "query_id", "row_id", "score")
    same(pairs.every_score(queries(spark), chunks(spark), digits=True), crossed(spark).withColumn("score", F.round("score", 6) + 0.0), "query_id", "row_id", "score")


@pytest.mark.parametrize("digits", [True, False])
@pytest.mark.parametrize("group", [(), ("path",), ("start_line", "is_anchor")])
def test_best_of_each_group(spark, digits, group):
    def best(rows):
        score = F.round("score", 6) if digits else F.col("score")
        order = Window.partitionBy("query_id", *group).orderBy(score.desc(), "path", "row_id")
        return rows.withColumn("n", F.row_number().over(order)).where("n <= 3")

    found = pairs.best_pairs(queries(spark), chunks(spark), [pairs.Cut(3, group)], ["path", "row_id"], digits=digits)
    same(best(found), best(crossed(spark)), "query_id", "row_id", "n", "score")


def test_choice_by_mode_from_what_is_handed_out(spark):
    def chosen(rows):
        return ranking.select_by_mode(rows.withColumn("secondary_score", F.lit(None).cast("double")).withColumn("num_lines", F.lit(1)), ["query_id"], 20, 1, "debug")

    rows = chunks(spark).withColumn("bucket", F.lit("code"))
    found = pairs.best_pairs(queries(spark), rows, ranking.mode_cuts(20), ["path", "start_line", "row_id"]).drop("bucket")
    assert found.count() < crossed(spark).count()
    same(chosen(found), chosen(crossed(spark)), "query_id", "row_id", "rank")


def test_few_pairs_leave_a_task_over_many_blocks():
    rng = np.random.default_rng(6)
    rows, asked = rng.normal(size=(3000, 4)), rng.normal(size=(5, 4))
    q = pairs.Vectors(pa.array(list(asked)))
    chooser, found = pairs._Chooser(pairs.Cut(10, ("g",)), 5, True), []
    for start in range(0, 3000, 100):
        some = rows[start : start + 100]
        table = pa.table({"g": pa.array(np.arange(start, start + 100) % 2)})
        chooser.block(table)
        score, null = pairs.products(q, pairs.Vectors(pa.array(list(some))))
        x, y = np.divmod(chooser.choose(0, score, null), 100)
        found += [(int(a), int(b) + start) for a, b in zip(x, y, strict=True)]
    exact = pairs.rounded(asked @ rows.T)
    for a in range(5):
        for g in range(2):
            own = np.arange(g, 3000, 2)
            assert {(a, int(r)) for r in own[np.argsort(-exact[a, own], kind="stable")[:10]]} <= set(found)
    assert len(found) < 3000  # of 15,000


def test_six_digits_as_spark_rounds(spark):
    given = [0.1234565, -0.1234565, 1.0000005, 2.5e-7, 0.0000005, 4.35e-5, 1e22, float("inf"), 123456.7890125, -0.0]
    want = [r[0] for r in spark.createDataFrame([(x,) for x in given], "x double").select(F.round("x", 6) + 0.0).collect()]
    assert [repr(float(x)) for x in pairs.rounded(np.array(given))] == [repr(x) for x in want]


@pytest.mark.parametrize("name", ["candidate_limits", "compact_paths", "deterministic_order", "keep_best_results", "match_percent", "mode_selection_debug", "hybrid_union_dedup", "structural_boost_modes", "rerank_top50", "knn_exact_topk"])
def test_pairs_are_made_in_blocks(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan
    assert name == "rerank_top50" or "query_vector" not in plan  # no join with them


def test_max_sim_in_blocks(spark):
    tokens = [[ODD[6][:3], [0.0, 1.0, 2.0]], [], None, [[1.0, None, 2.0]], [None, [0.25, 0.5, 1.0]], [[float("nan"), 0.0, 0.0], [1.0, 1.0, 1.0]], [[0.5]], [[-1.0, -1.0, -1.0]]]
    rows = spark.createDataFrame(list(enumerate(tokens)), "doc long, tokens array<array<double>>")
    asked = spark.createDataFrame([(0, [[1.0, 2.0, 3.0], [0.5, 0.0, -1.0]]), (1, []), (2, [[1.0, 0.0, 0.5], None])], "query_id long, query_vectors array<array<double>>")
    want = rows.where("tokens is not null").crossJoin(asked).withColumn("score", vectors.max_sim(F.col("query_vectors"), F.col("tokens")))
    same(pairs.every_max_sim(asked, rows.where("tokens is not null")), want, "query_id", "doc", "score")


def test_every_product_is_that_of_the_rows(spark, monkeypatch):
    rows = chunks(spark).withColumns({"a": F.lit(1.25), "b": F.col("start_line") + 0.5})
    want = crossed(spark).withColumn("n", F.explode(F.array(F.lit("one"), F.lit("two"))))
    want = want.withColumn("score", F.round(F.when(F.col("n") == "one", F.col("score") * 1.25).otherwise(F.col("score") * 1.25 * (F.col("start_line") + 0.5)), 6) + 0.0)
    for stack in (1 << 20, 64):  # one tile, and several queries at a time
        monkeypatch.setattr(pairs, "STACK_PAIRS", stack)
        monkeypatch.setattr(pairs, "BLOCK_QUERIES", 2)
        found = pairs.every_product(queries(spark), rows, {"one": ("a",), "two": ("a", "b")}, "n", digits=True)
        same(found, want, "query_id", "row_id", "n", "score")


@pytest.mark.parametrize("size", [40, 1 << 15])
def test_every_rank_is_that_of_the_window(spark, monkeypatch, size):
    monkeypatch.setattr(ranks, "BLOCK_ROWS", size)
    monkeypatch.setattr(ranks, "TILE", 4)
    rows = chunks(spark).unionByName(chunks(spark, 30).withColumn("row_id", F.concat(F.lit("x"), "row_id")))
    large = spark.createDataFrame([(9, [1e12, 3e14, 2.0]), (10, [-1e12, 1e9, 1e9]), (11, [1e-7, 1e-7, 1e-7])], "query_id long, query_vector array<float>")
    asked = queries(spark).unionByName(large)
    score = F.round(vectors.dot(F.col("query_vector"), F.col("embedding")), 6) + 0.0
    order = Window.partitionBy("query_id").orderBy(score.desc(), "path", "start_line", "row_id")
    want = rows.crossJoin(asked).withColumn("rank", F.row_number().over(order))
    found = ranks.every_rank(asked, rows, [F.col("path"), F.col("start_line"), F.col("row_id")], ["row_id", "path"])
    same(found, want, "query_id", "row_id", "path", "rank")


def test_facts_of_scores_are_those_of_the_pairs(spark):
    rows = chunks(spark).where("not coalesce(exists(embedding, x -> x > 1e29 and x < 1e31), false)")
    good = F.when(~F.isnan("score") & (F.abs("score") < float("inf")), F.col("score"))
    want = pairs.every_score(queries(spark), rows).groupBy("query_id").agg(F.count(good).alias("n"), F.avg(good).alias("mean"), F.stddev_pop(good).alias("std")).collect()
    found = {r.query_id: r for r in pairs.score_facts(queries(spark), rows).collect()}
    for r in want:
        got = found[r.query_id]
        assert got.n == r.n
        for a, b in ((got["mean"], r["mean"]), (got["std"], r["std"])):
            assert (a is None and b is None) or abs(a - b) <= 1e-12 * max(1.0, abs(b))
    percent = lambda frame, **more: ranking.match_percent(frame, ["query_id"], **more)
    same(percent(pairs.every_score(queries(spark), rows), known=pairs.score_facts(queries(spark), rows)), percent(pairs.every_score(queries(spark), rows)), "query_id", "row_id", "match_pct")


def test_queries_of_a_row_follow_each_other(spark):
    for found in (pairs.every_score(queries(spark), chunks(spark)), ranks.every_rank(queries(spark), chunks(spark), [F.col("path"), F.col("row_id")], ["row_id"])):
        got = [r.row_id for r in found.select("row_id").collect()]
        assert len(got) == 6 * 416 and 1 + sum(a != b for a, b in zip(got[:-1], got[1:], strict=True)) == 416


def test_numbers_keep_the_order_of_scores():
    score = np.array([[-np.inf, -1e300, -1e9, -999999999.5, -1.000001, -1.0, 0.0, 1e-6, 0.5, 999999999.999999, 1e9, 1e16, np.inf, np.nan]])
    number = ranks.numbers(score, None)
    assert (np.diff(number[0]) > 0).all() and number.min() > ranks.NULL and number[0, 6] == 0
    assert (np.diff(ranks.buckets(number)[0]) <= 0).all()
    data, size = ranks.to_bytes(np.array([0, 127, 128, 1 << 62, (1 << 64) - 1], np.uint64))
    assert size.tolist() == [1, 1, 2, 9, 10] and ranks.from_bytes(data).tolist() == [0, 127, 128, 1 << 62, (1 << 64) - 1]


def test_ranks_move_no_pairs(spark):
    plan = catalogue.deterministic_order(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "score" not in plan


def test_equal_scores_of_a_block_are_side_by_side(spark):
    rows = catalogue.structural_boost_modes(spark, SF).select(F.spark_partition_id().alias("task"), "score").toPandas()
    of = [part.score for _, part in rows.groupby("task", sort=False)]
    assert len(rows) > 1000 and all(part.is_monotonic_increasing for part in of)


@pytest.mark.parametrize("name", ["maxsim_float", "maxsim_quantized"])
def test_late_interaction_is_made_in_blocks(spark, name):
    assert "MapInArrow" in catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
