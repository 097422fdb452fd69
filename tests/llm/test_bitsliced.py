import math
import random

import pytest
from pyspark.sql import functions as F

from hayloft.llm import bitsliced as B


def brute(rows, k):
    good = [(n, i, [math.floor(64 * x) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in good:
        if i % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for m, j, v in good if m != n)
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [1 << 14, 70])
def test_same_as_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(B, "BLOCK_ROWS", block)
    monkeypatch.setattr(B, "QUERY_BLOCK", 3)
    rng = random.Random(2)
    rows = [(k, [rng.uniform(-1, 1) * rng.choice([0.1, 1, 3]) for _ in range(9)]) for k in range(230)]
    rows += [(300 + k, rows[0][1]) for k in range(40)] + [(400, None), (420, [1.0, None]), (440, [float("nan"), 1.0]), (460, [float("inf")]), (480, []), (500, [0.0] * 9), (1, rows[5][1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("row", F.lit("mine"))
    got = B.top_k(vectors, F.col("vec_id") % 20 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 20)


def test_few_or_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert B.top_k(spark.createDataFrame([], schema), F.col("vec_id") % 20 == 0).collect() == []
    assert B.top_k(spark.createDataFrame([(1, [1.0])], schema), F.col("vec_id") % 20 == 0).collect() == []
    got = B.top_k(spark.createDataFrame([(0, [1.0]), (1, [-0.51]), (20, None)], schema), F.col("vec_id") % 20 == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, -33 * 64)]


def test_large_components(spark):
    """Scores of any size are exact while they fit 64 bits; one that is chosen and does not is an error."""
    big = float(1 << 40)
    rows = [(0, [0.25, -0.5, 0.0, 1.0]), (1, [big, 3.0, 1.0, 0.0]), (2, [1.0, -big, 3.0, 4.0]), (3, [-big, big, big, -big]), (4, [-1.5, 0.0, 2.0**54, 0.0]), (5, [1.0, 2.0, 3.0, 4.0]), (6, [0.0, 0.0, 1e300, 0.0])]
    docs = lambda r: spark.createDataFrame(r, "vec_id long, embedding array<double>")
    got = B.top_k(docs(rows), F.col("vec_id") % 20 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows[:6], 20)
    with pytest.raises(Exception, match="leaves 64 bits"):
        B.top_k(docs([(0, [big]), (1, [big])]), F.col("vec_id") % 20 == 0).collect()


def test_null_ids_are_candidates(spark):
    rows = [(0, [1.0]), (None, [3.0]), (1, [2.0]), (None, [2.0]), (20, None), (7, [2.0])]
    got = B.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, None, 12288), (0, 2, 1, 8192), (0, 3, 7, 8192), (0, 4, None, 8192)]
