"""Product codes: the same results as scoring every row, from a short list."""

import numpy as np

from hayloft.operators import ann


def brute(rows, queries, k):
    out = []
    for q, v in queries:
        scored = sorted((-round(float(np.dot(np.array(v, np.float64)[: len(x)], np.array(x, np.float64)[: len(v)])), 6), i) for i, x in rows if x is not None)
        out += [(q, i, r) for r, (_, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def got(found):
    return sorted((r.query_id, r.vec_id, r["rank"]) for r in found.collect())


def test_same_as_brute_force_from_a_shortlist(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 12))
    rows = [(k, [float(x) for x in (centres[k % 40] + rng.normal(size=12) * 0.05)]) for k in range(2400)]
    rows += [(5000 + k, rows[7][1]) for k in range(30)] + [(6000, None), (6001, [1.0]), (6002, [0.0] * 12)]
    queries = [(k, rows[k * 11][1]) for k in range(15)] + [(90, [0.0] * 12)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    rows = [(i, None if x is None else np.array(x, np.float32)) for i, x in rows]
    asked = spark.createDataFrame(queries, "query_id long, query_vector array<float>")
    queries = [(i, np.array(x, np.float32)) for i, x in queries]
    index = ann.ProductIndex.build(table, fit_rows=500)
    assert index.codes.count() == 2432
    assert got(index.search(asked, 10)) == brute(rows, queries, 10)
    short = {r.query_id: r["count"] for r in index.shortlist(asked, 10).groupBy("query_id").count().collect()}
    assert short[90] == 2432 and max(n for q, n in short.items() if q != 90) < 0.15 * 2432  # a zero vector scores all alike
    monkeypatch.setattr(ann, "SCAN_QUERIES", 4)
    assert got(index.search(asked, 3)) == brute(rows, queries, 3)
    assert len(got(index.search(asked, 3000))) == 16 * 2432


def test_empty_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, query_vector array<float>")
    assert ann.ProductIndex.build(none).search(asked, 3).collect() == []
    one = ann.ProductIndex.build(spark.createDataFrame([(4, [1.0, 2.0, 3.0])], "vec_id long, embedding array<float>"))
    assert got(one.search(asked, 3)) == [(1, 4, 1)] and one.search(asked.where("query_id < 0"), 3).collect() == []
