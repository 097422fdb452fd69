import random

import pytest
from pyspark.sql import functions as F

from hayloft.operators import ranking

SCHEMA = "q int, path string, content string, score double, secondary_score double, row_id string, start_line int, num_lines int, chunk_type string, is_anchor boolean"


def make(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def greedy(rows, limit, per_file, mode):
    """The selection rule as a plain loop over ranked rows."""
    q = ranking.quotas(limit, mode)
    bucket = lambda p: "graph" if p.endswith((".mmd", ".mermaid")) else "docs" if p.endswith((".md", ".json")) else "code"
    taken, out, files = set(), [], {}
    eligible = []
    for r in rows:
        key = (r[1], r[6])
        if r[9] or key in {(x[1], x[6]) for x in eligible}:
            continue
        n = files.get(r[1], 0)
        if per_file and n >= per_file:
            files[r[1]] = n + 1
            continue
        files[r[1]] = n + 1
        eligible.append(r)
    for b in ranking.BUCKETS:
        for r in [x for x in eligible if bucket(x[1]) == b][: q[b]]:
            out.append(r)
            taken.add((r[1], r[6]))
    for r in [*eligible, *rows]:
        if (r[1], r[6]) not in taken:
            out.append(r)
            taken.add((r[1], r[6]))
    return [x[5] for x in out[:limit]]


@pytest.mark.parametrize("mode", ["discovery", "implementation", "planning", "debug"])
def test_mode_selection_is_the_greedy_rule(spark, mode):
    rng = random.Random(3)
    rows = []
    for q in range(40):
        for k in range(rng.randint(0, 30)):
            path = rng.choice(["a.py", "b.rs", "c.md", "d.json", "e.mmd", "f.mermaid", "g.go"])
            rows.append((q, path, "", rng.randint(0, 50) / 10, None, f"{k:03}", rng.randint(0, 3), 1, None, rng.random() < 0.2))
    for limit, per_file in ((1, 1), (2, 0), (5, 1), (12, 2)):
        got = ranking.select_by_mode(make(spark, rows), ["q"], limit, per_file, mode).orderBy("q", "rank").collect()
        for q in range(40):
            own = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[3], r[1], r[6], r[5], r[7]))
            assert [r.row_id for r in got if r.q == q] == greedy(own, limit, per_file, mode)


def test_quotas_fill_the_limit():
    for mode in ranking.SHARES:
        for limit in range(0, 60):
            assert sum(ranking.quotas(limit, mode).values()) == limit


def test_order_breaks_ties_by_place(spark):
    rows = [(0, "b.rs", "", 1.0, None, "b2", 10, 1, None, False), (0, "a.rs", "", 1.0, None, "a1", 5, 1, None, False), (0, "a.rs", "", 1.0000000001, None, "a0", 5, 1, None, False)]
    got = ranking.ranked(make(spark, rows), ["q"]).orderBy("rank").collect()
    assert [r.row_id for r in got] == ["a0", "a1", "b2"]


def test_boosts(spark):
    rows = [(0, "src/main.rs", "", 1.0, None, "1", 0, 1, "function", False), (0, "src/main.rs", "", 1.0, None, "2", 0, 1, "block", False), (0, "README.md", "", 1.0, None, "3", 0, 1, "other", False), (0, "a.test.ts", "", 1.0, None, "4", 0, 1, None, False), (0, "x.mmd", "", 1.0, None, "5", 0, 1, None, False)]
    got = make(spark, rows).select("row_id", ranking.boosted(F.col("score"), F.col("path"), F.col("chunk_type")).alias("s")).orderBy("row_id").collect()
    assert [r.s for r in got] == pytest.approx([1.25, 1.0, 0.5, 0.85, 1.0])


def test_match_percent(spark):
    nan = float("nan")
    rows = [(1, "a", "", 0.5, None, "1", 0, 1, None, False), (2, "a", "", 1.0, None, "2", 0, 1, None, False), (2, "a", "", 3.0, None, "3", 0, 1, None, False), (2, "a", "", nan, None, "4", 0, 1, None, False), (3, "a", "", 2.0, None, "5", 0, 1, None, False), (3, "a", "", 2.0, None, "6", 0, 1, None, False)]
    got = {r.row_id: r.match_pct for r in ranking.match_percent(make(spark, rows), ["q"]).collect()}
    assert got == {"1": 50, "2": 27, "3": 73, "4": None, "5": 99, "6": 99}


def test_byte_budget_cuts_between_characters(spark):
    rows = [(0, "a", "ééé", 1.0, None, "1", 0, 1, None, False), (0, "b", "abcdef", 0.9, None, "2", 0, 1, None, False), (0, "c", "xyz", 0.8, None, "3", 0, 1, None, False)]
    ranked = ranking.ranked(make(spark, rows), ["q"])
    got = [r.content for r in ranking.byte_budget(ranked, ["q"], 5, 7).orderBy("rank").collect()]
    assert got == ["éé", "abc", ""]
    got = [r.content for r in ranking.byte_budget(ranked, ["q"], 5, 100).orderBy("rank").collect()]
    assert got == ["éé", "abcde", "xyz"]


def test_merge_and_keep_best(spark):
    rows = [(0, "a", "1", 1.0, None, "1", 0, 5, None, False), (0, "a", "2", 2.0, None, "2", 10, 5, None, False), (0, "a", "3", 1.0, None, "3", 40, 5, None, False), (0, "b", "4", 1.0, None, "4", 0, 5, None, False)]
    got = {(r.path, r.start_line): (r.num_lines, r.content) for r in ranking.merge_adjacent(make(spark, rows), ["q"]).collect()}
    assert got == {("a", 0): (15, "1\n// ...\n2"), ("a", 40): (5, "3"), ("b", 0): (5, "4")}
    assert ranking.keep_best(make(spark, [*rows, (0, "a", "x", 9.0, None, "9", 0, 5, None, False)]), ["q"]).where("path = 'a' and start_line = 0").first().row_id == "9"


def test_diagnostics(spark):
    rows = spark.createDataFrame([("b", "b"), ("a", "b"), ("a", None), ("a", None), ("a", "a")], "code string, path_key string")
    assert [tuple(r) for r in ranking.distinct_diagnostics(rows).collect()] == [("a", None), ("a", "a"), ("a", "b"), ("b", "b")]
