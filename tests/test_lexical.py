"""Stored postings and BM25 against plain Python."""

import math
import random
import re

from pyspark.sql import functions as F

from hayloft.operators import blockmax, evaluation, lexical


def brute(docs, queries, k):
    cut = {i: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w] for i, t in docs}
    n, mean = len(cut), sum(map(len, cut.values())) / len(cut)
    out = []
    for q, text in queries:
        words = {w for w in re.split(r"[\W_]+", (text or "").lower()) if w}
        scores = {}
        for i, w in cut.items():
            found = [x for x in words if x in w]
            if found:
                idf = {x: math.log(1 + (n - sum(x in v for v in cut.values()) + 0.5) / (sum(x in v for v in cut.values()) + 0.5)) for x in found}
                scores[i] = round(sum(idf[x] * w.count(x) * 2.2 / (w.count(x) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x in found), 6)
        out += [(q, r, i) for r, (i, _) in enumerate(sorted(scores.items(), key=lambda s: (-s[1], s[0]))[:k], 1)]
    return out


def sample():
    rng = random.Random(6)
    words = [f"w{k}" for k in range(40)] + ["\u00c9t\u00e9", "x9", "stra\u00dfe"]
    docs = [(k, " ".join(rng.choice(words) + rng.choice(["", ",", "!"]) for _ in range(rng.randint(0, 30)))) for k in range(80)] + [(90, None), (91, ""), (92, "...")]
    queries = [(k, " ".join(rng.choice([*words, "absent"]) for _ in range(rng.randint(0, 5)))) for k in range(12)] + [(20, None), (21, "W1 w1 w1")]
    return docs, queries


def test_whole_and_made_for_queries(spark, tmp_path, monkeypatch):
    docs, queries = sample()
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(queries, "query_id long, query_text string")
    want = brute(docs, queries, 7)
    stored = lexical.build_index(d, f"file://{tmp_path}/i")
    opened = lexical.LexicalIndex(spark, f"file://{tmp_path}/i")
    monkeypatch.setattr(lexical, "BROADCAST_TERMS", 3)
    monkeypatch.setattr(lexical, "QUERY_TERMS", 3)
    joined = lexical.bm25(d, q, 7)
    monkeypatch.undo()
    assert isinstance(lexical.word_table(d, q), lexical.WordTable)
    monkeypatch.setattr(lexical, "SCORED_CELLS", 40)
    few_at_a_time = lexical.bm25(d, q.select(F.concat(F.lit("q"), "query_id").alias("query_id"), "query_text"), 7).withColumn("query_id", F.substring("query_id", 2, 9).cast("long"))
    for found in (stored.search(q, 7), opened.search(q, 7), lexical.bm25(d, q, 7), joined, few_at_a_time):
        assert sorted((r.query_id, r.lexical_rank, r.row_id) for r in found.collect()) == sorted(want)
    stats = {r.term: (r.df, r.total) for r in stored.term_statistics().collect()}
    assert stats["w1"] == (sum("w1" in re.split(r"[\W_]+", t or "") for _, t in docs), sum(re.split(r"[\W_]+", t or "").count("w1") for _, t in docs)) and "" not in stats
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lexical.bm25(none, q, 7).collect() == [] and lexical.bm25(d, q.where("query_id < 0"), 7).collect() == []


def test_documents_that_hold_an_item(spark):
    docs = [(1, "One two, THREE four."), (2, "one two three"), (3, "zero one two three fours"), (4, "none"), (5, None), (6, "one two three four one two three four")]
    items = [(10, "two three four"), (11, "ONE"), (12, ""), (13, None), (14, "missing words"), (15, "three two")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    index = lexical.build_index(d, vocabulary=lexical.vocabulary_of(i.withColumnRenamed("text", "query_text")))
    got = sorted((r.item_id, r.doc_id) for r in evaluation.holding_documents(d, i, index).collect())
    assert got == [(10, 1), (10, 6), (11, 1), (11, 2), (11, 3), (11, 6)]
    assert d.where(F.col("doc_id") < 0).count() == 0


def test_pruned_search_equals_scoring_everything(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blockmax, "BLOCK", 4)
    monkeypatch.setattr(blockmax, "HEAD", 2)
    docs, queries = sample()
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(queries, "query_id long, query_text string")
    made = blockmax.build_blocks(d, f"file://{tmp_path}/b")
    assert made.blocks.groupBy("term").count().where("count > 3").count() and made.blocks.where("size(postings) > 30").isEmpty()
    rows = lambda found: sorted((r.query_id, r.lexical_rank, r.row_id) for r in found.collect())
    for k in (1, 3, 7):
        want = sorted(brute(docs, queries, k))
        opened = blockmax.BlockIndex(spark, f"file://{tmp_path}/b")
        assert rows(made.search(q, k)) == rows(opened.search(q, k, plain=0)) == want
    monkeypatch.setattr(blockmax, "PUSHED", 2)  # joins instead of conditions
    assert rows(made.search(q, 3, plain=0)) == sorted(brute(docs, queries, 3))
    # only allowed rows count, for thresholds as well; their statistics are still those of all rows
    allowed = [i for i, _ in docs if i % 3]
    every = [r for r in sorted(brute(docs, queries, len(docs))) if r[2] in allowed]
    want = [(query, n, i) for query in {r[0] for r in every} for n, (_, _, i) in enumerate([r for r in every if r[0] == query][:4], 1)]
    assert rows(made.search(q, 4, spark.createDataFrame([(i,) for i in allowed], "row_id long"), plain=0)) == sorted(want)
    none = blockmax.build_blocks(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/none")
    assert none.search(q, 3).collect() == none.search(q, 3, plain=-1).collect() == []


def test_pruned_search_reads_few_blocks(spark, monkeypatch):
    monkeypatch.setattr(blockmax, "BLOCK", 16)
    rng = random.Random(9)
    # a rare word decides, a common one is in every row
    docs = [(k, " ".join(["common"] * rng.randint(1, 9) + [f"r{k % 150}"] * rng.randint(1, 4) + [f"f{j}" for j in range(rng.randint(0, 20))])) for k in range(1500)]
    queries = [(k, f"common r{k} f0") for k in range(20)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, query_text string")
    index = blockmax.build_blocks(d)
    told = index.explain(q, 5).collect()
    assert len(told) == 20 and all(r.blocks_read < 0.2 * r.blocks and r.postings_read < 0.2 * r.postings and r.rows_looked_up < 100 for r in told)
    assert sorted((r.query_id, r.lexical_rank, r.row_id) for r in index.search(q, 5, plain=0).collect()) == sorted(brute(docs, queries, 5))
