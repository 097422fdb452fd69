import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hayloft.llm import decontaminate as D

from . import helpers as h


def brute(docs, items, window=10):
    out = {}
    cuts = []
    for item, text in items:
        w = h.words(text)
        if w:
            k = min(window, len(w))
            cuts += [(str(item), tuple(w[i : i + k])) for i in range(len(w) - k + 1)]
    for n, (doc, text) in enumerate(docs):
        w = h.words(text)
        hit, names = set(), set()
        for item, cut in cuts:
            for i in range(len(w) - len(cut) + 1):
                if tuple(w[i : i + len(cut)]) == cut:
                    hit |= set(range(i, i + len(cut)))
                    names.add(item)
        out[n, doc] = (len(w), len(hit), sorted(names))
    return sorted(out.values())


def sample(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(12)] + ["é", "ß9"]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, make(rng.choice([1, 2, 5, 9, 10, 11, 25]))) for k in range(14)] + [(3, make(12)), (20, None), (21, "!!"), (22, "rare9 word")]
    docs = [(k, make(rng.randint(0, 60))) for k in range(25)]
    docs += [(30 + k, f"{make(7)}. {t.upper()}, {make(3)}") for k, (_, t) in enumerate(items[:14])] + [(60, None), (61, ""), (62, "w1"), (62, "w1"), (63, "rare9; Word")]
    return docs, items


@pytest.mark.parametrize("limit", [10_000, 0])
def test_same_as_brute_force(spark, limit):
    docs, items = sample(4)
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit("mine")).withColumn("_row", F.col("doc_id") + 1).withColumn("row", F.lit("r"))
    got = D.decontaminate(table, spark.createDataFrame(items, "item_id long, text string"), broadcast_windows=limit)
    assert sorted((r.n_words, r.n_hit, list(r["items"])) for r in got.collect()) == brute(docs, items)
    assert got.columns == ["doc_id", "text", "_row", "row", "n_words", "n_hit", "items"]
    assert {(r.row, r._row - r.doc_id) for r in got.collect()} == {("r", 1)}


def test_pieces_of_long_texts(monkeypatch):
    """Windows, shingles and words of long rows are the same in pieces of any size."""
    from hayloft.llm import blocks as B
    from hayloft.llm import jaccard_join as J

    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "bb", "é", "日本語", "x" * 40]) for _ in range(n)) + tail for n in (1, 3, 4, 5, 60, 300) for tail in ("", " ...")] + ["", "...", "w" * 500 + " " + "v" * 400]
    for text in texts:
        raw = np.frombuffer(text.encode(), np.uint8)
        block = B.Block(0, 1, raw, np.array([0, len(raw)]))
        whole = B.words(block)
        plain = J.shingle_sets(block)[0]
        for size in (1, 7, 50, 10_000):
            for overlap in (1, 4, 9):
                out = {}
                for number, found in B.pieces(block, overlap, size):
                    for k, x in enumerate(found.hash.tolist()):
                        assert out.setdefault(number + k, x) == x
                assert list(out.values()) == whole.hash.tolist() and sorted(out) == list(range(len(out)))
            monkeypatch.setattr(B, "PIECE_BYTES", size)
            monkeypatch.setattr(J, "PIECE_BYTES", size)
            assert J.shingle_sets(block)[0].tolist() == plain.tolist()
            monkeypatch.undo()


@pytest.mark.parametrize("limit", [10_000, 0])
def test_empty_tables_and_awkward_rows(spark, limit):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "One two three four five six"), (1, "one two three four five six"), (2, "wort0é wort1é wort2é wort3é wort4é wort5é wort6é wort7é wort8é wort9é")], "item_id long, text string")
    assert {r.n_hit for r in D.decontaminate(h.awkward(spark), none, broadcast_windows=limit).collect()} == {0}
    assert D.decontaminate(h.empty(spark), some, broadcast_windows=limit).collect() == []
    got = {r.doc_id: r for r in D.decontaminate(h.awkward(spark), some, broadcast_windows=limit).collect()}
    assert got[5].n_hit == 6 and list(got[6]["items"]) == ["1"] and got[4].n_hit == 10 * len([k for k in range(0, 30_000, 977) if k + 10 <= 30_000]) and got[1].n_words == 0


def test_join_holds_when_splits_change(spark, tmp_path):
    docs, items = sample(5)
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/d")
    table = spark.read.parquet(f"{tmp_path}/d")
    got = D.decontaminate(table, spark.createDataFrame(items, "item_id long, text string"), broadcast_windows=0)
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "300")
    try:
        rows = got.collect()
    finally:
        spark.conf.set(key, before)
    assert sorted((r.n_words, r.n_hit, list(r["items"])) for r in rows) == brute(docs, items)
