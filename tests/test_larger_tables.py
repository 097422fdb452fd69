"""Queries on rows that the given small tables lack: large ids, awkward words, many ties."""

import numpy as np
import pyarrow as pa

from hayloft.operators import blockmax, lexical, ranking
from hayloft.plans import catalogue
from hayloft.sources import tables as t


def test_sizes_of_large_ids(spark, tmp_path):
    ids = [0, 1, 99_999, 2_097_152, 5_999_999, 3_000_000_001, 10**12 + 7]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(f"{tmp_path}/events.parquet")

    def said(n):
        for power, unit in ((3, "GB"), (2, "MB"), (1, "KB")):
            if n >= 1024**power:
                return f"{n / 1024**power:.1f} {unit}"
        return f"{n} B"

    got = {r.event_id: r["size"] for r in catalogue.human_sizes(spark, str(tmp_path)).collect()}
    assert got == {i: said(2 * (i**3 % 3_000_000_000) + 1) for i in ids}


def test_words_like_places_of_the_template(spark, tmp_path):
    spark.createDataFrame([(k, "ID John W WIDJ and more of it") for k in range(3)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [r.text for r in t.source_files(spark, str(tmp_path)).orderBy("doc_id").collect()]
    words = "ID John W WIDJ and more of it"
    assert got[0].startswith(f"// {words} it's {{ ") and got[0].endswith(f'console.log("{words} {{");')
    assert f'r#"}}"{words}"#' in got[1] and f'"""{words}\ndef no(): """' in got[2]
    assert "class C0 " in got[0] and "async m0(" in got[0] and "struct S1<" in got[1] and "def m2(" in got[2]


def test_tied_pieces_stay_together(spark):
    rows = spark.createDataFrame([(1, "f", 12, 8, "b"), (1, "f", 12, 8, "a"), (1, "f", 12, 9, "c"), (1, "f", 36, 1, "d")], "q long, path string, start_line int, num_lines int, content string")
    got = [(r.start_line, r.num_lines, r.pieces) for r in ranking.merge_adjacent(rows, ["q"], gap=4).orderBy("start_line").collect()]
    assert got == [(12, 9, 3), (36, 1, 1)]


def test_files_of_blocks_follow_the_postings(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(blockmax, "FILE_POSTINGS", 500, raising=False)
    docs = spark.createDataFrame([(k, f"alpha beta gamma delta w{k % 7}") for k in range(1000)], "doc_id long, text string")
    index = blockmax.build_blocks(docs, str(tmp_path / "blocks"))  # 5000 postings of eleven words
    size = {r.f: r.n for r in index.blocks.selectExpr("_metadata.file_name AS f", "size(postings) AS n").groupBy("f").sum("n").toDF("f", "n").collect()}
    assert len(size) >= 8 and sum(size.values()) == 5000 and max(size.values()) < 1500


def test_blocks_of_a_stream():
    rows = [("a", 9 - k / 100, k) for k in range(23)] + [("b", 5.0, 90)] + [("c", 4.0 - k, k) for k in range(10)] + [("d", 1.0, 7)] * 4
    mixed = [rows[k] for k in np.random.default_rng(3).permutation(len(rows))]

    def cut(step, most):
        batches = []
        for a in range(0, len(mixed), step):
            term, weight, row = zip(*mixed[a : a + step], strict=True)
            batches.append(pa.RecordBatch.from_pydict({"row_id": row, "dl": pa.array([2] * len(row), pa.int32()), "term": term, "tf": [1] * len(row), "weight": weight}))
        return [r for b in blockmax._cut(iter(batches), most, 4, 6) for r in b.to_pylist()]

    for step in (1, 7, 100):
        got = cut(step, 100)
        assert [(r["term"], r["n"]) for r in got] == [("a", 4)] * 5 + [("a", 3), ("b", 1), ("c", 4), ("c", 4), ("c", 2), ("d", 4)]
        assert [(r["term"], p["row_id"]) for r in got for p in r["postings"]] == [(t, k) for t, _, k in rows]
        assert [r["is_head"] for r in got] == [True, True, *[False] * 4, True, True, True, False, True]
        assert [r["top"] for r in got][:3] == [9.0, 8.96, 8.92]
        # a file that comes in parts: more blocks of the same postings
        got = cut(step, 9)
        assert sorted((r["term"], p["row_id"]) for r in got for p in r["postings"]) == [(t, k) for t, _, k in rows]
        assert all(r["n"] == len(r["postings"]) <= 4 and r["top"] == max(w for t, w, k in rows for p in r["postings"] if (t, k) == (r["term"], p["row_id"])) for r in got)


def test_postings_are_moved_once(spark, tmp_path):
    docs = spark.createDataFrame([(k, " ".join(f"w{(k * j) % 997}" for j in range(60))) for k in range(3000)], "doc_id long, text string")
    tracker = spark.sparkContext._jsc.sc().statusStore()
    before = {s.stageId() for s in _stages(spark, tracker)}
    index = blockmax.build_blocks(docs, str(tmp_path / "blocks"))
    postings = index.blocks.selectExpr("sum(size(postings)) AS n").first().n
    moved = sum(s.shuffleWriteRecords() for s in _stages(spark, tracker) if s.stageId() not in before)
    assert postings > 100_000 and moved < 1.2 * postings
    assert index.terms.selectExpr("sum(df) AS n").first().n == postings


def _stages(spark, store):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return [found.apply(k) for k in range(found.size())]


def test_words_met_with_queries_are_bounded():
    # every row has both words, one asked for by 90 queries, one by 10, and one that none asks for
    batch = pa.RecordBatch.from_pydict({"terms": [["a", "b", "c"]] * 50 + [[]] * 5 + [["c"]] * 5, "row": list(range(60))})
    parts = list(lexical._pieces(batch, pa.array(["a", "b"]), np.array([0, 90, 100]), 40, words=700))
    assert [r for p in parts for r in p.column("row").to_pylist()] == list(range(60))
    assert max(sum(len(t) > 1 for t in p.column("terms").to_pylist()) for p in parts) == 7
    assert [len(p) for p in lexical._pieces(batch, pa.array(["a", "b"]), np.array([0, 90, 100]), 60, words=5)][:50] == [1] * 50
