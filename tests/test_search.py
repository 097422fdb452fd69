import json

import pytest
from pyspark.sql import functions as F

from hayloft.config import Settings
from hayloft.operators import ann, chunking, embedding, present, retrieval
from hayloft.plans import search
from hayloft.sources import tables

from .conftest import SF


@pytest.fixture(scope="module")
def chunks(spark):
    files = [("src/auth.py", "def login(user, password):\n    return check(user, password)\n"), ("src/auth.test.ts", "function testLogin() {\n  login('a', 'b')\n}\n"), ("docs/auth.md", "# Login\nHow login works with a password\n"), ("src/math.py", "def add(a, b):\n    return a + b\n"), ("flow.mmd", "graph TD\nlogin --> check\n")]
    table = chunking.chunk_table(spark.createDataFrame(files, "path_key string, text string"))
    return embedding.HashingEmbedder(32).embed(table).cache()


def queries(spark):
    q = spark.createDataFrame([(1, "login password"), (2, "add a b")], "query_id int, query_text string")
    return embedding.HashingEmbedder(32).embed(q.withColumn("text", F.col("query_text"))).select("query_id", "query_text", F.col("embedding").alias("query_vector"))


def test_search_end_to_end(spark, chunks):
    for mode in ("balanced", "discovery"):
        got = search.search_rows(chunks, queries(spark), Settings(mode=mode, limit=4, per_file=1)).orderBy("query_id", "rank").collect()
        one = [r for r in got if r.query_id == 1]
        assert [r.rank for r in one] == list(range(1, len(one) + 1)) and len({r.path for r in one}) == len(one)
        assert "auth" in one[0].path or "auth" in one[1].path
        assert all(0 <= r.match_pct <= 99 for r in got)
    scoped = search.search_rows(chunks, queries(spark), Settings(limit=5), scope="src").collect()
    assert scoped and all(r.path.startswith("src/") for r in scoped)


def test_shapes(spark, chunks):
    rows = search.search(chunks, queries(spark), Settings(limit=5, per_file=0)).cache()
    out = present.output_rows(rows)
    made = {r.query_id: json.loads(r.json) for r in present.as_json(out).collect()}
    assert made[1]["count"] == len(made[1]["results"]) and made[1]["results"][0]["rank"] == 1
    assert present.compact(out).count() == present.compact_by_name(out).count()
    numbered = present.sections(rows).where("query_id = 1").orderBy("number").collect()
    order = [["code", "docs", "graph"].index(r.section) for r in numbered]
    assert order == sorted(order)
    packs = present.evidence_packs(rows).where("query_id = 1").orderBy("file_rank").collect()
    assert [p.best for p in packs] == sorted((p.best for p in packs), reverse=True)
    assert spark.range(1).select(present.agent_lines(F.lit("a\n}\n\nb"))).first()[0] == "a\nb"


def test_settings():
    s = Settings.load("limit = 500\nmode = 'debug'", env={"HAYLOFT_PER_FILE": "3", "HAYLOFT_RERANK": "false"})
    assert (s.limit, s.mode, s.per_file, s.rerank) == (200, "debug", 3, False)
    assert s.index_fingerprint() == Settings().index_fingerprint() != Settings(vector_dim=3).index_fingerprint()
    with pytest.raises(ValueError):
        Settings.load("nothing = 1", env={})


def test_embedding_once_per_chunk(spark, chunks):
    rows = chunks.drop("embedding")
    cache = embedding.LengthEmbedder(4).embed(rows.limit(2)).select("chunk_id", "embedding")
    out = embedding.embed_new(rows, cache, embedding.LengthEmbedder(4))
    assert out.count() == rows.count() and embedding.failed(out, 4).where("error is not null").isEmpty()
    assert embedding.failed(out, 5).where("error is null").isEmpty()


def test_cells_find_what_exact_search_finds(spark, tmp_path):
    table = tables.table(spark, SF, "embeddings").select("vec_id", "embedding")
    index = ann.CellIndex.build(table, f"file://{tmp_path}/cells")
    assert index.rows.count() == table.count()
    q = table.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    exact = index.search(q, 10, probes=len(index.centres))
    assert exact.count() == 10 * q.count()
    assert ann.recall(index.search(q, 10, probes=6), exact) >= 0.9


def test_many_queries_give_the_same_pairs(spark):
    vector = lambda x: F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: (x * k % 7).cast("double"))
    queries = spark.range(5).select(F.col("id").alias("query_id"), vector(F.col("id")).alias("query_vector"))
    chunks = spark.range(40).select(F.col("id").alias("row_id"), vector(F.col("id")).alias("embedding"))
    pairs = lambda limit: sorted(map(tuple, retrieval.scored_pairs(queries, chunks, limit).select("query_id", "row_id", "score").collect()))
    assert len(pairs(4)) == 200 and pairs(4) == pairs(5)
