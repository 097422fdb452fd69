"""Registered queries over the given tables, each with SQL for the oracle where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hayloft.functions import identity, paths, text, vectors
from hayloft.operators import ann, blockmax, changes, chunking, definitions, diagrams, embedding, evaluation, graph, lexical, packs, pairs, present, ranking, ranks, retrieval
from hayloft.plans import sync
from hayloft.sources import corpus
from hayloft.sources import tables as t
from hayloft.streaming import watch

QUERIES: dict = {}
SQL: dict[str, str] = {}

# SQL pieces that several oracles share
_ENDING = "CASE doc_id % 8 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.mmd' WHEN 3 THEN '.json' WHEN 4 THEN '.test.ts' WHEN 5 THEN '.html' WHEN 6 THEN '.rs' ELSE '.mermaid' END"
_PATH = f"source || '/' || lang || '/' || doc_id || {_ENDING}"
_DOCS = f"docs AS (SELECT *, {_PATH} AS path, 'seg_' || (doc_id % 4) AS segment FROM documents)"
_VERSIONS = _DOCS + """, versions AS (SELECT path AS path_key, segment, text, doc_id FROM docs
  UNION ALL SELECT path, 'seg_4', text || ' (changed)', doc_id FROM docs WHERE doc_id % 14 = 0),
visible AS (SELECT * FROM versions WHERE doc_id % 7 <> 0 OR (doc_id % 14 = 0 AND segment = 'seg_4'))"""
_BUCKET = "CASE WHEN doc_id % 8 IN (2, 7) THEN 'graph' WHEN doc_id % 8 IN (1, 3, 5) THEN 'docs' ELSE 'code' END"
_CHUNKS = _DOCS + """, chunks AS (SELECT CAST(doc_id AS VARCHAR) AS row_id, doc_id, path, CAST(doc_id % 90 AS INTEGER) AS start_line,
  CAST(doc_id % 30 + 1 AS INTEGER) AS num_lines, CASE doc_id % 5 WHEN 0 THEN 'function' WHEN 1 THEN 'class' ELSE 'other' END AS chunk_type,
  doc_id % 11 = 0 AS is_anchor, CAST(embedding AS DOUBLE[]) AS embedding
  FROM docs JOIN embeddings ON vec_id = doc_id % (SELECT count(*) FROM embeddings)),
queries AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS query_vector FROM embeddings WHERE vec_id % 100 = 0),
pairs AS (SELECT query_id, chunks.*, list_sum(list_transform(list_zip(query_vector, embedding), lambda z: z[1] * z[2])) AS score FROM chunks, queries)"""
_WORDS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


# the oracle's own numbers: factors of definitions, tests, docs and graphs, and the places of code, docs and graphs among 20, by mode
_SQL_FACTORS = {"balanced": (1.25, 0.85, 0.5, 1.0), "discovery": (1.15, 0.9, 1.0, 1.05), "implementation": (1.25, 0.85, 0.65, 0.9), "planning": (1.1, 0.9, 1.15, 1.1), "debug": (1.2, 0.95, 0.85, 0.95)}
_SQL_PLACES = {"balanced": (8, 6, 6), "discovery": (6, 8, 6), "implementation": (11, 5, 4), "planning": (5, 11, 4), "debug": (14, 4, 2)}


def _boost_sql(mode: str) -> str:
    definition, test, doc, graph = _SQL_FACTORS[mode]
    return f"(CASE WHEN chunk_type IN ('function', 'class') THEN {definition} ELSE 1.0 END * CASE WHEN doc_id % 8 = 4 THEN {test} ELSE 1.0 END * CASE WHEN doc_id % 8 IN (2, 7) THEN {graph} WHEN doc_id % 8 IN (1, 3, 5) THEN {doc} ELSE 1.0 END)"


def registered(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# what decides between equal scores
_PLACE = ["path", "start_line", "row_id", "num_lines"]


def _matches(spark: SparkSession, d: str, chunks: DataFrame, cuts: list[pairs.Cut], **more) -> DataFrame:
    """Chunks with the stated queries for which they can be among the best, in the order of results."""
    found = pairs.best_pairs(t.query_vectors(spark, d), chunks, cuts, _PLACE, **more)
    return found.withColumn("secondary_score", F.lit(None).cast("double"))


def _nearest(spark: SparkSession, d: str, chunks: DataFrame, cut: pairs.Cut, **more) -> DataFrame:
    """The same in the order of retrieval: whole scores, path, row_id."""
    return pairs.best_pairs(t.query_vectors(spark, d), chunks, [cut], ["path", "row_id"], digits=False, **more)


def _with_factors(chunks: DataFrame, mode: str) -> tuple[DataFrame, tuple[str, ...]]:
    """The mode's factors of every chunk, and the names of their columns."""
    columns = {f"{mode}_{k}": c for k, c in enumerate(ranking.factors(F.col("path"), F.col("chunk_type"), mode))}
    return chunks.withColumns(columns), tuple(columns)


@registered("WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id, round(list_sum(list_transform(list_zip(v, CAST(embedding AS DOUBLE[])), lambda z: z[1] * z[2])), 6) AS score FROM embeddings, q) SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 20")
def knn_exact_topk(spark: SparkSession, d: str) -> DataFrame:
    found = pairs.best_pairs(t.query_vectors(spark, d), t.table(spark, d, "embeddings").select("vec_id", "embedding"), [pairs.Cut(20)], ["vec_id"])
    return retrieval.top_k(found.select("query_id", "vec_id", F.round("score", 6).alias("score")), 20, ["query_id"], [F.desc("score"), F.asc("vec_id")], "rank")


@registered("WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id, round(list_sum(list_transform(list_zip(v, CAST(embedding AS DOUBLE[])), lambda z: z[1] * z[2])), 6) AS score FROM embeddings, q) SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 20")
def knn_product_topk(spark: SparkSession, d: str) -> DataFrame:
    """``knn_exact_topk`` over product codes: bounds from one byte for two components, then exact scores of a shortlist."""
    return ann.ProductIndex.build(t.table(spark, d, "embeddings")).search(t.query_vectors(spark, d), 20)


@registered(f"WITH {_CHUNKS}, r AS (SELECT query_id, doc_id, CASE WHEN doc_id % 8 IN (2, 7) THEN 'graph' WHEN doc_id % 8 IN (1, 3) THEN 'doc' ELSE 'code' END AS class, round(score, 6) AS score, path, row_id FROM pairs) SELECT query_id, class, CAST(row_number() OVER (PARTITION BY query_id, class ORDER BY score DESC, path, row_id) AS INTEGER) AS branch_rank, doc_id, score FROM r QUALIFY branch_rank <= 20")
def knn_per_class_topk(spark: SparkSession, d: str) -> DataFrame:
    chunks = t.chunk_rows(spark, d).select("doc_id", "path", "row_id", paths.retrieval_class(F.col("path")).alias("class"), "embedding")
    found = pairs.best_pairs(t.query_vectors(spark, d), chunks, [pairs.Cut(20, ("class",))], ["path", "row_id"])
    return retrieval.class_top_k(found.withColumn("score", F.round("score", 6)), 20).select("query_id", "class", "branch_rank", "doc_id", "score")


@registered(f"WITH {_DOCS} SELECT doc_id, path, starts_with(path, 'src1/') AS in_scope, starts_with(path, 'src1') AS in_prefix FROM docs WHERE doc_id % 11 <> 0 AND starts_with(path, 'src1')")
def anchor_and_scope_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = t.documents(spark, d).withColumn("kind", F.when(F.col("doc_id") % 11 == 0, "anchor").otherwise("text"))
    kept = docs.where(paths.is_shown_kind(F.col("kind")) & paths.in_scope(F.col("path"), "src1", whole_parts=False))
    return kept.select("doc_id", "path", paths.in_scope(F.col("path"), "src1").alias("in_scope"), paths.in_scope(F.col("path"), "src1", False).alias("in_prefix"))


@registered(f"WITH {_DOCS} SELECT source, count(*) AS total, count(*) FILTER ({_BUCKET} = 'code') AS code, count(*) FILTER ({_BUCKET} = 'docs') AS docs, count(*) FILTER ({_BUCKET} = 'graph') AS graph, count(*) FILTER (doc_id % 11 = 0) AS anchors FROM docs GROUP BY source")
def bucket_counts(spark: SparkSession, d: str) -> DataFrame:
    return ranking.mix_counts(t.documents(spark, d).withColumn("is_anchor", F.col("doc_id") % 11 == 0), ["source"])


_MODES = " UNION ALL ".join(f"SELECT '{m}' AS mode, query_id, doc_id, round(score * {_boost_sql(m)}, 6) AS score FROM pairs" for m in _SQL_FACTORS)


@registered(f"WITH {_CHUNKS}, b AS ({_MODES}) SELECT mode, query_id, doc_id, score FROM b")
def structural_boost_modes(spark: SparkSession, d: str) -> DataFrame:
    chunks, weights = t.chunk_rows(spark, d).select("doc_id", "path", "chunk_type", "embedding"), {}
    for m in ranking.WEIGHTS:
        chunks, weights[m] = _with_factors(chunks, m)
    return pairs.every_product(t.query_vectors(spark, d), chunks.drop("path", "chunk_type"), weights, "mode", digits=True)


@registered(f"WITH {_CHUNKS}, r AS (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, path, start_line, row_id, num_lines) AS INTEGER) AS rank FROM pairs) SELECT * FROM r")
def deterministic_order(spark: SparkSession, d: str) -> DataFrame:
    return ranks.every_rank(t.query_vectors(spark, d), t.chunk_rows(spark, d), ranking.result_order()[2:], ["doc_id"])


@registered(f"WITH {_VERSIONS} SELECT path_key, segment, strlen(text) AS bytes FROM visible")
def visible_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = changes.visible(t.versions(spark, d), t.tombstones(spark, d), t.current_segments(spark, d))
    return rows.select("path_key", "segment", F.octet_length("text").cast("long").alias("bytes"))


@registered(f"WITH {_VERSIONS}, c AS (SELECT 'before' AS stage, segment, text FROM versions UNION ALL SELECT 'after', 'seg_compact', text FROM visible) SELECT stage, segment, count(*) AS rows, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM c GROUP BY stage, segment")
def compact_live_view(spark: SparkSession, d: str) -> DataFrame:
    rows = t.versions(spark, d)
    after = changes.compact(rows, t.tombstones(spark, d), t.current_segments(spark, d), "seg_compact")
    both = rows.select(F.lit("before").alias("stage"), "segment", "text").unionByName(after.select(F.lit("after").alias("stage"), "segment", "text"))
    return both.groupBy("stage", "segment").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text")).alias("bytes"))


_PERTURBED = "now AS (SELECT path AS path_key, sha256(CASE WHEN doc_id % 9 = 0 THEN text || '!' ELSE text END) AS hash, doc_id FROM docs WHERE doc_id % 13 <> 0), old AS (SELECT path AS path_key, sha256(text) AS hash FROM docs WHERE doc_id % 17 <> 0)"


@registered(f"WITH {_DOCS}, {_PERTURBED} SELECT coalesce(now.path_key, old.path_key) AS path_key, CASE WHEN old.path_key IS NULL THEN 'add' WHEN now.path_key IS NULL THEN 'delete' WHEN now.hash = old.hash THEN 'same' ELSE 'modify' END AS action FROM now FULL JOIN old ON now.path_key = old.path_key")
def change_detection(spark: SparkSession, d: str) -> DataFrame:
    docs = t.documents(spark, d)
    changed = F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    now = docs.where(F.col("doc_id") % 13 != 0).select(F.col("path").alias("path_key"), identity.chunk_hash(changed).alias("hash"))
    old = docs.where(F.col("doc_id") % 17 != 0).select(F.col("path").alias("path_key"), identity.chunk_hash(F.col("text")).alias("hash"))
    return changes.detect_changes(now, old)


@registered("WITH k AS (SELECT CASE WHEN doc_id % 3 = 0 THEN upper(source) ELSE source END || '/' || lang AS path_key FROM documents) SELECT lower(path_key) AS path_key_ci, string_agg(DISTINCT path_key, '|' ORDER BY path_key) AS paths FROM k GROUP BY 1 HAVING count(DISTINCT path_key) > 1")
def casefold_collisions(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat(F.when(F.col("doc_id") % 3 == 0, F.upper("source")).otherwise(F.col("source")), F.lit("/"), F.col("lang"))
    return changes.case_collisions(t.table(spark, d, "documents").select(key.alias("path_key"))).withColumn("paths", F.array_join("paths", "|"))


@registered(f"WITH {_DOCS}, h AS (SELECT doc_id, path, sha256(text) AS chunk_hash, CAST(doc_id % 2000 AS INTEGER) AS ordinal FROM docs), c AS (SELECT *, sha256(unhex(chunk_hash) || CAST('chunker-v2' AS BLOB) || CAST('text' AS BLOB)) AS chunk_id FROM h) SELECT doc_id, chunk_hash, chunk_id, sha256(encode(path) || CAST(chunk_id AS BLOB) || unhex(printf('%02x%02x0000', ordinal % 256, ordinal // 256))) AS row_id FROM c")
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = t.documents(spark, d).select("doc_id", "path", identity.chunk_hash(F.col("text")).alias("chunk_hash"), (F.col("doc_id") % 2000).cast("int").alias("ordinal"))
    rows = rows.withColumn("chunk_id", identity.chunk_id(F.col("chunk_hash"), F.lit("text")))
    return rows.select("doc_id", "chunk_hash", "chunk_id", identity.row_id(F.col("path"), F.col("chunk_id"), F.col("ordinal")).alias("row_id"))


_LINES = "list_transform(string_split(CASE WHEN ends_with(text, chr(10)) THEN left(text, length(text) - 1) ELSE text END, chr(10)), lambda x: regexp_replace(x, '\\r$', ''))"


@registered(f"WITH l AS (SELECT doc_id, {_LINES} AS l FROM documents WHERE length(text) > 0), s AS (SELECT doc_id, l, unnest(range(0, len(l), 65)) AS s FROM l) SELECT doc_id, CAST(s AS INTEGER) AS start_line, CAST(least(s + 75, len(l)) AS INTEGER) AS end_line, sha256(array_to_string(list_slice(l, s + 1, s + 75), chr(10))) AS content_sha FROM s")
def line_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = chunking.line_windows(t.table(spark, d, "documents"), keep=("doc_id",))
    return rows.select("doc_id", "start_line", "end_line", F.sha2(F.col("content").cast("binary"), 256).alias("content_sha"))


@registered("WITH n AS (SELECT conv_id, turn, text, lag(text) OVER w AS p, lead(text) OVER w AS x FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, sha256(coalesce(p, '') || text || coalesce(x, '')) AS content_sha, CAST(greatest(CAST(turn AS INTEGER) * 3 - CASE WHEN coalesce(p, '') = '' THEN 0 ELSE len(string_split(p, chr(10))) - CASE WHEN ends_with(p, chr(10)) THEN 1 ELSE 0 END END, 0) AS INTEGER) AS start_line, CAST(2 AS INTEGER) AS num_lines FROM n")
def neighbour_context(spark: SparkSession, d: str) -> DataFrame:
    rows = chunking.with_neighbours(t.table(spark, d, "conversations"), "conv_id", "turn")
    rows = rows.withColumn("start_line", F.col("turn").cast("int") * 3).withColumn("end_line", F.col("start_line") + 2)
    return retrieval.shown_columns(rows).select("conv_id", "turn", F.sha2(F.col("content").cast("binary"), 256).alias("content_sha"), F.col("start_line").cast("int"), F.col("num_lines").cast("int"))


@registered(f"""WITH l AS (SELECT doc_id, list_filter(CASE WHEN length(text) = 0 THEN [] ELSE {_LINES} END, lambda x: trim(x, ' ') <> '') AS l FROM documents),
n AS (SELECT doc_id, l, list_transform(range(1, least(len(l), 30) + 1), lambda i: coalesce(list_sum(list_transform(list_slice(l, 1, i - 1), lambda x: strlen(x))), 0)) AS b FROM l)
SELECT doc_id, CAST(len(list_filter(b, lambda x: x < 1200)) AS INTEGER) AS preamble_lines, sha256(array_to_string(list_slice(l, 1, len(list_filter(b, lambda x: x < 1200))), chr(10))) AS preamble_sha FROM n""")
def anchor_preamble(spark: SparkSession, d: str) -> DataFrame:
    rows = chunking.anchors(t.documents(spark, d))
    return rows.select("doc_id", F.size("preamble").alias("preamble_lines"), F.sha2(F.array_join("preamble", "\n").cast("binary"), 256).alias("preamble_sha"))


# a page of results: forty documents that follow each other
@registered(f"""WITH r AS (SELECT doc_id // 40 AS page, doc_id, CAST(row_number() OVER (PARTITION BY doc_id // 40 ORDER BY doc_id) AS INTEGER) AS rank, text FROM documents),
c AS (SELECT page, doc_id, rank, (SELECT max(i) FROM unnest(range(0, least(length(text), 600) + 1)) u(i) WHERE strlen(left(text, i)) <= 600) AS keep, text FROM r),
k AS (SELECT *, strlen(left(text, keep)) AS bytes FROM c),
m AS (SELECT *, greatest(8000 - coalesce(sum(bytes) OVER (PARTITION BY page ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS rest, sum(bytes) OVER (PARTITION BY page) AS total FROM k)
SELECT page, doc_id, rank, CAST(strlen(left(text, CASE WHEN total > 8000 AND bytes > rest THEN (SELECT max(i) FROM unnest(range(0, keep + 1)) u(i) WHERE strlen(left(text, i)) <= rest) ELSE keep END)) AS BIGINT) AS bytes FROM m""")
def snippet_caps(spark: SparkSession, d: str) -> DataFrame:
    rows = t.table(spark, d, "documents").select(F.floor(F.col("doc_id") / 40).alias("page"), "doc_id", F.left("text", F.lit(600)).alias("content"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("page").orderBy("doc_id")))
    return ranking.byte_budget(rows, ["page"], 600, 8000).select("page", "doc_id", "rank", F.octet_length("content").cast("long").alias("bytes"))


@registered(f"WITH {_CHUNKS}, m AS (SELECT query_id, doc_id, score, avg(score) OVER w AS mean, stddev_pop(score) OVER w AS std FROM pairs WINDOW w AS (PARTITION BY query_id)) SELECT query_id, doc_id, CAST(greatest(0, least(99, round(100 / (1 + exp(-(score - mean) / std))))) AS INTEGER) AS match_pct FROM m")
def match_percent(spark: SparkSession, d: str) -> DataFrame:
    queries, chunks = t.query_vectors(spark, d), t.chunk_rows(spark, d).select("doc_id", "embedding")
    return ranking.match_percent(pairs.every_score(queries, chunks), ["query_id"], known=pairs.score_facts(queries, chunks)).select("query_id", "doc_id", "match_pct")


_ABS = "list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))))"


@registered(f"WITH q AS (SELECT vec_id, embedding, {_ABS} / 127 AS scale FROM embeddings), z AS (SELECT vec_id, scale, embedding, list_transform(embedding, lambda x: CAST(trunc(CAST(x AS DOUBLE) / scale) AS BIGINT)) AS q FROM q) SELECT vec_id, round(scale, 9) AS scale, CAST(list_sum(q) AS BIGINT) AS total, round(list_max(list_transform(list_zip(embedding, q), lambda p: abs(CAST(p[1] AS DOUBLE) - p[2] * scale))), 6) AS error FROM z")
def quantize_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows = t.table(spark, d, "embeddings").select("vec_id", "embedding", vectors.quantisation_scale(F.col("embedding")).alias("s"), vectors.quantised(F.col("embedding")).alias("q"))
    total = F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x)
    error = F.array_max(F.zip_with("embedding", "q", lambda x, y: F.abs(x.cast("double") - y * F.col("s"))))
    return rows.select("vec_id", F.round("s", 9).alias("scale"), total.alias("total"), F.round(error, 6).alias("error"))


@registered("WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 3) AS v FROM embeddings), u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u FROM n) SELECT vec_id, round(list_sum(list_transform(u, lambda x: x * x)), 6) AS norm, round(u[1], 6) AS first FROM u")
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    scaled = F.transform("embedding", lambda x: x.cast("double") * 3)
    rows = t.table(spark, d, "embeddings").select("vec_id", vectors.l2_normalised(scaled).alias("u"))
    return rows.select("vec_id", F.round(vectors.dot(F.col("u"), F.col("u")), 6).alias("norm"), F.round(F.element_at("u", 1), 6).alias("first"))


def _token_groups(spark: SparkSession, d: str) -> DataFrame:
    """Eight vectors with equal vec_id div 8 as the token matrix of a document."""
    rows = t.table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("doc"), "vec_id", "embedding")
    return rows.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"].cast("array<double>")).alias("tokens"))


def _token_scores(groups: DataFrame, rows: DataFrame) -> DataFrame:
    """Every row with the stated queries: the groups whose number is divisible by 100, each a bounded matrix."""
    queries = groups.where(F.col("doc") % 100 == 0).select(F.col("doc").alias("query_id"), F.col("tokens").alias("query_vectors"))
    return pairs.every_max_sim(queries, rows)


_TOKENS = "tok AS (SELECT vec_id // 8 AS doc, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), qt AS (SELECT doc AS query_id, vec_id, v FROM tok WHERE doc % 100 = 0)"


@registered(f"WITH {_TOKENS}, m AS (SELECT query_id, tok.doc, qt.vec_id, max(list_sum(list_transform(list_zip(qt.v, tok.v), lambda z: z[1] * z[2]))) AS best FROM tok, qt GROUP BY 1, 2, 3) SELECT query_id, doc, round(sum(best), 6) AS maxsim FROM m GROUP BY 1, 2")
def maxsim_float(spark: SparkSession, d: str) -> DataFrame:
    groups = _token_groups(spark, d)
    return _token_scores(groups, groups).select("query_id", "doc", F.round("score", 6).alias("maxsim"))


@registered(f"WITH {_TOKENS}, sc AS (SELECT doc, max(list_max(list_transform(v, lambda x: abs(x)))) / 127 AS scale FROM tok GROUP BY doc), q AS (SELECT tok.doc, list_transform(v, lambda x: CAST(trunc(x / scale) AS DOUBLE)) AS q, scale FROM tok JOIN sc ON tok.doc = sc.doc), m AS (SELECT query_id, q.doc, any_value(scale) AS scale, qt.vec_id, max(list_sum(list_transform(list_zip(qt.v, q.q), lambda z: z[1] * z[2]))) AS best FROM q, qt GROUP BY 1, 2, 4) SELECT query_id, doc, round(sum(best) * any_value(scale), 6) AS maxsim FROM m GROUP BY 1, 2")
def maxsim_quantized(spark: SparkSession, d: str) -> DataFrame:
    groups = _token_groups(spark, d)
    scale = vectors.quantisation_scale(F.flatten("tokens"))
    rows = groups.withColumn("scale", scale).withColumn("q", F.transform("tokens", lambda r: F.transform(r, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), x / F.col("scale"))).cast("int").cast("tinyint"))))
    # tokens of zeros alone are skipped, and the scale is applied once, as in vectors.max_sim_quantised
    live = F.filter(F.col("q").cast("array<array<double>>"), lambda v: F.exists(v, lambda x: x != 0))
    return _token_scores(groups, rows.select("doc", "scale", live.alias("tokens"))).select("query_id", "doc", F.round(F.col("score") * F.col("scale"), 6).alias("maxsim"))


_MATRIX = "list_transform(range(0, 8), lambda i: list_slice({}, i * 8 + 1, i * 8 + 8))"


# the token matrix of a chunk or query: its vector in eight parts
@registered(f"""WITH {_CHUNKS}, dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, row_id) AS dense_rank FROM (SELECT query_id, doc_id, path, row_id, score, embedding, query_vector FROM pairs JOIN queries USING (query_id)) QUALIFY dense_rank <= 110),
s AS (SELECT *, CASE WHEN dense_rank <= 50 THEN list_sum(list_transform({_MATRIX.format('query_vector')}, lambda a: list_max(list_transform({_MATRIX.format('embedding')}, lambda b: list_sum(list_transform(list_zip(a, b), lambda z: z[1] * z[2])))))) ELSE score END AS new FROM dr)
SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(new, 6) DESC, path, row_id) AS INTEGER) AS rank, round(new, 6) AS score FROM s QUALIFY rank <= 60""")
def rerank_top50(spark: SparkSession, d: str) -> DataFrame:
    parts = lambda v: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(v, i * 8 + 1, F.lit(8)))
    late = vectors.max_sim(parts(F.col("query_vector")), parts(F.col("embedding")))
    # the fifty that are reranked, and sixty more that may pass them
    depth = retrieval.RERANK_DEPTH + 60
    found = _nearest(spark, d, t.chunk_rows(spark, d).select("doc_id", "path", "row_id", "embedding"), pairs.Cut(depth), keep_vector=True)
    first = ranking.candidate_cap(found, ["query_id"], depth).join(t.query_vectors(spark, d), "query_id")
    return retrieval.rerank(first, ["query_id"], late, limit=60).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


_BM25 = f"""qt AS (SELECT DISTINCT item_id AS query_id, unnest({_WORDS.format('text')}) AS term FROM benchmark),
dw AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents), facts AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM dw),
tf AS (SELECT doc_id, len(w) AS dl, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM dw) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score FROM qt JOIN tf ON qt.term = tf.term JOIN df ON df.term = qt.term, facts GROUP BY 1, 2)"""


@registered(f"WITH {_BM25} SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS lexical_rank, doc_id, round(score, 4) AS score FROM bm QUALIFY lexical_rank <= 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    queries = t.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    found = lexical.bm25(t.table(spark, d, "documents").select("doc_id", "text"), queries, 10)
    return found.select("query_id", "lexical_rank", F.col("row_id").alias("doc_id"), F.round("score", 4).alias("score"))


@registered(f"WITH {_BM25} SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS lexical_rank, doc_id, round(score, 4) AS score FROM bm QUALIFY lexical_rank <= 10")
def bm25_pruned_topk(spark: SparkSession, d: str) -> DataFrame:
    """``bm25_topk`` over stored blocks, with thresholds and skipped blocks whatever the number of postings."""
    queries = t.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    found = blockmax.stored(t.table(spark, d, "documents").select("doc_id", "text")).search(queries, 10, plain=0)
    return found.select("query_id", "lexical_rank", F.col("row_id").alias("doc_id"), F.round("score", 4).alias("score"))


@registered(f"""WITH {_CHUNKS}, {_BM25}, dense AS (SELECT query_id, doc_id, path, start_line, CASE WHEN doc_id % 8 IN (2, 7) THEN 2 WHEN doc_id % 8 IN (1, 3) THEN 1 ELSE 0 END AS branch, score, row_id FROM pairs),
dr AS (SELECT query_id, doc_id, path, start_line, branch, row_number() OVER (PARTITION BY query_id, branch ORDER BY score DESC, path, row_id) AS branch_rank FROM dense QUALIFY branch_rank <= 20),
lx AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS branch_rank FROM bm WHERE query_id % 100 = 0 QUALIFY branch_rank <= 20),
u AS (SELECT * FROM dr UNION ALL SELECT lx.query_id, lx.doc_id, path, start_line, 3, branch_rank FROM lx JOIN chunks ON chunks.doc_id = lx.doc_id)
SELECT query_id, doc_id, CAST(branch AS INTEGER) AS branch, CAST(branch_rank AS INTEGER) AS branch_rank FROM u QUALIFY row_number() OVER (PARTITION BY query_id, path, start_line ORDER BY branch, branch_rank) = 1""")
def hybrid_union_dedup(spark: SparkSession, d: str) -> DataFrame:
    chunks = t.chunk_rows(spark, d).select("doc_id", "path", "row_id", "start_line", paths.retrieval_class(F.col("path")).alias("class"), "embedding")
    dense = retrieval.class_top_k(_nearest(spark, d, chunks, pairs.Cut(20, ("class",))), 20).select("query_id", "doc_id", "path", "start_line", "class", "branch_rank")
    queries = t.table(spark, d, "benchmark").where(F.col("item_id") % 100 == 0).select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    found = lexical.bm25(t.table(spark, d, "documents").select("doc_id", "text"), queries, 20)
    words = found.select("query_id", F.col("row_id").alias("doc_id"), F.col("lexical_rank").alias("branch_rank")).join(t.chunk_rows(spark, d).select("doc_id", "path", "start_line"), "doc_id")
    return retrieval.hybrid_union(dense, words).select("query_id", "doc_id", "branch", "branch_rank")


# a file here is a source and language; its documents are the chunks
@registered(f"WITH {_CHUNKS}, f AS (SELECT query_id, doc_id, source || '/' || lang AS file, round(p.score, 6) AS score, start_line, row_id, num_lines FROM pairs p JOIN documents USING (doc_id)), c AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY query_id, file ORDER BY score DESC, start_line, row_id, num_lines) <= 2) SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file, start_line, row_id, num_lines) AS INTEGER) AS rank FROM c QUALIFY rank <= 30")
def per_file_cap(spark: SparkSession, d: str) -> DataFrame:
    chunks = t.chunk_rows(spark, d).withColumn("path", F.regexp_replace("path", "/[^/]*$", ""))
    rows = _matches(spark, d, chunks, [pairs.Cut(2, ("path",))])
    return ranking.select_balanced(rows, ["query_id"], 30, 2).select("query_id", "doc_id", "rank")


def _mode_query(mode: str) -> None:
    code, docs, graph = _SQL_PLACES[mode]
    sql = f"""WITH {_CHUNKS}, r AS (SELECT query_id, doc_id, path, start_line, is_anchor, {_BUCKET} AS bucket, row_number() OVER (PARTITION BY query_id ORDER BY round(score * {_boost_sql(mode)}, 6) DESC, path, start_line, row_id, num_lines) AS o FROM pairs),
e AS (SELECT *, NOT is_anchor AS ok FROM r), b AS (SELECT *, CASE WHEN ok THEN row_number() OVER (PARTITION BY query_id, bucket, ok ORDER BY o) END AS nb FROM e),
p AS (SELECT *, CASE WHEN ok AND nb <= CASE bucket WHEN 'code' THEN {code} WHEN 'docs' THEN {docs} ELSE {graph} END THEN 1 WHEN ok THEN 2 ELSE 3 END AS phase FROM b)
SELECT query_id, doc_id, bucket, CAST(row_number() OVER (PARTITION BY query_id ORDER BY phase, CASE WHEN phase > 1 THEN 0 WHEN bucket = 'code' THEN 0 WHEN bucket = 'docs' THEN 1 ELSE 2 END, o) AS INTEGER) AS rank FROM p QUALIFY rank <= 20"""

    def query(spark: SparkSession, d: str) -> DataFrame:
        chunks, weights = _with_factors(t.chunk_rows(spark, d).withColumn("bucket", paths.bucket(F.col("path"))), mode)
        found = _matches(spark, d, chunks, ranking.mode_cuts(20), weights=weights).drop("bucket")
        return ranking.select_by_mode(found, ["query_id"], 20, 1, mode).select("query_id", "doc_id", "bucket", "rank")

    query.__name__ = f"mode_selection_{mode}"
    registered(sql)(query)


for _mode in ("discovery", "implementation", "planning", "debug"):
    _mode_query(_mode)


@registered("""WITH l AS (SELECT l_orderkey, CAST(l_linenumber * 12 AS INTEGER) AS s, CAST(l_quantity AS INTEGER) % 9 + 1 AS n, l_partkey FROM lineitem),
g AS (SELECT *, lag(s + n) OVER w AS e FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY s, n)),
i AS (SELECT *, sum(CASE WHEN e IS NULL OR s > e + 4 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY s, n ROWS UNBOUNDED PRECEDING) AS grp FROM g)
SELECT l_orderkey AS orderkey, min(s) AS start_line, CAST(arg_max(s + n, s * 1000 + n) - min(s) AS INTEGER) AS num_lines, count(*) AS pieces FROM i GROUP BY l_orderkey, grp""")
def merge_adjacent(spark: SparkSession, d: str) -> DataFrame:
    rows = t.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("orderkey"), F.lit("f").alias("path"), (F.col("l_linenumber") * 12).cast("int").alias("start_line"), (F.col("l_quantity").cast("int") % 9 + 1).alias("num_lines"), F.col("l_partkey").cast("string").alias("content"))
    return ranking.merge_adjacent(rows, ["orderkey"], gap=4).select("orderkey", "start_line", F.col("num_lines").cast("int").alias("num_lines"), "pieces")


@registered(f"WITH {_VERSIONS} SELECT segment, count(*) AS rows, count(DISTINCT path_key) AS paths, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM versions GROUP BY segment")
def segment_union(spark: SparkSession, d: str) -> DataFrame:
    return changes.segment_counts(t.versions(spark, d))


@registered("""WITH s AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r, max(o_orderdate) OVER (PARTITION BY o_custkey) AS newest FROM orders)
SELECT o_custkey AS store, o_orderkey AS snapshot, CAST(r AS INTEGER) AS age_rank, r <= 5 OR epoch(newest) - epoch(o_orderdate) <= 2592000 OR o_orderkey % 50 = 0 OR r = 7 AS retain FROM s""")
def gc_retention(spark: SparkSession, d: str) -> DataFrame:
    """A customer stands for a store, its orders for snapshots; the seventh is the active one, every fiftieth is pinned."""
    w = Window.partitionBy("o_custkey")
    order = F.row_number().over(w.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    rows = t.table(spark, d, "orders").select(F.col("o_custkey").alias("store"), F.col("o_orderkey").alias("snapshot_id"), F.col("o_orderdate").alias("created_at"), F.max("o_orderdate").over(w).alias("newest"), (order == 7).alias("active"))
    pinned = t.table(spark, d, "orders").where(F.col("o_orderkey") % 50 == 0).select(F.col("o_orderkey").alias("snapshot_id"))
    kept = changes.retained(rows, 5, 2592000, F.col("newest"), pinned, by=("store",))
    return kept.select("store", F.col("snapshot_id").alias("snapshot"), "age_rank", "retain")


@registered(f"WITH {_VERSIONS}, g AS (SELECT segment, count(*) AS rows, CAST(sum(strlen(text)) AS BIGINT) AS size FROM versions GROUP BY segment) SELECT CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(size) AS BIGINT) AS size_bytes, count(*) AS segments, (SELECT count(*) FROM docs WHERE doc_id % 7 = 0) AS tombstones FROM g")
def manifest_totals(spark: SparkSession, d: str) -> DataFrame:
    return changes.manifest_totals(changes.segment_counts(t.versions(spark, d)), t.tombstones(spark, d))


@registered("SELECT DISTINCT event_type AS code, CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'u' || user_id END AS path_key FROM events")
def limit_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = t.table(spark, d, "events").select(F.col("event_type").alias("code"), F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("path_key"))
    return ranking.distinct_diagnostics(rows)


_HELD = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')"


def _cases(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Benchmark items as cases: the whole documents that hold the item's whole text are expected, BM25 gives the hits.

    Any of them must be among the hits; for items with an even id also the one of
    least id.  Texts are compared as runs of words.
    """
    items = t.table(spark, d, "benchmark")
    docs = t.table(spark, d, "documents").select("doc_id", "text")
    queries = items.select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    name = lambda c: F.concat(F.lit("d"), c.cast("string"), F.lit("."))
    index = lexical.word_table(docs, queries)
    hits = index.search(queries, 10).select(F.col("query_id").alias("case_id"), F.col("lexical_rank").alias("rank"), name(F.col("row_id")).alias("path"))
    mode = F.element_at(F.array(F.lit("balanced"), F.lit("debug"), F.lit("planning")), (F.col("item_id") % 3 + 1).cast("int"))
    holding = evaluation.holding_documents(docs, items, index)
    wanted = holding.groupBy("item_id").agg(F.array_sort(F.collect_set(name(F.col("doc_id")))).alias("expect"), name(F.min("doc_id")).alias("least"))
    nothing = F.array().cast("array<string>")
    cases = items.select("item_id", mode.alias("mode")).join(wanted, "item_id", "left")
    least = F.when((F.col("item_id") % 2 == 0) & F.col("least").isNotNull(), F.array("least")).otherwise(nothing)
    return cases.select(F.col("item_id").alias("case_id"), "mode", F.coalesce("expect", nothing).alias("expect_any"), least.alias("expect_all")), hits


_CASES = f"""{_BM25}, hits AS (SELECT query_id AS case_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id FROM bm QUALIFY rank <= 10),
bw AS (SELECT item_id, ' ' || trim({_HELD.format('text')}) || ' ' AS w FROM benchmark), dt AS (SELECT doc_id, ' ' || trim({_HELD.format('text')}) || ' ' AS w FROM documents),
holding AS (SELECT item_id, doc_id FROM bw, dt WHERE length(bw.w) > 2 AND contains(dt.w, bw.w)), least AS (SELECT item_id, min(doc_id) AS least FROM holding GROUP BY 1),
cases AS (SELECT b.item_id AS case_id, ['balanced', 'debug', 'planning'][b.item_id % 3 + 1] AS mode, least FROM benchmark b LEFT JOIN least l ON l.item_id = b.item_id),
anyhit AS (SELECT case_id, min(rank) AS r FROM hits JOIN holding ON item_id = case_id AND holding.doc_id = hits.doc_id GROUP BY 1),
allhit AS (SELECT hits.case_id, min(rank) AS r FROM hits JOIN cases ON cases.case_id = hits.case_id AND least = doc_id WHERE hits.case_id % 2 = 0 GROUP BY 1),
scored AS (SELECT c.case_id, mode, CAST(least(a.r, b.r) AS INTEGER) AS first_hit_rank, a.r IS NOT NULL OR least IS NULL AS any_ok, c.case_id % 2 <> 0 OR least IS NULL OR b.r IS NOT NULL AS all_ok
  FROM cases c LEFT JOIN anyhit a ON a.case_id = c.case_id LEFT JOIN allhit b ON b.case_id = c.case_id)"""


@registered(f"WITH {_CASES} SELECT case_id, mode, coalesce(first_hit_rank, 0) AS first_hit_rank, round(coalesce(1.0 / first_hit_rank, 0), 6) AS reciprocal_rank, any_ok, all_ok, any_ok AND all_ok AS passed FROM scored")
def eval_case_scores(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.score_cases(*_cases(spark, d)).select("case_id", "mode", F.coalesce("first_hit_rank", F.lit(0)).alias("first_hit_rank"), F.round("reciprocal_rank", 6).alias("reciprocal_rank"), "any_ok", "all_ok", "passed")


@registered(f"WITH {_CASES} SELECT mode, count(*) AS total, count(*) FILTER (any_ok AND all_ok) AS passed, round(avg(CASE WHEN any_ok AND all_ok THEN 1.0 ELSE 0.0 END), 6) AS pass_rate, round(avg(coalesce(1.0 / first_hit_rank, 0)), 6) AS mrr, round(avg(first_hit_rank), 6) AS mean_hit_rank FROM scored GROUP BY ROLLUP (mode)")
def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.summarise(evaluation.score_cases(*_cases(spark, d)))


_ISLANDS = "e AS (SELECT user_id, ts, event_type, event_id, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 5 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS n FROM events), g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)"


def _bursts(spark: SparkSession, d: str) -> DataFrame:
    """A user stands for a path, the kind of event (with its id) for the action."""
    events = t.table(spark, d, "events").select(F.col("user_id").alias("path_key"), F.struct("event_id", "event_type").alias("action"), "ts", "event_id")
    return watch.coalesced(events, "5 minutes", ties=("event_id",))


@registered(f"WITH {_ISLANDS} SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 300000000 AS end_us, count(*) AS events FROM g GROUP BY user_id, s")
def debounce_sessions(spark: SparkSession, d: str) -> DataFrame:
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return _bursts(spark, d).select(F.col("path_key").alias("user_id"), micros("started").alias("start_us"), (micros("ts") + 300_000_000).alias("end_us"), F.col("n").alias("events"))


@registered(f"WITH {_ISLANDS}, k AS (SELECT user_id, s, event_type, event_id, row_number() OVER (PARTITION BY user_id, s ORDER BY ts DESC, event_id DESC) AS r FROM g) SELECT user_id, event_id, event_type AS action FROM k WHERE r = 1")
def last_action_wins(spark: SparkSession, d: str) -> DataFrame:
    return _bursts(spark, d).select(F.col("path_key").alias("user_id"), "action.event_id", F.col("action.event_type").alias("action"))


@registered("""WITH w AS (SELECT event_id, user_id, count(*) OVER f AS n, list_sort(list(value) OVER f) AS v FROM events WINDOW f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW))
SELECT event_id, v[CAST(floor((n - 1) * 0.5 + 0.5) AS BIGINT) + 1] AS p50, v[CAST(floor((n - 1) * 0.95 + 0.5) AS BIGINT) + 1] AS p95 FROM w""")
def rolling_latency(spark: SparkSession, d: str) -> DataFrame:
    return watch.running_percentiles(t.table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("event_id", "p50", "p95")


@registered(r"""SELECT page_id, CAST(length(s) AS BIGINT) AS kept, sha256(s) AS sha FROM (SELECT page_id, regexp_replace(regexp_replace(replace(html, '<', chr(27) || '[31m<') || chr(7), '\x1b\[[0-9;?]*[ -/]*[@-~]', '', 'g'), '[\x00-\x08\x0b-\x1f\x7f]', '', 'g') AS s FROM pages)""")
def sanitize_output(spark: SparkSession, d: str) -> DataFrame:
    dirty = F.concat(F.replace("html", F.lit("<"), F.lit("\x1b[31m<")), F.lit("\x07"))
    rows = t.table(spark, d, "pages").select("page_id", text.sanitised(dirty).alias("s"))
    return rows.select("page_id", F.length("s").cast("long").alias("kept"), F.sha2(F.col("s").cast("binary"), 256).alias("sha"))


@registered(f"""WITH l AS (SELECT doc_id, list_filter(list_transform({_LINES}, lambda x: regexp_extract(x, '^([A-Za-z]+)', 1)), lambda x: x <> '') AS l FROM documents),
w AS (SELECT doc_id, list_slice(list_filter(l, lambda x, i: list_position(l, x) = i), 1, 100) AS names FROM l)
SELECT doc_id, array_to_string(list_sort(names), ',') AS imports, array_to_string(list_sort(list_transform(names, lambda x: x || '_fn')), ',') AS exports FROM w""")
def imports_exports(spark: SparkSession, d: str) -> DataFrame:
    """Import and export lines made of each line's first word, read back by the extractors, which read 200 lines: 100 names."""
    words = F.filter(F.transform(text.lines(F.coalesce("text", F.lit(""))), lambda x: F.regexp_extract(x, "^([A-Za-z]+)", 1)), lambda x: x != "")
    rows = t.table(spark, d, "documents").select("doc_id", F.array_distinct(words).alias("names"))
    code = F.flatten(F.transform("names", lambda x: F.array(F.concat(F.lit('import { a } from "'), x, F.lit('"')), F.concat(F.lit("export function "), x, F.lit("_fn() {")))))
    return rows.select("doc_id", F.array_join(chunking.imports_of(code), ",").alias("imports"), F.array_join(chunking.exports_of(code), ",").alias("exports"))


_OVER = "OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING)"
_CRUMB = "CASE WHEN own{k} > coalesce(greatest({higher}), -1) THEN 'Heading{k}: ' || title{k} END"
_CRUMBS = ", ".join(_CRUMB.format(k=k, higher=", ".join(f"own{j}" for j in range(1, k)) or "NULL") for k in (1, 2, 3))
_OWN = ", ".join(f"last_value(CASE WHEN level = {k} THEN line END IGNORE NULLS) {_OVER} AS own{k}, last_value(CASE WHEN level = {k} THEN title END IGNORE NULLS) {_OVER} AS title{k}" for k in (1, 2, 3))
_MD = f"""l AS (SELECT doc_id, unnest({_LINES}) AS v, unnest(range(0, len({_LINES}))) AS line FROM documents WHERE length(text) > 0),
f AS (SELECT *, line % 11 = 6 AS mark, sum(CAST(line % 11 = 6 AS INTEGER)) {_OVER} % 2 = 1 AS fenced FROM l),
m AS (SELECT doc_id, line, CASE WHEN mark THEN '```' WHEN line % 5 = 2 AND v <> '' THEN repeat('#', CAST(1 + (line // 5) % 3 AS INTEGER)) || ' ' || trim(v) ELSE v END AS v,
  CASE WHEN line % 5 = 2 AND trim(v) <> '' AND NOT mark AND NOT fenced THEN 1 + (line // 5) % 3 END AS level, trim(v) AS title FROM f),
s AS (SELECT *, sum(CASE WHEN level IS NULL THEN 0 ELSE 1 END) {_OVER} AS sec, {_OWN} FROM m),
b AS (SELECT *, concat_ws(' > ', {_CRUMBS}) AS crumbs FROM s)"""


@registered(f"WITH {_MD} SELECT doc_id, CAST(min(line) AS INTEGER) AS start_line, CAST(max(line) + 1 AS INTEGER) AS end_line, CAST(coalesce(max(level), 0) AS INTEGER) AS level, arg_min(crumbs, line) AS breadcrumbs, sha256(string_agg(v, chr(10) ORDER BY line)) AS content_sha FROM b GROUP BY doc_id, sec HAVING trim(regexp_replace(string_agg(v, chr(10) ORDER BY line), '\\s+', ' ', 'g')) <> ''")
def markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth line of a document made a heading, every eleventh a fence, cut into sections."""
    made = F.transform(text.lines(F.col("text")), lambda x, i: F.when(i % 11 == 6, "```").when((i % 5 == 2) & (x != ""), F.concat(F.repeat(F.lit("#"), (F.floor(i / 5) % 3 + 1).cast("int")), F.lit(" "), F.trim(x))).otherwise(x))
    rows = t.table(spark, d, "documents").select("doc_id", F.array_join(made, "\n").alias("text"))
    out = chunking.markdown_sections(rows, key="doc_id")
    return out.select("doc_id", "start_line", "end_line", "level", F.array_join("breadcrumbs", " > ").alias("breadcrumbs"), F.sha2(F.col("content").cast("binary"), 256).alias("content_sha"))


@registered("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem)
SELECT l_orderkey AS orderkey, 'Mermaid flowchart edges: ' || string_agg('Part ' || l_partkey || ' -> Supplier ' || l_suppkey || ' (n' || l_linenumber || ')', '; ' ORDER BY r) AS summary FROM l WHERE r <= 48 GROUP BY 1""")
def mermaid_summary(spark: SparkSession, d: str) -> DataFrame:
    """Flowcharts made of each order's lines, summarised."""
    edge = F.concat(F.lit("P"), F.col("l_partkey"), F.lit("[Part "), F.col("l_partkey"), F.lit("] -->|n"), F.col("l_linenumber"), F.lit("| S"), F.col("l_suppkey"), F.lit("[Supplier "), F.col("l_suppkey"), F.lit("]"))
    rows = t.table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", edge.alias("edge")).alias("e"))
    charts = rows.groupBy(F.col("l_orderkey").alias("orderkey")).agg(F.concat(F.lit("graph TD\n"), F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda x: x["edge"]), "\n")).alias("chart"))
    return charts.select("orderkey", diagrams.diagram_summary("chart", F.lit(True)).alias("summary"))


@registered("SELECT source AS store, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes, max(doc_id) AS newest FROM documents GROUP BY source")
def store_inventory(spark: SparkSession, d: str) -> DataFrame:
    return present.store_list(t.table(spark, d, "documents").select(F.col("source").alias("store"), F.octet_length("text").alias("size"), F.col("doc_id").alias("changed")))


@registered("SELECT doc_id, list_sum(v) AS total, v[1] AS first, CAST(len(v) AS INTEGER) AS dim FROM (SELECT doc_id, list_transform(range(0, 16), lambda i: CASE WHEN i = 0 THEN CAST(strlen(text) AS DOUBLE) ELSE 0.0 END) AS v FROM documents)")
def embed_dummy(spark: SparkSession, d: str) -> DataFrame:
    rows = t.table(spark, d, "documents").select("doc_id", vectors.length_embedding(F.col("text"), 16).alias("v"))
    return rows.select("doc_id", F.aggregate("v", F.lit(0.0), lambda s, x: s + x).alias("total"), F.element_at("v", 1).alias("first"), F.size("v").alias("dim"))


@registered("""WITH m AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Busy: ' WHEN 1 THEN 'deadline timeout ' WHEN 2 THEN 'query cancelled ' WHEN 3 THEN 'invalid scope ' WHEN 4 THEN 'incompatible: ' ELSE '' END || event_type AS message FROM events)
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'busy' WHEN 1 THEN 'timeout' WHEN 2 THEN 'cancelled' WHEN 3 THEN 'invalid_request' WHEN 4 THEN 'incompatible' ELSE 'internal' END AS code, CASE event_id % 6 WHEN 0 THEN 10 WHEN 1 THEN 11 WHEN 2 THEN 12 WHEN 4 THEN 13 ELSE 1 END AS status FROM m""")
def exit_codes(spark: SparkSession, d: str) -> DataFrame:
    head = F.element_at(F.array(*map(F.lit, ("Busy: ", "deadline timeout ", "query cancelled ", "invalid scope ", "incompatible: ", ""))), (F.col("event_id") % 6 + 1).cast("int"))
    rows = t.table(spark, d, "events").select("event_id", text.error_code(F.concat(head, F.col("event_type"))).alias("code"))
    return rows.select("event_id", "code", text.exit_status(F.col("code")).alias("status"))


_ENDS = "CASE doc_id % 8 WHEN 0 THEN '{}' WHEN 1 THEN '{}' WHEN 2 THEN '{}' WHEN 3 THEN '{}' WHEN 4 THEN '{}' WHEN 5 THEN '{}' WHEN 6 THEN '{}' ELSE '{}' END"


@registered(f"""WITH {_DOCS} SELECT doc_id, {_ENDS.format('py', 'md', 'mmd', 'json', 'ts', 'html', 'rs', 'mermaid')} AS ending, {_ENDS.format('code', 'doc', 'graph', 'doc', 'code', 'code', 'code', 'graph')} AS class, {_BUCKET} AS bucket,
  {_ENDS.format('python', 'markdown', 'mermaid', 'json', 'typescript', 'html', 'rust', 'mermaid')} AS language, doc_id % 8 IN (1, 2, 3, 7) AS prefixed, doc_id % 8 IN (1, 2) AS by_heading, doc_id % 8 = 4 AS test, doc_id % 8 IN (1, 3, 5) AS ranks_doc, doc_id % 8 IN (2, 7) AS ranks_graph FROM docs""")
def path_classes(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return t.documents(spark, d).select(
        "doc_id", paths.extension(p).alias("ending"), paths.retrieval_class(p).alias("class"), paths.bucket(p).alias("bucket"), paths.language(p).alias("language"), paths.takes_prefix(p).alias("prefixed"),
        paths.is_markdown(p).alias("by_heading"), paths.is_test(p).alias("test"), paths.ranks_as_doc(p).alias("ranks_doc"), paths.ranks_as_graph(p).alias("ranks_graph"),
    )


_HEAD = "array_to_string(list_slice(l, 1, {}), chr(10))"


@registered(f"""WITH s AS (SELECT doc_id, CASE WHEN length(text) = 0 THEN [] ELSE {_LINES} END AS l, text FROM documents)
SELECT doc_id, sha256(CASE WHEN len(l) > 3 OR length({_HEAD.format(3)}) > 80 THEN left({_HEAD.format(3)}, 80) || '...' ELSE {_HEAD.format(3)} END) AS preview_sha, sha256({_HEAD.format(8)}) AS short_sha, sha256({_HEAD.format(24)}) AS long_sha, contains(lower(text), 'the ') AS has_the,
  sha256(array_to_string(list_slice(list_filter(l, lambda x: NOT regexp_matches(trim(x, ' '), '^[\\[\\](){{}};,]*$')), 1, 16), chr(10))) AS agent_sha FROM s""")
def previews(spark: SparkSession, d: str) -> DataFrame:
    body, sha = F.col("text"), lambda c: F.sha2(c.cast("binary"), 256)
    return t.table(spark, d, "documents").select(
        "doc_id", sha(text.preview(body, 3, 80)).alias("preview_sha"), sha(text.snippet(body, "short")).alias("short_sha"), sha(text.snippet(body, "long")).alias("long_sha"),
        text.contains_ignoring_case(body, F.lit("THE ")).alias("has_the"), sha(present.agent_lines(body)).alias("agent_sha"),
    )


@registered("""WITH n AS (SELECT event_id, CAST(2 * (event_id * event_id * event_id % 3000000000) + 1 AS BIGINT) AS n, CAST(event_id * 37 AS BIGINT) AS age FROM events)
SELECT event_id, CASE WHEN n >= 1073741824 THEN printf('%.1f GB', n / 1073741824.0) WHEN n >= 1048576 THEN printf('%.1f MB', n / 1048576.0) WHEN n >= 1024 THEN printf('%.1f KB', n / 1024.0) ELSE n || ' B' END AS size,
  CASE WHEN age < 60 THEN 'just now' WHEN age < 3600 THEN (age // 60) || 'm ago' WHEN age < 86400 THEN (age // 3600) || 'h ago' ELSE (age // 86400) || 'd ago' END AS age FROM n""")
def human_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Sizes and ages from event ids; sizes are odd, so that no decimal lies half way."""
    last = lambda c: c % 3_000_000_000
    # of each product only the rest goes on: the cube itself leaves 64 bits from 2,100,000 on, two rests never do
    n = (2 * last(last(last(F.col("event_id")) * last(F.col("event_id"))) * last(F.col("event_id"))) + 1).cast("long")
    return t.table(spark, d, "events").select("event_id", text.human_size(n).alias("size"), text.age((F.col("event_id") * 37).cast("long")).alias("age"))


@registered(f"""WITH {_DOCS} SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE path END AS cleaned, source || ' é+' || doc_id AS decoded, source || '-' || lang AS slug FROM docs""")
def path_repairs(spark: SparkSession, d: str) -> DataFrame:
    dirty = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("../"), "path")).otherwise(F.concat(F.lit("./"), F.replace("path", F.lit("/"), F.lit("\\"))))
    uri = F.concat(F.lit("file:///"), F.replace(F.url_encode(F.concat("source", F.lit(" é+"), F.col("doc_id").cast("string"))), F.lit("+"), F.lit("%20")))
    remote = F.concat(F.lit("git@host.example:"), "source", F.lit("/"), "lang", F.when(F.col("doc_id") % 2 == 0, ".git").otherwise("/"))
    return t.documents(spark, d).select("doc_id", paths.normalised(dirty).alias("cleaned"), F.ltrim(paths.from_file_uri(uri), F.lit("/")).alias("decoded"), text.repository_slug(remote).alias("slug"))


@registered("SELECT doc_id, sha256(unhex(left(hex(encode(text)), 8192))) AS head_hash, left(sha256(text), 12) AS short FROM documents")
def file_hashes(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "documents").select("doc_id", identity.head_hash(F.col("text").cast("binary")).alias("head_hash"), identity.short(identity.chunk_hash(F.col("text"))).alias("short"))


@registered("WITH m AS (SELECT vec_id // 8 AS doc, i, avg(CAST(embedding[i] AS DOUBLE)) AS a FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2), f AS (SELECT vec_id // 8 AS doc, CAST(embedding[1] AS DOUBLE) AS first FROM embeddings WHERE vec_id % 8 = 0) SELECT m.doc, round(sqrt(sum(a * a)), 6) AS mean_norm, round(any_value(first), 6) AS first FROM m JOIN f ON f.doc = m.doc GROUP BY m.doc")
def vector_pools(spark: SparkSession, d: str) -> DataFrame:
    groups = _token_groups(spark, d)
    mean = vectors.mean_pool(F.col("tokens"))
    return groups.select("doc", F.round(F.sqrt(vectors.dot(mean, mean)), 6).alias("mean_norm"), F.round(F.element_at(vectors.first_pool(F.col("tokens")), 1), 6).alias("first"))


@registered(f"WITH q AS (SELECT vec_id, embedding, {_ABS} / 127 AS scale FROM embeddings), z AS (SELECT vec_id, scale, list_transform(embedding, lambda x: CAST(trunc(CAST(x AS DOUBLE) / scale) AS BIGINT)) AS q FROM q), r AS (SELECT vec_id, scale, list_filter(list_transform(range(0, 8), lambda i: list_slice(q, i * 8 + 1, i * 8 + 8)), lambda v: len(list_filter(v, lambda x: x <> 0)) > 0) AS rows FROM z) SELECT vec_id, CAST(len(rows) AS INTEGER) AS live, round(list_sum(list_transform(flatten(rows), lambda x: x * scale)), 6) + 0.0 AS total FROM r")
def dequantised_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Each vector as eight tokens of eight components, quantised and read back, with an infinite tail that becomes nothing."""
    v = vectors.finite(F.concat("embedding", F.array(F.lit(float("inf")).cast("float"))))
    rows = t.table(spark, d, "embeddings").select("vec_id", vectors.quantisation_scale(v).alias("scale"), vectors.quantised(v).alias("q"))
    rows = rows.withColumn("rows", vectors.dequantised(F.col("q"), F.col("scale"), 8))
    return rows.select("vec_id", F.size("rows").alias("live"), (F.round(F.aggregate(F.flatten("rows"), F.lit(0.0), lambda s, x: s + x), 6) + 0.0).alias("total"))


@registered(f"WITH {_CHUNKS}, f AS (SELECT query_id, doc_id, source || '/' || lang AS file, CAST(start_line % 3 AS INTEGER) AS line, round(p.score, 6) AS score, row_id, num_lines FROM pairs p JOIN documents USING (doc_id)) SELECT query_id, file AS path, line AS start_line, doc_id FROM f QUALIFY row_number() OVER (PARTITION BY query_id, file, line ORDER BY score DESC, row_id, num_lines) = 1")
def keep_best_results(spark: SparkSession, d: str) -> DataFrame:
    chunks = t.chunk_rows(spark, d).withColumn("start_line", F.col("start_line") % 3).withColumn("path", F.regexp_replace("path", "/[^/]*$", ""))
    return ranking.keep_best(_matches(spark, d, chunks, [pairs.Cut(1, ("path", "start_line"))]), ["query_id"]).select("query_id", "path", "start_line", "doc_id")


_BEST = f"{_CHUNKS}, best AS (SELECT query_id, doc_id, path, start_line, num_lines, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, path, start_line, row_id, num_lines) AS INTEGER) AS rank FROM pairs QUALIFY rank <= 30)"


def _best(spark: SparkSession, d: str) -> DataFrame:
    return ranking.ranked(_matches(spark, d, t.chunk_rows(spark, d), [pairs.Cut(30)]), ["query_id"]).where(F.col("rank") <= 30)


@registered(f"WITH {_BEST} SELECT query_id, doc_id, {_BUCKET} AS section, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE {_BUCKET} WHEN 'code' THEN 0 WHEN 'docs' THEN 1 ELSE 2 END, rank) AS INTEGER) AS number FROM best")
def result_sections(spark: SparkSession, d: str) -> DataFrame:
    return present.sections(_best(spark, d)).select("query_id", "doc_id", "section", "number")


@registered(f"WITH {_BEST} SELECT query_id, regexp_replace(path, '/[^/]*$', '') AS path, min(rank) AS rank, min(n) AS files, true AS named FROM best JOIN (SELECT query_id, count(DISTINCT regexp_replace(path, '/[^/]*$', '')) AS n FROM best GROUP BY 1) USING (query_id) GROUP BY 1, 2")
def compact_paths(spark: SparkSession, d: str) -> DataFrame:
    rows = _best(spark, d).withColumn("path", F.regexp_replace("path", "/[^/]*$", ""))
    names = present.compact_by_name(rows).withColumn("named", F.lit(True))
    return present.compact(rows).join(present.file_count(rows), "query_id").join(names, ["query_id", "path"]).select("query_id", "path", "rank", "files", "named")


@registered(f"WITH {_BEST}, s AS (SELECT query_id, rank, best.path, start_line, CAST(start_line + num_lines AS INTEGER) AS end_line, CASE WHEN length(text) = 0 THEN [] ELSE {_LINES} END AS l FROM best JOIN docs USING (doc_id)) SELECT query_id, rank, path, start_line, end_line, sha256(regexp_replace({_HEAD.format(12)}, '[\\x00-\\x08\\x0b-\\x1f\\x7f]', '', 'g')) AS snippet_sha, CAST(greatest(len(l) - 12, 0) AS INTEGER) AS more_lines FROM s")
def output_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = _best(spark, d).join(t.table(spark, d, "documents").select("doc_id", F.col("text").alias("content")), "doc_id").withColumn("match_pct", F.lit(None).cast("int"))
    return present.output_rows(rows).select("query_id", "rank", "path", "start_line", "end_line", F.sha2(F.col("snippet").cast("binary"), 256).alias("snippet_sha"), "more_lines")


@registered(f"WITH {_DOCS}, parent AS (SELECT path AS path_key, segment, doc_id FROM docs WHERE doc_id % 3 <> 0) SELECT path_key, segment FROM parent WHERE doc_id % 7 <> 0 AND doc_id % 5 <> 0 UNION ALL SELECT path, 'seg_9' FROM docs WHERE doc_id % 5 = 0")
def segment_index_merge(spark: SparkSession, d: str) -> DataFrame:
    docs = t.documents(spark, d).withColumnRenamed("path", "path_key")
    added = docs.where(F.col("doc_id") % 5 == 0).select("path_key", F.lit("seg_9").alias("segment"))
    return changes.merge_segment_index(docs.where(F.col("doc_id") % 3 != 0).select("path_key", "segment"), docs.where(F.col("doc_id") % 7 == 0), added)


@registered("SELECT 's' || s_suppkey AS name FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_orderkey % 1499 = 0)")
def unreferenced_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Orders stand for manifests, their suppliers for segments."""
    name = lambda c: F.concat(F.lit("s"), F.col(c).cast("string"))
    manifests = t.table(spark, d, "lineitem").where(F.col("l_orderkey") % 1499 == 0).groupBy("l_orderkey").agg(F.collect_list(name("l_suppkey")).alias("segments"))
    return changes.unreferenced(t.table(spark, d, "supplier").select(name("s_suppkey").alias("name")), manifests)


@registered(f"""WITH {_DOCS}, k AS (SELECT *, min(path) OVER h AS least FROM docs WINDOW h AS (PARTITION BY text)), u AS (SELECT path, text, doc_id FROM k WHERE path = least),
stored AS (SELECT path, text FROM u), now AS (SELECT CASE WHEN doc_id % 4 = 1 THEN 'moved/' || path ELSE path END AS path, text, doc_id FROM u WHERE doc_id % 9 <> 0)
SELECT path AS path_key, CASE WHEN doc_id % 4 = 1 THEN 'rename' ELSE 'same' END AS action, CASE WHEN doc_id % 4 = 1 THEN substr(path, 7) END AS old_path FROM now
UNION ALL SELECT path, 'rename_from', NULL FROM u WHERE doc_id % 9 <> 0 AND doc_id % 4 = 1 UNION ALL SELECT path, 'delete', NULL FROM u WHERE doc_id % 9 = 0""")
def renames(spark: SparkSession, d: str) -> DataFrame:
    """One file of each distinct text; every fourth has moved, every ninth is gone."""
    one = t.documents(spark, d).groupBy("text").agg(F.min_by(F.struct("path", "doc_id"), "path").alias("u")).select("u.path", "u.doc_id", identity.chunk_hash(F.col("text")).alias("hash"))
    stored = one.select(F.col("path").alias("path_key"), "hash")
    moved = F.when(F.col("doc_id") % 4 == 1, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path"))
    now = one.where(F.col("doc_id") % 9 != 0).select(moved.alias("path_key"), "hash")
    return changes.with_renames(changes.detect_changes(now, stored), now, stored)


@registered("""WITH m AS (SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS r FROM conversations)
SELECT conv_id, '[diagram-summary]' || chr(10) || 'Mermaid sequence messages: ' || string_agg(role || ' -> bot: turn ' || turn, '; ' ORDER BY r) || chr(10) || chr(10) || 'text' AS stored FROM m WHERE r <= 48 GROUP BY 1""")
def sequence_summary(spark: SparkSession, d: str) -> DataFrame:
    """Conversations drawn as sequence diagrams, in fences inside a quote, summarised for embedding."""
    line = F.concat("role", F.lit("->>bot: turn "), F.col("turn").cast("string"))
    charts = t.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", line.alias("line")))).alias("m"))
    body = F.concat(F.lit("> ```mermaid\n> sequenceDiagram\n> "), F.array_join(F.transform("m", lambda x: x["line"]), "\n> "), F.lit("\n> ```\n"))
    summary = charts.select("conv_id", diagrams.diagram_summary(body, F.lit(False)).alias("s"))
    return summary.select("conv_id", text.embedding_text(F.lit("text"), F.col("s"), F.lit(None).cast("string")).alias("stored"))


@registered("SELECT vec_id, CASE WHEN vec_id % 7 = 0 OR vec_id % 11 = 0 THEN 'bad embedding' END AS error FROM embeddings")
def embedding_failures(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh vector is one component short, every eleventh has none that is a number."""
    v = F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 63)).when(F.col("vec_id") % 11 == 0, F.transform("embedding", lambda x: x * float("nan"))).otherwise(F.col("embedding"))
    return embedding.failed(t.table(spark, d, "embeddings").select("vec_id", v.alias("embedding")), 64).select("vec_id", "error")


@registered("SELECT doc_id, CAST(strlen(text) AS DOUBLE) AS first, CAST(8 AS INTEGER) AS dim FROM documents")
def embed_once(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct text is embedded once; a third of them are in the cache already."""
    rows = t.table(spark, d, "documents").select("doc_id", identity.chunk_hash(F.col("text")).alias("chunk_id"), "text")
    embedder = embedding.LengthEmbedder(8)
    cache = embedder.embed(rows.where(F.col("doc_id") % 3 == 0).dropDuplicates(["chunk_id"])).select("chunk_id", "embedding")
    out = embedding.embed_new(rows, cache, embedder)
    return out.select("doc_id", F.element_at("embedding", 1).cast("double").alias("first"), F.size("embedding").alias("dim"))


@registered("""SELECT doc_id, sha256(source || ' > ' || lang || chr(10) || '---' || chr(10) || text) AS header_sha, CASE doc_id % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'other' WHEN 2 THEN NULL ELSE 'class' END AS chunk_type,
  CASE doc_id % 4 WHEN 0 THEN 'Definition' WHEN 3 THEN 'Definition' ELSE '' END || CASE WHEN doc_id % 8 = 4 THEN '+Test' ELSE '' END || CASE WHEN doc_id % 11 = 0 THEN '+Anchor' ELSE '' END AS tags FROM documents""")
def chunk_labels(spark: SparkSession, d: str) -> DataFrame:
    """Header, parsed type and tags; the tags are written one after another with a plus sign before all but Definition."""
    kind = ranking.known_chunk_type(F.element_at(F.array(F.lit("Function"), F.lit("mystery"), F.lit(None), F.lit("class")), (F.col("doc_id") % 4 + 1).cast("int")))
    tags = F.array_join(F.transform(text.tags(kind, paths.is_test(F.col("path")), F.col("doc_id") % 11 == 0), lambda x: F.when(x == "Definition", x).otherwise(F.concat(F.lit("+"), x))), "")
    header = text.chunk_header(F.array("source", "lang"), F.col("text"))
    return t.documents(spark, d).select("doc_id", F.sha2(header.cast("binary"), 256).alias("header_sha"), kind.alias("chunk_type"), tags.alias("tags"))


@registered("SELECT c_custkey AS store FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)")
def orphan_stores(spark: SparkSession, d: str) -> DataFrame:
    """Customers stand for store folders, orders for the metadata that knows them."""
    return changes.orphans(t.table(spark, d, "customer").select(F.col("c_custkey").alias("store")), t.table(spark, d, "orders").where(F.col("o_orderkey") % 3 == 0).select(F.col("o_custkey").alias("store")))


@registered(f"WITH {_DOCS} SELECT source AS dir, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(CAST('0x' || left(sha256(encode(path) || '\\x00'::BLOB || encode(sha256(text))), 12) AS BIGINT)) AS VARCHAR) AS digest FROM docs GROUP BY source")
def directory_digest(spark: SparkSession, d: str) -> DataFrame:
    files = t.documents(spark, d).select(F.col("source").alias("dir"), F.col("path").alias("name"), F.octet_length("text").alias("size"), identity.chunk_hash(F.col("text")).alias("hash"))
    return changes.directory_digests(files)


@registered(f"WITH l AS (SELECT doc_id, {_LINES} AS l FROM documents WHERE length(text) > 0) SELECT doc_id, CAST(coalesce(list_sum(list_transform(list_slice(l, 1, 1), lambda x: strlen(x) + 1)), 0) AS BIGINT) AS start, CAST(coalesce(list_sum(list_transform(list_slice(l, 1, 5), lambda x: strlen(x) + 1)), 0) AS BIGINT) AS \"end\" FROM l")
def byte_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The bytes of the second to the fifth line."""
    rows = t.table(spark, d, "documents").where(F.length("text") > 0)
    return rows.select("doc_id", text.byte_range(text.lines(F.col("text")), F.lit(1), F.lit(5)).alias("r")).select("doc_id", "r.start", "r.end")


@registered("""SELECT event_id, '{"error":{"code":"' || CASE event_id % 3 WHEN 0 THEN 'busy' WHEN 1 THEN 'timeout' ELSE 'internal' END || '","message":"' || CASE event_id % 3 WHEN 0 THEN 'busy: \\"' WHEN 1 THEN 'timeout: \\"' ELSE 'lost: \\"' END || event_type || '\\""}}' AS envelope,
  CASE WHEN user_id % 5 = 0 THEN 'ok' WHEN user_id % 7 = 0 OR value > user_id % 5 * 100 THEN 'warn' ELSE 'ok' END AS severity FROM events""")
def error_envelopes(spark: SparkSession, d: str) -> DataFrame:
    head = F.element_at(F.array(F.lit("busy"), F.lit("timeout"), F.lit("lost")), (F.col("event_id") % 3 + 1).cast("int"))
    message = F.concat(head, F.lit(': "'), "event_type", F.lit('"'))
    value = F.when(F.col("user_id") % 7 != 0, F.col("value"))
    return t.table(spark, d, "events").select("event_id", text.error_envelope(text.error_code(message), message).alias("envelope"), sync.budget_severity(value, F.col("user_id") % 5 * 100).alias("severity"))


@registered(f"WITH dw AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS total FROM (SELECT doc_id, unnest(w) AS term FROM dw) GROUP BY term")
def postings_index(spark: SparkSession, d: str) -> DataFrame:
    """The stored index of all words of all documents, read back as term statistics."""
    return lexical.build_index(t.table(spark, d, "documents").select("doc_id", "text")).term_statistics().select("term", "df", "total")


@registered(f"WITH {_CHUNKS}, n AS (SELECT query_id, {_BUCKET} AS bucket, count(*) AS observed FROM pairs GROUP BY 1, 2), k AS (SELECT query_id, doc_id, {_BUCKET} AS bucket, score FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id, {_BUCKET} ORDER BY score DESC, path, row_id) <= 60) SELECT k.query_id, k.bucket, count(*) AS kept, max(CASE WHEN observed > 60 THEN observed ELSE 0 END) AS observed, round(min(score), 6) AS least FROM k JOIN n ON n.query_id = k.query_id AND n.bucket = k.bucket GROUP BY 1, 2")
def candidate_limits(spark: SparkSession, d: str) -> DataFrame:
    """Sixty candidates of each query and bucket, and what the cap held back."""
    by = ["query_id", "bucket"]
    chunks = t.chunk_rows(spark, d).select("doc_id", "path", "row_id", paths.bucket(F.col("path")).alias("bucket"), "embedding")
    kept = ranking.candidate_cap(_nearest(spark, d, chunks, pairs.Cut(60, ("bucket",))), by, 60).groupBy(*by).agg(F.count(F.lit(1)).alias("kept"), F.round(F.min("score"), 6).alias("least"))
    # every query meets every chunk, so a bucket holds back as much from each
    return kept.join(ranking.limits_hit(chunks, ["bucket"], 60), "bucket", "left").select(*by, "kept", F.coalesce("observed", F.lit(0)).alias("observed"), "least")


@registered("SELECT CAST(ceil(strlen(text) / 32.0) AS BIGINT) AS bucket, count(*) AS texts FROM documents GROUP BY 1")
def length_buckets(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "documents").groupBy(vectors.length_bucket(F.octet_length("text")).alias("bucket")).agg(F.count(F.lit(1)).alias("texts"))


@registered("SELECT event_id, CASE WHEN user_id % 9 = 0 THEN 100 ELSE CAST(least(event_id % 50 * 100 // (user_id % 9 * 5), 100) AS INTEGER) END AS percent FROM events")
def sync_progress(spark: SparkSession, d: str) -> DataFrame:
    """Event ids stand for files done, user ids for files in all."""
    return t.table(spark, d, "events").select("event_id", sync.progress_percent(F.col("event_id") % 50, F.col("user_id") % 9 * 5).alias("percent"))


# the generated files line by line, and the spans of their definitions by arithmetic
_CODE = r"""f AS (SELECT doc_id, CAST(doc_id % 4 + 1 AS INTEGER) AS n, CAST(doc_id % 3 AS INTEGER) AS kind, CAST(doc_id AS VARCHAR) AS id, regexp_replace(left(coalesce(text, ''), 30), '[^A-Za-z]', ' ', 'g') AS w FROM documents),
code AS (SELECT doc_id, n, kind, id, CASE kind
  WHEN 0 THEN ['// ' || w || ' it''s { "', 'import { x } from "m{";', 'export class C' || id || ' {']
    || flatten(list_transform(range(n), lambda j: ['  async m' || j || '(a, b = "}") {', '    const s = `{${a}`;', '    if (a) { return ''{''; }', '  }']))
    || ['}', 'export const f' || id || ' = (x) => {', '  return x;', '};', 'console.log("' || w || ' {");']
  WHEN 1 THEN ['// ' || w || ' it''s {', 'pub struct S' || id || '<''a> { x: &''a str }', 'impl<''a> S' || id || '<''a> {']
    || flatten(list_transform(range(n), lambda j: ['    pub fn m' || j || '(&self) -> char {', '        let c = ''{'';', '        c', '    }']))
    || ['}', 'fn f' || id || '() -> &''static str {', '    r#"}"' || w || '"#', '}', 'use std::fmt;']
  ELSE ['# ' || w || ' (', 'import os', 'class C' || id || '(object):']
    || flatten(list_transform(range(n), lambda j: ['    @property', '    def m' || j || '(self, a=")"):', '        \"\"\"' || w, 'def no(): \"\"\"']))
    || ['def f' || id || '(', '        a,', '    ):', '    return a', 'print("' || w || '")'] END AS l FROM f),
outer_type AS (SELECT *, CASE kind WHEN 1 THEN 'Symbol: S' ELSE 'Class: C' END || id AS own FROM code),
spans AS (
  SELECT doc_id, l, 0 AS a, CASE kind WHEN 1 THEN 1 ELSE 2 END AS b, 'block' AS type, '' AS label, '' AS crumb, 0 AS depth FROM outer_type
  UNION ALL SELECT doc_id, l, 1, 2, 'class', own, own, 1 FROM outer_type WHERE kind = 1
  UNION ALL SELECT doc_id, l, 2, CASE kind WHEN 2 THEN 3 ELSE 4 END + 4 * n, 'class', own, own, 1 FROM outer_type
  UNION ALL SELECT doc_id, l, 3 + 4 * j, 7 + 4 * j, 'function', m || j, own || ' > ' || m || j, 2
    FROM (SELECT *, CASE kind WHEN 1 THEN 'Function: m' ELSE 'Method: m' END AS m, unnest(range(n)) AS j FROM outer_type)
  UNION ALL SELECT doc_id, l, CASE kind WHEN 2 THEN 3 ELSE 4 END + 4 * n, 7 + 4 * n, 'function', 'Function: f' || id, 'Function: f' || id, 1 FROM outer_type
  UNION ALL SELECT doc_id, l, 7 + 4 * n, 8 + 4 * n, 'block', '', '', 0 FROM outer_type)""".replace('\\"', '"')


@registered(f"WITH {_CODE} SELECT doc_id, CAST(a AS INTEGER) AS start_line, CAST(b AS INTEGER) AS end_line, type AS chunk_type, label, crumb AS breadcrumb, CAST(depth AS INTEGER) AS depth FROM spans")
def definition_spans(spark: SparkSession, d: str) -> DataFrame:
    """Definitions of a source file of each document, at any depth, and the gaps between."""
    return definitions.definition_rows(t.source_files(spark, d)).drop("path")


@registered(f"WITH {_CODE} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a, b) AS BIGINT) AS ordinal, CAST(a AS INTEGER) AS start_line, CAST(b AS INTEGER) AS end_line, type AS chunk_type, crumb AS label, sha256(array_to_string(l[a + 1:b], chr(10))) AS chunk_hash FROM spans")
def code_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of the same files by the table function, from SQL."""
    chunking.register(spark)
    return spark.sql("SELECT doc_id, c.ordinal, c.start_line, c.end_line, c.chunk_type, c.label, sha2(c.chunk, 256) AS chunk_hash FROM {files} f, LATERAL chunks_of(path, text) c", files=t.source_files(spark, d))


# rules of the root and of one folder; the last that matches a path or a folder above it decides
_RULES = [("", "*.html\nsrc3/\n/src4/de/**\n!src4/de/*.md\n**/fr/*.rs"), ("src5", "*.py\n!*0.py")]


@registered(f"""WITH {_DOCS} SELECT doc_id, path, source = 'src3' OR CASE WHEN source = 'src5' AND path LIKE '%0.py' THEN FALSE WHEN source = 'src5' AND path LIKE '%.py' THEN TRUE
  WHEN lang = 'fr' AND path LIKE '%.rs' THEN TRUE WHEN path LIKE 'src4/de/%.md' THEN FALSE WHEN path LIKE 'src4/de/%' THEN TRUE ELSE path LIKE '%.html' END AS ignored FROM docs""")
def ignored_paths(spark: SparkSession, d: str) -> DataFrame:
    """Ignore rules of two folders over the path of every document."""
    files = t.documents(spark, d).select("doc_id", "path", F.col("path").alias("path_key"))
    return corpus.ignored(files, corpus.rule_table(spark, _RULES, ())).select("doc_id", "path", "ignored")


def _refusing(texts: list[str]):
    """An embedder of byte lengths that a batch with a length divisible by 97 breaks."""
    sizes = [len(x.encode()) for x in texts]
    if any(n % 97 == 0 for n in sizes):
        raise ValueError("refused")
    return [[float(n), 0.0] for n in sizes]


@registered("SELECT doc_id, CASE WHEN strlen(text) % 97 <> 0 THEN CAST(strlen(text) AS DOUBLE) END AS first, CASE WHEN strlen(text) % 97 = 0 THEN 'ValueError: refused' END AS error FROM documents")
def isolated_failures(spark: SparkSession, d: str) -> DataFrame:
    """Batches of texts that an embedder fails on are halved until the texts at fault stand alone."""
    rows = t.table(spark, d, "documents").select("doc_id", "text")
    out = embedding.BatchEmbedder(_refusing, 2, batch=128, retries=1, backoff_ms=0).embed(rows)
    return out.select("doc_id", F.element_at("embedding", 1).cast("double").alias("first"), "error")


# a pack by plain greedy, a step of every query at a time: files are a source and language, aspects the query's words (1 each) and the kind of file (5)
_PACKS = f"""{_DOCS}, {_BM25},
c AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM bm QUALIFY place <= 30),
a AS (SELECT c.query_id, c.doc_id, any_value(place) AS place, -any_value(place) AS score, any_value(source || '/' || lang) AS file, any_value(least(strlen(text), 1500)) AS size,
  list(qt.term) || ['kind:' || any_value({_BUCKET.replace('doc_id', 'docs.doc_id')})] AS aspects
  FROM c JOIN docs ON docs.doc_id = c.doc_id JOIN qt ON qt.query_id = c.query_id JOIN tf ON tf.doc_id = c.doc_id AND tf.term = qt.term GROUP BY 1, 2),
g AS (SELECT query_id, 0 AS step, CAST(NULL AS BIGINT) AS doc_id, CAST(0 AS BIGINT) AS gain, CAST([] AS BIGINT[]) AS ids, CAST([] AS VARCHAR[]) AS files, CAST([] AS VARCHAR[]) AS covered, CAST(9000 AS BIGINT) AS budget FROM (SELECT DISTINCT query_id FROM a)
  UNION ALL SELECT query_id, step, doc_id, gain, list_append(ids, doc_id), list_append(files, file), covered || aspects, budget - size FROM (
    SELECT g.query_id, g.step + 1 AS step, a.doc_id, a.file, a.size, a.aspects, ids, files, covered, budget, place,
      CAST(list_sum([0] || list_transform(list_filter(a.aspects, lambda x: NOT list_contains(covered, x)), lambda x: CASE WHEN starts_with(x, 'kind:') THEN 5 ELSE 1 END)) AS BIGINT) AS gain
    FROM g JOIN a ON a.query_id = g.query_id WHERE NOT list_contains(ids, a.doc_id) AND a.size <= budget AND len(list_filter(files, lambda x: x = a.file)) < 3 AND (list_contains(files, a.file) OR len(list_distinct(files)) < 5))
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, place) = 1)"""


@registered(f"""WITH RECURSIVE {_PACKS},
fin AS (SELECT query_id, arg_max(ids, step) AS ids, arg_max(files, step) AS files, arg_max(budget, step) AS budget FROM g GROUP BY query_id),
hit AS (SELECT a.query_id, bool_or(NOT list_contains(files, file) AND len(list_distinct(files)) >= 5) AS f, bool_or(len(list_filter(files, lambda x: x = file)) >= 3) AS p, bool_or(size > budget) AS t
  FROM a JOIN fin ON fin.query_id = a.query_id WHERE NOT list_contains(ids, a.doc_id) GROUP BY 1),
best AS (SELECT g.query_id, g.doc_id, g.step, g.gain, a.file, a.score, max(a.score) OVER (PARTITION BY g.query_id, a.file) AS best FROM g JOIN a ON a.query_id = g.query_id AND a.doc_id = g.doc_id)
SELECT b.query_id, doc_id, CAST(step AS INTEGER) AS step, gain, CASE WHEN gain > 0 THEN 'coverage' ELSE 'semantic_match' END AS reason, CAST(dense_rank() OVER (PARTITION BY b.query_id ORDER BY best DESC, file) AS INTEGER) AS file_rank,
  CAST(row_number() OVER (PARTITION BY b.query_id, file ORDER BY doc_id) AS INTEGER) AS ordinal,
  concat_ws(',', CASE WHEN f THEN 'max_files' END, CASE WHEN p THEN 'max_per_file' END, CASE WHEN t THEN 'max_total_bytes' END) AS limits_hit FROM best b LEFT JOIN hit ON hit.query_id = b.query_id""")
def covering_packs(spark: SparkSession, d: str) -> DataFrame:
    """Packs of the thirty best matches of every benchmark item that cover its words and kinds of files within budgets."""
    queries = t.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    found = lexical.bm25(t.table(spark, d, "documents").select("doc_id", "text"), queries, 30).select("query_id", F.col("row_id").alias("doc_id"), "lexical_rank")
    rows = found.join(t.documents(spark, d), "doc_id").join(queries, "query_id")
    words = F.transform(F.array_intersect(lexical.terms(F.col("text")), lexical.terms(F.col("query_text"))), lambda x: F.struct(x.alias("aspect"), F.lit(1).alias("weight")))
    kind = F.array(F.struct(F.concat(F.lit("kind:"), paths.bucket(F.col("path"))).alias("aspect"), F.lit(5).alias("weight")))
    # ranks stand for scores
    rows = rows.select(
        "query_id",
        F.concat_ws("/", "source", "lang").alias("path"),
        F.col("doc_id").alias("start_line"),
        F.col("doc_id").alias("row_id"),
        (-F.col("lexical_rank")).cast("double").alias("score"),
        F.least(F.octet_length("text"), F.lit(1500)).alias("size"),
        F.map_from_entries(F.concat(words, kind)).alias("aspects"),
    )
    out = packs.covering_packs(rows, packs.Budget(total_bytes=9000, files=5, per_file=3, candidates=30))
    return out.select("query_id", F.col("row_id").alias("doc_id"), "step", "gain", "reason", "file_rank", "ordinal", F.array_join("limits_hit", ",").alias("limits_hit"))


@registered(f"WITH {_BM25}, c AS (SELECT query_id, score FROM bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 30), s AS (SELECT query_id, CASE WHEN stddev_pop(score) > 1e-9 THEN (max(score) - avg(score)) / stddev_pop(score) ELSE 0 END AS z FROM c GROUP BY 1) SELECT query_id, round(z, 4) AS separation, round(z, 4) < 1.0 AS low_confidence FROM s")
def match_confidence(spark: SparkSession, d: str) -> DataFrame:
    """How far the best of thirty matches of every benchmark item stands out."""
    queries = t.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    found = lexical.bm25(t.table(spark, d, "documents").select("doc_id", "text"), queries, 30)
    return packs.confidence(found.select("query_id", "row_id", F.col("row_id").alias("path"), F.round("score", 6).alias("score")), 30)


def _import_files(spark: SparkSession, d: str) -> DataFrame:
    """A file of each document: it gives out its id and imports that of half its number, its first word and, a third of all, the first file; every tenth gives out its first word."""
    word = F.lower(F.regexp_extract(F.coalesce("text", F.lit("")), "^([A-Za-z]+)", 1))
    brings = lambda name: F.concat(F.lit('import { x } from "'), name, F.lit('"'))
    gives = lambda name: F.concat(F.lit("export const "), name, F.lit(" = 1"))
    own = F.concat(F.lit("m"), F.col("doc_id").cast("string"))
    half = F.concat(F.lit("m"), F.floor(F.col("doc_id") / 2).cast("string"))
    body = F.concat_ws("\n", brings(half), F.when(word != "", brings(word)), F.when(F.col("doc_id") % 3 == 0, brings(F.lit("m0"))), gives(own), F.when((word != "") & (F.col("doc_id") % 10 == 0), gives(word)))
    return t.documents(spark, d).select("doc_id", "path", body.alias("text"))


_LINKS = f"""{_DOCS}, w AS (SELECT doc_id, path, lower(regexp_extract(coalesce(text, ''), '^([A-Za-z]+)', 1)) AS word FROM docs),
brings AS (SELECT path, 'm' || (doc_id // 2) AS name FROM w UNION SELECT path, word FROM w WHERE word <> '' UNION SELECT path, 'm0' FROM w WHERE doc_id % 3 = 0),
gives AS (SELECT path, 'm' || doc_id AS name FROM w UNION SELECT path, word FROM w WHERE word <> '' AND doc_id % 10 = 0),
link AS (SELECT DISTINCT b.path AS source, g.path AS target, name FROM brings b JOIN gives g USING (name))"""


@registered(f"""WITH RECURSIVE {_LINKS}, either AS (SELECT source AS a, target AS b FROM link UNION SELECT target, source FROM link),
r AS (SELECT path, path AS root, 0 AS hops FROM docs WHERE doc_id % 100 = 7 UNION SELECT b, root, hops + 1 FROM r JOIN either ON a = path WHERE hops < 2)
SELECT path, CAST(min(hops) AS INTEGER) AS hops, arg_min(root, (hops, root)) AS root FROM r GROUP BY path""")
def context_reach(spark: SparkSession, d: str) -> DataFrame:
    """What lies within two imports, either way, of the stated files, whose ids end in 07."""
    edges = graph.edges_of(_import_files(spark, d))
    return graph.reach(edges, t.documents(spark, d).where(F.col("doc_id") % 100 == 7).select("path"), 2)


@registered(f"""WITH {_LINKS}, {_BM25}, p AS (SELECT query_id, path FROM bm JOIN docs USING (doc_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 20)
SELECT p.query_id, source, target, name, CASE WHEN count(*) OVER (PARTITION BY p.query_id) > 50 THEN 'max_edges' ELSE '' END AS limits_hit FROM link JOIN p ON p.path = source JOIN p q ON q.path = target AND q.query_id = p.query_id
WHERE source <> target QUALIFY row_number() OVER (PARTITION BY p.query_id ORDER BY source, target, name) <= 50""")
def context_graph(spark: SparkSession, d: str) -> DataFrame:
    """The imports among the twenty best matches of every benchmark item."""
    queries = t.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    found = lexical.bm25(t.table(spark, d, "documents").select("doc_id", "text"), queries, 20).select("query_id", F.col("row_id").alias("doc_id"))
    best = found.join(t.documents(spark, d).select("doc_id", "path"), "doc_id")
    out = graph.pack_graph(best, graph.edges_of(_import_files(spark, d)), 50)
    return out.withColumn("limits_hit", F.array_join("limits_hit", ","))
