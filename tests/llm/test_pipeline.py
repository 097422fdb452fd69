"""The pipeline against plain Python over the smallest tables."""

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from hayloft.llm import bpe, language, secret_scan

from . import helpers as h
from .test_decontaminate import brute as contamination
from .test_jaccard import brute as duplicates
from ..conftest import SF


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    kept = [k for k, r in rows.items() if any(c.isalpha() for c in r.text or "")]
    classes = duplicates([(k, rows[k].text) for k in kept])
    kept = [k for k in kept if classes[k][0] == k]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    joined = {tuple(w[i : i + 10]) for _, t in items for w in [h.words(t)] for i in range(len(w) - 9)}
    kept = [k for k in kept if not any(tuple(w[i : i + 10]) in joined for w in [h.words(rows[k].text)] for i in range(len(w) - 9))]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert sorted(got) == sorted(kept)
    theirs = Tokenizer.from_file(bpe.default_vocabulary())
    for k in kept:
        if not secret_scan.base_spans(rows[k].text.encode()):
            assert np.frombuffer(bytes(got[k].token_ids), "<u4").tolist() == theirs.encode(rows[k].text, add_special_tokens=False).ids
    secret = [k for k in kept if secret_scan.base_spans(rows[k].text.encode())]
    assert all(got[k].n_chars < rows[k].n_chars for k in secret)


def test_awkward_rows_and_columns(spark, tmp_path):
    docs = h.awkward(spark)
    # columns named like the stages' own, of other types
    for k, name in enumerate(["spans", "_hash", "hash", "row", "_row", "row_hash", "id", "score", "Items", "n_words", "n_hit", "lang_pred", "class", "rep", "token_ids", "kind", "meta.src", "a`b", "two words"]):
        docs = docs.withColumn(name, F.lit("mine") if k % 2 else F.coalesce(F.col("doc_id"), F.lit(0)) * 100 + k)
    given = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, SF)
        assert made.columns == docs.columns and [f.dataType for f in made.schema] == [f.dataType for f in given.schema], name
        made.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert {r.doc_id for r in docs.collect()} == {4, 5, 8, 10, None}
    assert docs.exceptAll(given).isEmpty()
    assert corpus_pipeline.encode(spark, docs, SF).count() == 5
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, h.empty(spark), SF).collect() == [], name


def test_op_queries_are_registered():
    import __spark_entry__ as e

    names = list(e.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))
    assert language.AMBIGUOUS > 0 and contamination([], []) == []
