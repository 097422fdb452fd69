"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept,
and returns a DataFrame that is written as Parquet and read again.  The first
four return the columns of ``documents``, as they came: columns named like a
stage's own are set aside.  ``run`` deletes what a stage wrote once the next
one has been written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hayloft.llm import bpe, decontaminate, jaccard_join, language, secret_scan
from hayloft.llm.blocks import Scratch, set_aside


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (no text or no letter) go."""
    docs, back = set_aside(docs, ["lang_pred", "score", "ambiguous"])
    return language.identify_languages(docs).where(F.col("lang_pred") != "und").select(*back)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least id."""
    return jaccard_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    docs, back = set_aside(docs, ["n_words", "n_hit", "items"])
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.col("n_hit") == 0).select(*back)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows a new text."""
    docs, back = set_aside(docs, ["spans", "redacted"])
    found = secret_scan.scan(docs, secret_scan.fit(docs))
    clean = secret_scan.redact(found.withColumn("redacted", F.size("spans") > 0))
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return clean.withColumn("n_chars", F.when(F.col("redacted"), length).otherwise(F.col("n_chars"))).select(*back)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with a check that decoding them gives the tokens back."""
    encoded = bpe.encode_documents(docs.select("doc_id", "text", "lang", "source", "n_chars"))
    return encoded.select("doc_id", "lang", "source", "n_chars", "n_tokens", "token_ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("secrets", redact_secrets),
    ("encode", encode),
]

#: SQL has no counterpart of the trained models and the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    scratch, before = Scratch(spark), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
