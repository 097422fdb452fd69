"""Embedders: anything that adds ``embedding`` (and maybe ``tokens``) to rows with ``text``."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hayloft.functions import vectors


class Embedder(Protocol):
    dim: int

    def embed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``embedding`` (array of float) for its ``text``."""


class LengthEmbedder:
    """The byte length, then zeros: deterministic and free, for tests of everything around it."""

    def __init__(self, dim: int = 8):
        self.dim = dim

    def embed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("embedding", vectors.length_embedding(F.col("text"), self.dim).cast("array<float>"))


class HashingEmbedder:
    """Words hashed to signed components, unit length; runs in Arrow batches without a model."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, rows: DataFrame) -> DataFrame:
        dim = self.dim

        @F.pandas_udf(T.ArrayType(T.FloatType()))
        def run(texts: pd.Series) -> pd.Series:
            out = np.zeros((len(texts), dim), np.float32)
            for k, text in enumerate(texts):
                for word in (text or "").lower().split():
                    h = zlib.crc32(word.encode())
                    out[k, h % dim] += 1 if h & 0x80000000 else -1
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            return pd.Series(list(out / np.where(norm > 0, norm, 1)))

        return rows.withColumn("embedding", run("text"))


def isolated(call: Callable[[list[str]], np.ndarray], texts: list[str], retries: int = 2, backoff_ms: float = 100, sleep=time.sleep) -> tuple[list, list]:
    """(vector of each text or None, error of each text or None); ``call`` takes a batch and may raise.

    A batch that fails is tried again after growing pauses.  If it keeps failing it is
    halved until the texts that fail stand alone, so that b bad ones among n cost about
    2 b log2 n further calls, and all others have their vectors.
    """
    vectors_: list = [None] * len(texts)
    errors: list = [None] * len(texts)

    def attempt(a: int, b: int, tries: int) -> Exception | None:
        problem = None
        for k in range(tries + 1):
            try:
                made = call(texts[a:b])
                if len(made) != b - a:
                    raise ValueError(f"{len(made)} vectors for {b - a} texts")
                vectors_[a:b] = list(made)
                return None
            except Exception as e:  # noqa: BLE001  whatever an embedder raises
                problem = e
                if k < tries and backoff_ms:
                    sleep(backoff_ms * 2**k / 1000)
        return problem

    # whole batches and lone texts are tried again, halves are not
    parts = [(0, len(texts), attempt(0, len(texts), retries))] if texts else []
    while parts:
        a, b, problem = parts.pop()
        if problem is None:
            continue
        if b - a == 1:
            problem = attempt(a, b, retries) if len(texts) > 1 else problem
            errors[a] = problem and f"{type(problem).__name__}: {problem}"
            continue
        middle = (a + b) // 2
        parts += [(x, y, attempt(x, y, 0)) for x, y in ((a, middle), (middle, b))]
    return vectors_, errors


class BatchEmbedder:
    """A function of a batch of texts, run in tasks; texts that it fails on have an ``error`` and no embedding, and never take others with them."""

    def __init__(self, call: Callable[[list[str]], np.ndarray], dim: int, batch: int = 64, retries: int = 2, backoff_ms: float = 100):
        self.call, self.dim, self.batch, self.retries, self.backoff_ms = call, dim, batch, retries, backoff_ms

    def embed(self, rows: DataFrame) -> DataFrame:
        call, size, retries, backoff = self.call, self.batch, self.retries, self.backoff_ms
        rest = rows.drop("embedding", "error")
        place = rest.columns.index("text")
        schema = T.StructType([*rest.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())])

        def run(batches):
            for batch in batches:
                texts = [x or "" for x in batch.column(place).to_pylist()]
                found = [isolated(call, texts[a : a + size], retries, backoff) for a in range(0, len(texts), size)]
                made = [v for part, _ in found for v in part]
                errors = [e for _, part in found for e in part]
                columns = [pa.array([None if v is None else np.asarray(v, np.float32) for v in made], pa.list_(pa.float32())), pa.array(errors, pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

        return rest.mapInArrow(run, schema)


class ColumnEmbedder:
    """Vectors that are in a table already, by a key column."""

    def __init__(self, table: DataFrame, key: str, dim: int):
        self.table, self.key, self.dim = table.select(key, "embedding"), key, dim

    def embed(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.table, self.key, "left")


def embed_new(rows: DataFrame, cache: DataFrame, embedder: Embedder) -> DataFrame:
    """Embeds each distinct chunk once, and only chunks that ``cache`` (chunk_id, embedding) doesn't have."""
    new = rows.select("chunk_id", "text").dropDuplicates(["chunk_id"]).join(cache, "chunk_id", "left_anti")
    known = cache.select("chunk_id", "embedding").unionByName(embedder.embed(new).select("chunk_id", "embedding"))
    return rows.join(known, "chunk_id", "left")


def failed(rows: DataFrame, dim: int) -> DataFrame:
    """Adds ``error`` where an embedding is missing, has another length or a component that is not finite."""
    bad = F.col("embedding").isNull() | (F.size("embedding") != dim) | F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.withColumn("error", F.when(bad, "bad embedding"))
