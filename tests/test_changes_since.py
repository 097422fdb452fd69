"""Changes by size and time first; failing batches of an embedder."""

import os

import numpy as np
from pyspark.sql import functions as F

from hayloft.operators import embedding
from hayloft.sources import corpus


def test_unchanged_files_are_not_opened(spark, tmp_path):
    root = tmp_path / "c"
    root.mkdir()
    for name, text in {"a.py": "one", "b c.py": "two", "d+e.py": "three", "_f.py": "four", "g.py": "five"}.items():
        (root / name).write_text(text)
        os.utime(root / name, ns=(10**18, 10**18))
    none = spark.createDataFrame([], "path_key string, size long, mtime timestamp, hash string")
    first = corpus.changes_since(spark, f"file://{root}", none)
    assert sorted((r.path_key, r.action, r.text) for r in first.collect()) == [("_f.py", "add", "four"), ("a.py", "add", "one"), ("b c.py", "add", "two"), ("d+e.py", "add", "three"), ("g.py", "add", "five")]
    known = spark.createDataFrame(first.select("path_key", "size", "mtime", "hash").collect(), none.schema)
    assert corpus.changes_since(spark, f"file://{root}", known).collect() == []
    # other content under the same size and time: nobody opens it
    (root / "a.py").write_text("ONE")
    (root / "_f.py").write_text("FOUR")
    for name in ("a.py", "_f.py"):
        os.utime(root / name, ns=(10**18, 10**18))
    os.utime(root / "b c.py", ns=(10**18, 2 * 10**18))
    (root / "d+e.py").write_text("three!")
    (root / "g.py").unlink()
    (root / "new.py").write_text("six")
    got = sorted((r.path_key, r.action, r.text) for r in corpus.changes_since(spark, f"file://{root}", known).collect())
    assert got == [("b c.py", "touch", "two"), ("d+e.py", "modify", "three!"), ("g.py", "delete", None), ("new.py", "add", "six")]


def test_reads_are_whole():
    sizes, reads = iter([(3, 1), (4, 2), (4, 2), (4, 2)]), iter([b"abc", b"abcd"])
    assert corpus.stable_read(lambda: next(reads), lambda: next(sizes), wait=0) == (b"abcd", (4, 2))
    ticks = iter(range(100))
    assert corpus.stable_read(lambda: b"x", lambda: (1, next(ticks)), wait=0)[0] is None


def test_one_bad_text_costs_few_calls():
    calls, pauses = [], []

    def call(texts):
        calls.append(len(texts))
        if "bad" in texts:
            raise RuntimeError("no")
        return np.ones((len(texts), 2))

    texts = ["ok"] * 10_000
    texts[6_789] = "bad"
    vectors, errors = embedding.isolated(call, texts, retries=2, backoff_ms=10, sleep=pauses.append)
    assert [k for k, e in enumerate(errors) if e] == [6_789] and errors[6_789] == "RuntimeError: no"
    assert sum(v is None for v in vectors) == 1 and len(calls) <= 2 * 14 + 6 and pauses[:2] == [0.01, 0.02]
    calls.clear()
    assert embedding.isolated(call, ["bad"], 1, 0)[1] == ["RuntimeError: no"] and calls == [1, 1]
    assert embedding.isolated(call, [], 1, 0) == ([], [])
    states = iter([RuntimeError("busy"), None])

    def passing(texts):
        problem = next(states)
        if problem:
            raise problem
        return [[1.0]] * len(texts)

    assert embedding.isolated(passing, ["a", "b"], 1, 0) == ([[1.0], [1.0]], [None, None])
    assert embedding.isolated(lambda t: [[1.0]], ["a", "b"], 0, 0)[1] == [None, None]  # too few vectors for two, enough for one


def test_batches_in_tasks(spark):
    def call(texts):
        if any("x" in t for t in texts):
            raise ValueError("x")
        return np.array([[len(t), 1.0] for t in texts])

    rows = spark.range(300).select("id", F.when(F.col("id") % 50 == 0, "x").when(F.col("id") == 7, None).otherwise("yes").alias("text"), F.lit("mine").alias("error"))
    got = embedding.BatchEmbedder(call, 2, batch=32, retries=0, backoff_ms=0).embed(rows).collect()
    assert len(got) == 300 and all((r.error == "ValueError: x" and r.embedding is None) if r.id % 50 == 0 else (r.error is None and list(r.embedding) == [0.0 if r.id == 7 else 3.0, 1.0]) for r in got)
