import hashlib

import pytest
from pyspark.sql import functions as F

from hayloft.functions import identity, paths, text, vectors


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def matrix(rows):
    return F.array(*(F.array(*(F.lit(float(x)) for x in r)) for r in rows))


def ints(rows):
    return F.array(*(F.array(*(F.lit(x).cast("tinyint") for x in r)) for r in rows))


def test_max_sim(spark):
    eye = matrix([[1, 0], [0, 1]])
    got = one(
        spark,
        plain=vectors.max_sim(eye, matrix([[0.9, 0.1], [0.1, 0.9]])),
        quantised=vectors.max_sim_quantised(eye, ints([[127, 0], [0, 127]]), F.lit(1 / 127)),
        padded=vectors.max_sim_quantised(matrix([[1, 0.5]]), ints([[127, 64], [0, 0], [100, 50]]), F.lit(1 / 127)),
        empty=vectors.max_sim(eye, F.array().cast("array<array<double>>")),
        dot=vectors.dot(matrix([[1, 2, 3]])[0], matrix([[4, 5, 6]])[0]),
    )
    assert (got.plain, got.quantised, got.empty, got.dot) == pytest.approx((1.8, 2.0, 0.0, 32.0))
    assert got.padded == pytest.approx(1 + 32 / 127)


def test_quantise(spark):
    v = F.array(*map(F.lit, (0.5, -0.25, 0.0, 0.1)))
    got = one(spark, q=vectors.quantised(v), s=vectors.quantisation_scale(v), z=vectors.quantised(F.array(F.lit(0.0))), n=vectors.l2_normalised(F.array(F.lit(0.0), F.lit(0.0))), f=vectors.finite(F.array(F.lit(float("nan")), F.lit(2.0))), d=vectors.dequantised(F.array(*(F.lit(x).cast("tinyint") for x in (127, 64, 0, 0, 5))), F.lit(1 / 127), 2), m=vectors.mean_pool(matrix([[1, 2], [3, 4]])))
    assert list(got.q) == [127, -63, 0, 25] and got.s == pytest.approx(0.5 / 127)
    assert list(got.z) == [0] and got.n == [0.0, 0.0] and got.f == [0.0, 2.0] and got.m == [2.0, 3.0]
    assert len(got.d) == 1 and got.d[0] == pytest.approx([1.0, 64 / 127])


def test_identifiers(spark):
    h = hashlib.sha256(b"text").hexdigest()
    chunk = hashlib.sha256(bytes.fromhex(h) + b"chunker-v2" + b"text").hexdigest()
    row = hashlib.sha256(b"a/b.py" + chunk.encode() + (70000).to_bytes(4, "little")).hexdigest()
    got = one(spark, h=identity.chunk_hash(F.lit("text")), c=identity.chunk_id(F.lit(h), F.lit("text")), r=identity.row_id(F.lit("a/b.py"), F.lit(chunk), F.lit(70000)))
    assert (got.h, got.c, got.r) == (h, chunk, row)


def test_text(spark):
    got = one(
        spark,
        l=text.lines(F.lit("a\r\nb\n")),
        none=text.lines(F.lit("")),
        cut=text.utf8_cut(F.lit("aé日"), F.lit(4)),
        clean=text.sanitised(F.lit("\x1b[31mred\x1b[0m\tx\ny\x07")),
        size=text.human_size(F.lit(1536)),
        slug=text.repository_slug(F.lit("git@host.org:owner/repo.git")),
        code=text.error_code(F.lit("Busy: full")),
        other=text.error_code(F.lit("what")),
        short=text.snippet(F.lit("\n".join("abcdefghijklm")), "short"),
    )
    assert list(got.l) == ["a", "b"] and list(got.none) == [] and got.cut == "aé" and got.clean == "red\tx\ny"
    assert (got["size"], got.slug, got.code, got.other, got.short) == ("1.5 KB", "owner-repo", "busy", "internal", "a\nb\nc\nd\ne\nf\ng\nh")


def test_paths(spark):
    names = ["a/b.MD", "a/b.md", "x.html", "y.markdown", "z.mmd", "a.test.ts", "noend", "p/docs/q.rs", "../up", "./w/v.py"]
    rows = spark.createDataFrame([(n,) for n in names], "p string")
    p = F.col("p")
    got = {r.p: r for r in rows.select("p", paths.retrieval_class(p).alias("c"), paths.bucket(p).alias("b"), paths.is_test(p).alias("t"), paths.ranks_as_doc(p).alias("d"), paths.normalised(p).alias("n")).collect()}
    assert [got[n].c for n in names[:5]] == ["code", "doc", "code", "code", "graph"]
    assert [got[n].b for n in names[:5]] == ["docs", "docs", "docs", "docs", "graph"]
    assert got["a.test.ts"].t and got["p/docs/q.rs"].d and not got["noend"].d
    assert got["../up"].n is None and got["./w/v.py"].n == "w/v.py"
