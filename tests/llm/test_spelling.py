import zlib

import duckdb
import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from hayloft.llm import spelling as S

from . import helpers as h
from ..conftest import SF

RUN = regex.compile("[A-Za-zÀ-ÿ]+")


def counted(rows):
    out = {}
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(h.CAPITALS)
            crc = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if crc % 97 == 0:
                at = crc % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 5:
                out[run] = out.get(run, 0) + 1
    return {w: n for w, n in out.items() if n >= 3}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def plain(words):
    others = {w: sorted((v for v in words if near(w, v)), key=lambda v: (-words[v], v)) for w in words}
    form = {w: o[0] if o and words[o[0]] >= 2 * words[w] else None for w, o in others.items()}
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(others[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def got(docs, **more):
    rows = S.variants(docs, **more).select("word", "form", "root", "n", "n_near", "form_n").collect()
    return sorted(map(tuple, rows))


def crowd(seed, words=260):
    """Words of few letters, so that many are near, with counts on several levels; one very long run."""
    rng = np.random.default_rng(seed)
    pool = ["".join(rng.choice(list("abé"), rng.integers(5, 10))) for _ in range(words)] + ["z" * 5000 + "a", "z" * 5000 + "b", "z" * 5001]
    texts = []
    for k, w in enumerate(pool):
        texts += [w] * int(3 * 2 ** rng.integers(0, 5)) if k < words else [w] * (3 + 5 * (k % 2))
    rng.shuffle(texts)
    return [(k, "; ".join(texts[k::40])) for k in range(40)]


@pytest.mark.parametrize("group", [4, 2048])
def test_like_brute_force(spark, group):
    rows = crowd(3)
    want = plain(counted(rows))
    assert len(want) > 150 and any(r[1] and r[2] != r[1] for r in want)
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), group=group) == want


def test_long_words_in_small_tiles(monkeypatch):
    monkeypatch.setattr(S, "TILE_CELLS", 2000)  # one row a tile
    words = ["q" * 300 + x + "r" * 300 for x in ("", "a", "b", "ab")]
    m, one = np.full(4, 600), np.ones(4, np.int64)
    count, best = S.near_in_tiles(m, 2 * one, one, one == 0, 0 * one, words, np.array([9, 3, 4, 5]))
    # pairs whose shorter word has 600 code points, under the key of both ends
    assert count.tolist() == [2, 1, 1, 0] and best.tolist() == [2, 0, 0, -1]


def test_awkward_rows(spark):
    docs = h.awkward(spark).withColumn("word", F.lit("mine")).withColumn("n", F.lit(1))
    assert got(docs) == plain(counted([r[:2] for r in h.AWKWARD]))
    assert got(h.empty(spark)) == []


def test_marked_words_and_latin_signs(spark):
    rows = [(k, "cafés×÷x Āllong Straßen") for k in range(300)]
    want = plain(counted(rows))
    assert {"cafés×÷x", "straßen", "llong"} <= {r[0] for r in want}
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_whole_table_like_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.execute(S.ORACLE_SQL).fetchall()
    rows = S.op13_spelling_tiles(spark, SF).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))
