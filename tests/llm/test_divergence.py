import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from hayloft.llm import divergence as D

from . import helpers as h
from ..conftest import SF

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
ORDER = ["lang", "source", "part", "item", "value", "rank"]


def plain(rows, least):
    """Rows (text, lang, source) by the definition, term by term."""
    count, documents, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = Counter(TERM.findall((text or "").translate(h.CAPITALS)))
        groups[lang].add(source)
        count[lang, source].update(found)
        documents[lang].update(found.keys())
    out = []
    for lang, sources in groups.items():
        kept = {t for t, d in documents[lang].items() if d >= least}
        v, total = len(kept), {s: sum(count[lang, s][t] for t in kept) for s in sources}
        share = lambda c, n: 1 + 1_000_000_000 * (c + 2) // (n + 2 * v)  # noqa: E731, B023
        p = {s: {t: share(count[lang, s][t], total[s]) for t in kept} for s in sources}
        everywhere = {t: sum(count[lang, s][t] for s in sources) for t in kept}
        q = {t: share(everywhere[t], sum(total.values())) for t in kept}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 10)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked[:most])]
    return sorted(out)


def got(docs, least):
    return sorted(map(tuple, D.audit(docs, least=least).select(*ORDER).collect()))


def made(seed):
    """Two languages, one source with half of all rows, one without terms."""
    rng = np.random.default_rng(seed)
    pool = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}é" for k in range(90)]
    rows = []
    for k in range(160):
        source = "hot" if k % 2 else f"s{rng.integers(0, 6)}"
        rows.append((" ".join(rng.choice(pool, rng.integers(1, 40), p=np.arange(1, 91) / 4095)), "en" if k % 3 else "de", source))
    return [*rows, ("12 34", "en", "bare"), (None, "en", "none"), ("lone Term", "xx", "a"), ("other", "xx", "b"), ("x", None, None)]


@pytest.mark.parametrize("least", [1, 4])
@pytest.mark.parametrize("small", [False, True])
def test_like_definition(spark, monkeypatch, least, small):
    if small:  # many blocks, bands of two sources
        monkeypatch.setattr(D, "CELLS", 16)
        monkeypatch.setattr(D, "BAND", 2)
    rows = made(1)
    assert got(spark.createDataFrame(rows, "text string, lang string, source string"), least) == plain(rows, least)


def test_run_columns():
    rng = np.random.default_rng(0)
    counts = rng.poisson(0.4, (7, 500))
    columns = D.RunColumns(counts)
    p = D.shares(columns.count, np.repeat(counts.sum(axis=1) + 1000, np.diff(columns.first)))
    dense = D.shares(counts, counts.sum(axis=1)[:, None] + 1000)
    want = [int(((dense[2] - dense[o]) ** 2 // (dense[2] + dense[o])).sum()) for o in (0, 3, 6)]
    assert columns.divergence(2, np.array([0, 3, 6]), p).tolist() == want
    assert columns.first[-1] < counts.size / 2  # runs are shorter than the columns


def test_shares_are_exact():
    rng = np.random.default_rng(2)
    size = rng.integers(1, 1 << 52, 500)
    count = (size * rng.random(500)).astype(np.int64) - 2
    assert D.shares(count, size).tolist() == [1 + 10**9 * (int(c) + 2) // int(s) for c, s in zip(count, size, strict=True)]


def test_awkward_rows(spark):
    docs = h.awkward(spark).withColumn("term", F.lit("mine")).withColumn("value", F.lit(1))
    assert got(docs, 1) == plain([r[1:4] for r in h.AWKWARD], 1)
    assert got(docs, 10) == plain([r[1:4] for r in h.AWKWARD], 10)
    assert got(h.empty(spark), 1) == []


def test_full_tallies_are_handed_out(spark, monkeypatch):
    from hayloft.llm import terms

    monkeypatch.setattr(terms, "TALLY_ROWS", 10)
    rows = made(5)
    assert got(spark.createDataFrame(rows, "text string, lang string, source string"), 2) == plain(rows, 2)


def test_whole_table_like_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.execute(D.ORACLE_SQL).fetchall()
    rows = D.op11_divergence_runs(spark, SF).select(*ORDER).collect()
    assert sorted(map(tuple, rows)) == sorted(want)
