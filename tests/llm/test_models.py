import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from hayloft.llm import language as L
from hayloft.llm import quality as Q

from . import helpers as h
from ..conftest import SF


def test_language_on_held_out_rows(spark):
    got = L.op6_language_ecoc(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").toPandas()
    assert (got.held_out == got.doc_id.map(lambda x: zlib.crc32(str(x).encode()) % 4 == 2)).all()
    own = got[got.held_out & (got.text.str.len() > 40)]
    assert (own.lang == own.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_never_reads_the_label(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.fit(docs.where(~L.held_out(4, 2)))
    a = L.predict(docs, model).select("doc_id", "lang_pred", "score")
    b = L.predict(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("y")), model).select("doc_id", "lang_pred", "score")
    assert a.exceptAll(b).isEmpty()


def test_language_awkward_rows(spark):
    docs = h.awkward(spark).withColumn("score", F.lit("mine"))
    got = {r.doc_id: r for r in L.identify_languages(docs).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (1, 2, 3))
    assert got[4].lang_pred == "de" and got[10].lang_pred in ("en", "fr", "de")
    assert {r.lang_pred for r in L.identify_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert L.identify_languages(h.empty(spark)).collect() == []


def trigrams(text):
    """The byte trigrams of a text, spelt out."""
    raw = bytearray(text.encode())
    for k, b in enumerate(raw):
        if 65 <= b <= 90 or (k and raw[k - 1] == 0xC3 and 0x80 <= b <= 0x9E and b != 0x97):
            raw[k] = b + 32
    letter = [97 <= b <= 122 or b >= 128 for b in raw]
    raw = [b if ok else 32 for b, ok in zip(raw, letter, strict=True)]
    out = []
    for a, b, c in zip(raw, raw[1:], raw[2:], strict=False):
        if (a, b) != (32, 32) and (b, c) != (32, 32):
            out.append(((a << 16 | b << 8 | c) * 2654435761 & 0xFFFFFFFF) >> (32 - L.BUCKET_BITS))
    return out


def test_language_same_as_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    languages = sorted({r.lang for r in rows if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2})
    counts = {v: np.full(1 << L.BUCKET_BITS, 0.05) for v in languages}
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.lang is not None:
            for k in trigrams(r.text or ""):
                counts[r.lang][k] += 1
    share = {v: c / c.sum() for v, c in counts.items()}
    code = dict(zip(languages, L.codewords(len(languages)), strict=True))
    bits = []
    for b in range(len(code[languages[0]])):
        yes, no = (np.mean([share[v] for v in languages if code[v][b] == side], axis=0) for side in (1, -1))
        weight = np.log(yes / no)
        bits.append((weight, float(((yes - no) * weight).sum())))
    trust = sum(t for _, t in bits)
    got = {r.doc_id: r for r in L.op6_language_ecoc(spark, SF).collect()}
    for r in rows:
        text = r.text or ""
        found = trigrams(text)
        margin = [sum(w[k] for k in found) / max(len(found), 1) ** 0.5 for w, _ in bits]
        loss = {v: sum(t / trust * np.logaddexp(0, -m * code[v][b]) for b, (m, (_, t)) in enumerate(zip(margin, bits, strict=True))) for v in languages}
        chance = {v: np.exp(-4 * (x - min(loss.values()))) for v, x in loss.items()}
        ranked = sorted(chance.values())
        mine = got[r.doc_id]
        if not any(c.isalpha() for c in text):
            assert mine.lang_pred == "und" and mine.score == 0
            continue
        assert abs(mine.score - ranked[-1] / sum(ranked)) < 1e-6
        if ranked[-1] - ranked[-2] > 1e-6:
            assert mine.lang_pred == min(loss, key=loss.get)


def test_rare_languages_count_as_unlabelled(spark):
    rows = [(k, f"das ist ein haus und tag {k}", "de") for k in range(8)] + [(20 + k, f"the house is on this hill {k}", "en") for k in range(6)] + [(40 + k, f"zz {k} qq", f"l{k}") for k in range(5)]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_languages=2)
    assert model.languages == ["de", "en"]


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 9, 40):
        code = L.codewords(n)
        gap = min((code[a] != code[b]).sum() for a in range(n) for b in range(a))
        assert len(code) == n and gap >= (1 if n == 2 else 2) and (np.abs(code.sum(axis=0)) < n).all()


def test_quality_on_held_out_rows(spark):
    got = Q.op7_quality_qda(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert (got.held_out == got.doc_id.map(lambda x: zlib.crc32(str(x).encode()) % 5 == 0)).all()
    assert got.score.between(0, 1).all() and ((got.score >= 0.3).astype(int) == got.predicted).all()
    own = got.merge(labels, on="doc_id")
    assert (own.predicted == own.quality).mean() > 0.95


def plain_statistics(text):
    """The statistics of one text by plain Python, under their names."""
    import math
    from collections import Counter

    raw, words = text.encode(), h.words(text)
    lines = [x for x in raw.split(b"\n")]
    lines = [x + b"\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
    size, n = len(raw), len(words)
    marks = [b for b in raw if 33 <= b <= 47 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 126]
    lengths = [len(w.encode()) for w in words]

    def share(part, whole, usual, weight=30.0):
        p = (part + weight * usual) / (whole + weight)
        return math.log(p) - math.log1p(-min(p, 1 - 1e-9))

    mean = (sum(lengths) + 50) / (n + 10)
    spread = math.sqrt(max((sum(x * x for x in lengths) + 350) / (n + 10) - mean**2, 0))
    classes = Counter((b + 32 if 65 <= b <= 90 else b) & 31 for b in raw)
    entropy = -sum(c / size * math.log(c / size) for c in classes.values())
    shouted = sum(bool(re.fullmatch(r"[A-Z]{2,}", w)) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text))
    return {
        "chars": math.log1p(size), "words": math.log1p(n), "word_length": mean, "word_spread": spread,
        "capitals": share(sum(65 <= b <= 90 for b in raw), size, 0.03), "digits": share(sum(48 <= b <= 57 for b in raw), size, 0.01, 300.0),
        "marks": share(len(marks), size, 0.03), "odd_marks": share(sum(chr(b) not in ".,;:!?'\"()-" for b in marks), size, 0.003),
        "spaces": share(sum(b in (9, 10, 11, 12, 13, 32) for b in raw), size, 0.15), "lines": math.log1p(len(lines)), "line_length": math.log1p(size / max(len(lines), 1)),
        "repeated_lines": share(len(lines) - len(set(lines)), len(lines), 0.02), "distinct_words": share(len(set(words)), n, 0.8), "accents": share(sum(b >= 0xC0 for b in raw), size, 0.02),
        "ends": share(sum(b in b".!?" for b in raw), n + sum(b in b".!?" for b in raw), 0.1), "long_words": share(sum(x > 12 for x in lengths), n, 0.05), "short_words": share(sum(x <= 3 for x in lengths), n, 0.4),
        "doubled": share(sum(a == b for a, b in zip(words, words[1:], strict=False)), n, 0.01), "all_caps": share(shouted, n, 0.01), "entropy": (entropy * size + 260) / (size + 100),
    }


def test_quality_same_as_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    x = np.array([[plain_statistics(r.text or "")[k] for k in Q.NAMES] for r in rows])
    y = np.array([labels.get(r.doc_id, -1) if zlib.crc32(str(r.doc_id).encode()) % 5 else -1 for r in rows])
    parts = [x[y == c] for c in (0, 1)]
    own = [np.cov(p.T, bias=True) for p in parts]
    pooled = sum(s * len(p) for s, p in zip(own, parts, strict=True)) / sum(map(len, parts))
    log = []
    for s, p in zip(own, parts, strict=True):
        weight = max(0.1, len(Q.NAMES) / (len(Q.NAMES) + len(p)))
        s = (1 - weight) * s + weight * pooled
        s = 0.98 * s + 0.02 * np.diag(np.diag(pooled)) + 1e-6 * np.eye(len(s))
        d = x - p.mean(axis=0)
        log.append(np.log(len(p)) - 0.5 * np.einsum("ni,ij,nj->n", d, np.linalg.inv(s), d) - 0.5 * np.linalg.slogdet(s)[1])
    want = 1 / (1 + np.exp(-np.clip(log[1] - log[0], -50, 50)))
    got = {r.doc_id: r.score for r in Q.op7_quality_qda(spark, SF).collect()}
    assert np.allclose([got[r.doc_id] for r in rows], want, atol=1e-6)


def test_quality_fit_and_awkward_rows(spark):
    stats = Q.document_statistics(h.awkward(spark).withColumn("stats", F.lit(1)))
    rows = stats.collect()
    assert len(rows) == len(h.AWKWARD) and all(len(r.stats) == len(Q.NAMES) and np.isfinite(r.stats).all() for r in rows)
    assert Q.document_statistics(h.empty(spark)).collect() == []
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (None, 1), (3, None), (4, 7)], "doc_id long, quality int")
    assert [tuple(r) for r in Q.clean_labels(labels).collect()] == [(1, 1)]
    none = Q.fit(Q.class_moments(stats.limit(0).withColumn("quality", F.lit(1))))
    assert {r.score for r in Q.score(stats, none).collect()} == {0.5}
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, len(Q.NAMES)))
    x[200:] = x[200:] * 2 + 1
    moments = {c: (200.0, part.sum(axis=0), part.T @ part) for c, part in ((0, x[:200]), (1, x[200:]))}
    model = Q.fit(moments, pool=0.0, ridge=0.0)
    for c in (0, 1):
        part = x[:200] if c == 0 else x[200:]
        s = np.cov(part.T, bias=True)
        weight = len(Q.NAMES) / (len(Q.NAMES) + 200)
        both = (np.cov(x[:200].T, bias=True) + np.cov(x[200:].T, bias=True)) / 2
        want = np.linalg.inv((1 - weight) * s + weight * both + 1e-6 * np.eye(len(Q.NAMES)))
        assert np.allclose(model.root[c].T @ model.root[c], want)
    assert ((model.score(x) > 0.5) == (np.arange(400) >= 200)).mean() > 0.97
