import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hayloft.llm import imatch as M
from hayloft.llm.blocks import hash_of_words

from . import helpers as h
from ..conftest import SF

FIELDS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def plain_lexicon(texts, common=M.COMMON, rare=M.RARE):
    documents = Counter(w for t in texts for w in set(h.words(t)))
    least, most = max(2, -(-len(texts) // rare)), len(texts) // common
    return {w for w, d in documents.items() if least <= d <= most}


def plain_print(text, band):
    """Kept terms by subset, from the definition: equal sets of terms have equal hashes."""
    kept = set(h.words(text)) & band or set(h.words(text))
    value = dict(zip(kept, hash_of_words([w.encode() for w in kept]), strict=True))
    draws = lambda w, k: int(M.mix(np.array([value[w]]) + M._DRAWS[k])[0])
    return [frozenset(w for w in kept if draws(w, k) < 1 << (63 - 2 * level)) for level in reversed(range(M.LEVELS)) for k in range(M.SUBSETS)]


def plain_likeness(a, b, same):
    met = agree = 0
    for level in range(M.LEVELS):
        if met >= M.ENOUGH:
            break
        for x, y in list(zip(a, b, strict=True))[level * M.SUBSETS : (level + 1) * M.SUBSETS]:
            met += bool(x or y)
            agree += bool(x) and x == y
    return 1.0 if same else agree / met if met else 0.0


def check(docs, rows):
    """Order, texts, fingerprints and likeness by the definitions; rows: (doc_id, text) with distinct ids."""
    found = {r.doc_id: r for r in M.compare_with_next(docs).select(*FIELDS).collect()}
    rows = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(found) == len(rows)
    band = plain_lexicon([t for _, t in rows])
    by_print = {}
    for (doc_id, text), (_, following) in zip(rows, [*rows[1:], rows[0]], strict=True):
        r, half = found[doc_id], len(text) // 2
        changed = (text[:-half] if half else text) + following[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        prints = [plain_print(t, band) for t in (text, changed, following)]
        for found_print, sets, t in ((r.fingerprint, prints[0], text), (r.edited_fingerprint, prints[1], changed)):
            slots = [found_print[16 + 6 * k : 22 + 6 * k] for k in range(M.LEVELS * M.SUBSETS)]
            assert [s == "000000" for s in slots] == [not x for x in sets]
            for slot, terms in zip(slots, sets, strict=True):
                assert by_print.setdefault(terms, slot) == slot
            key = frozenset(h.words(t)) & band or frozenset(h.words(t)) or t
            assert by_print.setdefault(("main", key), found_print[:16]) == found_print[:16]
        terms = [frozenset(h.words(t)) & band or frozenset(h.words(t)) or t for t in (text, changed, following)]
        assert r.near_edited == pytest.approx(plain_likeness(prints[0], prints[1], terms[0] == terms[1]))
        assert r.near_next == pytest.approx(plain_likeness(prints[0], prints[2], terms[0] == terms[2]))
    return found


def test_like_definition(spark):
    rng = np.random.default_rng(4)
    pool = [f"w{k}é" for k in range(400)]
    rows = [(int(k), " ".join(rng.choice(pool, rng.integers(0, 60)))) for k in rng.permutation(150)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows)


def test_awkward_rows(spark):
    distinct = {r[0]: r[:2] for r in h.AWKWARD}.values()
    docs = spark.createDataFrame(list(distinct), "doc_id long, text string").withColumn("bucket", F.lit("mine")).withColumn("fingerprint", F.lit(1))
    found = check(docs, distinct)
    assert found[8].near_next == 1 and found[8].fingerprint == found[9].fingerprint
    assert M.compare_with_next(h.empty(spark)).collect() == []
    alone = M.compare_with_next(spark.createDataFrame([(3, "abc def")], "doc_id long, text string")).collect()
    assert alone[0].near_next == 1 and alone[0].edited_sha256 == hashlib.sha256(b"abc abc").hexdigest()
    added = M.fingerprint_documents(h.awkward(spark).withColumn("fingerprint", F.lit(7)))
    assert added.count() == len(h.AWKWARD) and set(added.columns) == {*h.awkward(spark).columns, "fingerprint"}


def test_repeated_rows_follow_each_other_and_fill_several_ranges(spark):
    rows = [(5, "one two three four")] * 600 + [(k, f"text number {k}") for k in range(5)] + [(k, "last") for k in range(6, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    given = M.with_next(docs).where("NOT ahead").groupBy("bucket").count().collect()
    assert max(r["count"] for r in given) < 500
    found = M.compare_with_next(docs).collect()
    assert len(found) == len(rows)
    own = [r for r in found if r.doc_id == 5]
    assert sum(r.near_next == 1 for r in own) == 599
    assert sum(r.edited_sha256 == hashlib.sha256(b"one two tlast").hexdigest() for r in own) == 1


def test_band_is_bounded(spark):
    rows = [(k, " ".join(f"t{j}" for j in range(200) if k % (j + 1) == 0)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    every, few = M.lexicon(docs), M.lexicon(docs, most=40)
    assert 0 < len(few) <= 40 < len(every) and set(few.tolist()) <= set(every.tolist())


def test_long_texts_in_pieces(monkeypatch):
    text = pa.array([h.LONG])
    whole = M.prints(text, np.zeros(0, np.uint64)).text()
    monkeypatch.setattr(M, "PIECE_BYTES", 1000)
    assert M.prints(text, np.zeros(0, np.uint64)).text() == whole


def test_edited_texts_are_nearer_than_the_next_ones(spark):
    found = M.op12_imatch_subsets(spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id for r in found} == set(docs)
    longer = [r for r in found if len(h.words(docs[r.doc_id])) >= 20]
    nearer = sum(r.near_edited > r.near_next for r in longer)
    assert nearer >= 0.97 * len(longer), (nearer, len(longer))
