import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hayloft.llm import bpe, token_count

from . import helpers as h
from ..conftest import SF


def test_bpe_same_as_the_library():
    rng = random.Random(1)
    own, theirs = bpe.WordBpe(bpe.default_vocabulary()), Tokenizer.from_file(bpe.default_vocabulary())
    letters = "abcdefgh'strevmdl  \n\t\x1c\x85 ÀéßİΣσςǅ中文字🎉👨‍👩‍👧0123٣½<|>_.,!?가각"
    texts = ["", "<|endoftext|>", "a<|endoftext|>B <|startoftext|><|endoftext|", "x" * 5000, "ab" * 3000, "!" * 999, h.LONG]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(800)]
    texts += ["".join(rng.choice("aeintshr") for _ in range(rng.randint(0, 90))) for _ in range(400)]
    for text, ids in zip(texts, own.encode_batch(texts), strict=True):
        want = theirs.encode(text, add_special_tokens=False)
        assert np.frombuffer(ids, "<u4").tolist() == want.ids
        assert own.decode(ids) == theirs.decode(want.ids, skip_special_tokens=False)


def test_bpe_table(spark, monkeypatch):
    theirs = Tokenizer.from_file(bpe.default_vocabulary())
    docs = h.awkward(spark).withColumn("decoded", F.lit(1))
    got = bpe.encode_documents(docs).collect()
    assert len(got) == len(h.AWKWARD)
    for r in got:
        ids = theirs.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.token_ids), "<u4").tolist() == ids and r.n_tokens == len(ids)
    assert bpe.encode_documents(h.empty(spark)).collect() == []
    row = bpe.op9_bpe_segment_tree(spark, SF).orderBy("doc_id").first()
    text = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").first().text
    ids = theirs.encode(text, add_special_tokens=False).ids
    assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_full_cache_changes_nothing(monkeypatch):
    own = bpe.WordBpe(bpe.default_vocabulary())
    texts = [f"word{k} thing{k}" for k in range(300)]
    want = own.encode_batch(texts)
    monkeypatch.setattr(bpe, "CACHE_BYTES", 5000)
    small = bpe.WordBpe(bpe.default_vocabulary())
    assert [small.encode_batch([t])[0] for t in texts] == want


def test_separator_scan_stitches_blocks(spark, tmp_path):
    rng = random.Random(3)
    want = {}
    for k in range(4):
        lengths = [rng.choice([0, 0, 1, 5, 40]) for _ in range(rng.randint(0, 30))]
        ids = [x for n in lengths for x in [*([7] * n), token_count.SEPARATOR]] + [9] * (k % 2 * 13)
        folder = tmp_path / f"f{k}"
        folder.mkdir()
        (folder / "x.bin").write_bytes(np.array(ids, "<u2").tobytes() + b"\n")
        want[f"f{k}"] = [(n, True) for n in lengths] + ([(13, False)] if k % 2 else [])
    for block in (1, 3, 8, 1000):
        got = {}
        for r in token_count.count_tokens(spark, f"file://{tmp_path}", block_tokens=block).orderBy("path", "ordinal").collect():
            got.setdefault(r.path.split("/")[-2], []).append((r.n_tokens, r.complete))
        assert got == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("few", [0, 1 << 30])
def test_bpe_of_long_runs(monkeypatch, few):
    """Both ways of merging, on pieces of all widths and on one unspaced run of 100,000 letters."""
    import time

    monkeypatch.setattr(bpe, "LOCKSTEP", few)
    rng = random.Random(few)
    own, theirs = bpe.WordBpe(bpe.default_vocabulary()), Tokenizer.from_file(bpe.default_vocabulary())
    texts = ["".join(rng.choice("aeintshrlo") for _ in range(n)) for n in [*range(1, 70), 127, 128, 129, 130, 1000]]
    texts += ["".join(rng.choice("a!?é🎉") for _ in range(n)) for n in (2, 3, 9, 33, 500)] + ["aaaa" * 100, "!" * 700]
    if few:
        texts.append("".join(rng.choice("aeintshrlo") for _ in range(100_000)))
    before = time.time()
    for text, ids in zip(texts, own.encode_batch(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids
    assert time.time() - before < 60


def test_counts_of_all_documents(spark):
    e = token_count.encoder(token_count.default_ranks())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = token_count.op8_token_count_scan(spark, SF).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {k: len(e.encode_ordinary(t)) for k, t in texts.items()} and len(got) == len(texts)


def test_awkward_token_files(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    docs = h.awkward(spark).withColumn("file", F.lit(5)).coalesce(1)
    assert token_count.write_token_files(docs, path, file_bytes=64) == 2
    found = token_count.count_tokens(spark, path).collect()
    e = token_count.encoder(token_count.default_ranks())
    assert sorted(r.n_tokens for r in found) == sorted(len(e.encode_ordinary(r[1] or "")) for r in h.AWKWARD)
    empty = f"file://{tmp_path}/e"
    token_count.write_token_files(h.empty(spark), empty)
    assert token_count.count_tokens(spark, empty).collect() == []


@pytest.mark.parametrize("ranged", [True, False])
def test_one_large_file_in_many_stretches(spark, tmp_path, monkeypatch, ranged):
    """Wide ids, blocks dealt as byte ranges or from whole files, a prefix scan over several levels."""
    monkeypatch.setattr(token_count, "STRETCH", 3)
    if not ranged:
        monkeypatch.setattr(token_count, "RANGED", {})
    rng = np.random.default_rng(2)
    lengths = [0, 0, *rng.integers(0, 90, 200).tolist(), 700, 0]
    ids = np.concatenate([np.append(rng.integers(0, 50_000, n) + 70_000, token_count.SEPARATOR) for n in lengths] + [np.full(41, 99_999)])
    (tmp_path / "a b=1").mkdir()
    ids.astype("<u4").tofile(tmp_path / "a b=1" / "one.bin")
    got = token_count.count_tokens(spark, f"file://{tmp_path}", block_tokens=64, width=4).orderBy("ordinal").collect()
    assert [r.n_tokens for r in got] == [*lengths, 41] and [r.complete for r in got] == [True] * len(lengths) + [False]
    assert [r.first_token for r in got] == np.cumsum([0, *(n + 1 for n in lengths)]).tolist()
    assert token_count.token_width(1 << 16) == 2 and token_count.token_width((1 << 16) + 1) == 4


def test_counts_hold_when_splits_change(spark, tmp_path):
    e = token_count.encoder(token_count.default_ranks())
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    docs.write.option("parquet.block.size", 1 << 16).parquet(f"{tmp_path}/documents.parquet")
    got = token_count.op8_token_count_scan(spark, str(tmp_path))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "20k")
    try:
        rows = got.collect()
    finally:
        spark.conf.set(key, before)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts) and {r.doc_id: r.n_tokens for r in rows} == {k: len(e.encode_ordinary(t)) for k, t in texts.items()}


def test_saved_order_of_awkward_rows(spark, tmp_path):
    path, docs = f"file://{tmp_path}/t", h.awkward(spark).coalesce(1)
    token_count.write_token_files(docs, path, file_bytes=64, id_col="doc_id")
    order = token_count.saved_order(spark, path, docs.schema["doc_id"].dataType)
    e = token_count.encoder(token_count.default_ranks())
    got = token_count.placed_counts(order, token_count.count_tokens(spark, path, only="/kind=tokens/")).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == sorted((r[0] or 0, len(e.encode_ordinary(r[1] or ""))) for r in h.AWKWARD)
    empty = f"file://{tmp_path}/e"
    token_count.write_token_files(h.empty(spark), empty, id_col="doc_id")
    order = token_count.saved_order(spark, empty, docs.schema["doc_id"].dataType)
    assert token_count.placed_counts(order, token_count.count_tokens(spark, empty, only="/kind=tokens/")).collect() == []
