import zlib

import pytest
from pyspark.sql import functions as F

from hayloft.llm import sharding as S

from . import helpers as h
from ..conftest import SF


def test_placement(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("é"), (F.col("id") % 37).cast("int")).alias("text"))
    got = S.shard_documents(docs, shards=7, slots=512).collect()
    assert len(got) == 3000
    texts = {r.doc_id: r.text for r in docs.collect()}
    sizes = {}
    for r in got:
        raw = texts[r.doc_id].encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
        sizes.setdefault(r.shard, []).append(r.size)
    assert set(sizes) == set(range(7))
    total = [sum(v) for v in sizes.values()]
    assert max(total) - min(total) <= 0.02 * sum(total)
    for s in range(7):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(len(sizes[s])))


def test_awkward_rows(spark):
    got = S.shard_documents(h.awkward(spark).withColumn("shard", F.lit("mine")), shards=3, slots=64).collect()
    assert len(got) == len(h.AWKWARD) and {r.size for r in got if r.doc_id in (1, 2)} == {1}
    for s in {r.shard for r in got}:
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))
    assert S.shard_documents(h.empty(spark), slots=64).collect() == []


def test_rebalancing_edits_the_map(spark, tmp_path):
    totals = {k: (10 + k % 7, 1) for k in range(256)}
    first = S.assign(totals, 4, 256)
    grown = S.rebalance(first, totals, 5)
    held = [sum(totals[k][0] for k in range(256) if grown[k] == s) for s in range(5)]
    assert max(held) <= 1.05 * sum(held) / 5
    moved = [k for k in range(256) if grown[k] != first[k]]
    assert {grown[k] for k in moved} == {4} and len(moved) <= 256 // 5 + 5
    shrunk = S.rebalance(first, totals, 3)
    assert max(shrunk) == 2 and all(shrunk[k] == first[k] for k in range(256) if first[k] < 3)
    path = f"file://{tmp_path}/map"
    S.save_map(spark, path, 1, first, totals)
    S.save_map(spark, path, 2, grown, totals)
    assert [r.shard for r in S.load_map(spark, path).orderBy("virtual_slot").collect()] == grown
    assert [r.shard for r in S.load_map(spark, path, 1).orderBy("virtual_slot").collect()] == first


def test_repeated_rows_spread(spark):
    """A third of the rows on one id and text, a third without id on one text, a third on one id with own texts."""
    n = 30000
    key = F.col("id") % 3
    text = F.when(key < 2, F.repeat(F.lit("copied "), 5)).otherwise(F.concat(F.lit("own text "), F.col("id").cast("string")))
    docs = spark.range(n).select(F.when(key == 0, 7).when(key == 2, 8).cast("long").alias("doc_id"), text.alias("text"))
    got = S.shard_documents(docs, shards=16).select("doc_id", "size", "shard", "slot", "virtual_slot")
    rows = got.collect()
    held, slots = {}, {}
    for r in rows:
        held[r.shard] = held.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == n and sum(held.values()) == docs.agg(F.sum(F.octet_length("text") + 1)).first()[0]
    assert len(held) == 16 and max(held.values()) - min(held.values()) <= 0.02 * sum(held.values()) / 16
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sorted((r.doc_id or 0, r.virtual_slot) for r in rows) == sorted((r.doc_id or 0, r.virtual_slot) for r in S.with_slots(docs.repartition(5)).collect())


def test_versions_are_made_and_rebalanced(spark, tmp_path):
    """Sharding twice on one path makes versions 1 and 2; a rebalance to more shards version 3, moving rows only into new ones."""
    path, docs = f"file://{tmp_path}/map", spark.read.parquet(f"{SF}/documents.parquet")
    first = S.shard_documents(docs, 4, 256, path)
    assert S.shard_documents(docs, 4, 256, path).count() == first.count() == docs.count()
    assert S.newest_version(spark, path) == 2 and S.load_map(spark, path).count() == 256
    with pytest.raises(Exception, match="(?i)exists"):
        S.save_map(spark, path, 2, [0] * 256, {})
    before = {r.doc_id: r.shard for r in first.collect()}
    grown = S.rebalance_documents(docs, path, 5, 256, tolerance=0.2).collect()
    moved = [r for r in grown if r.shard != before[r.doc_id]]
    assert {r.version for r in grown} == {3} and moved and {r.shard for r in moved} == {4} and len(moved) < len(grown) / 3
    with pytest.raises(ValueError):
        S.rebalance_documents(docs, f"file://{tmp_path}/none", 5)


def test_registered_query(spark):
    import zlib

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = S.op3_shard_virtual_slots(spark, SF).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {k: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in docs.items()}
    sizes = [sum(r.size for r in rows if r.shard == k) for k in range(16)]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in rows) and {r.law for r in rows} == {"bytes"}
    for k in range(16):
        own = sorted(r.slot for r in rows if r.shard == k)
        assert own == list(range(len(own)))
