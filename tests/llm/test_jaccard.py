import random

import pytest
from pyspark.sql import functions as F

from hayloft.llm import jaccard_join as J
from hayloft.llm.components import components

from . import helpers as h


def brute(rows):
    sets = []
    for _, t in rows:
        w = h.words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return {rows[i][0]: (least[find(i)] if sets[i] else rows[i][0], links[i], len(sets[i])) for i in range(len(rows))}


def corpus(seed, groups=12, members=14):
    rng = random.Random(seed)
    rows, k = [], 0
    for _ in range(groups):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(3, 90))]
        for _ in range(rng.randint(1, members)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                text[rng.randrange(len(text))] = f"x{rng.randint(0, 9999)}"
            rows.append((k, " ".join(text)))
            k += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [128, 3])
def test_same_as_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(J, "BLOCK", block)
    rows = corpus(5)
    got = J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.class_id, r.n_links, r.n_shingles) for r in got.collect()} == brute(rows)


def test_one_large_group_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 8)
    rng = random.Random(1)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(120):
        text = list(base)
        for _ in range(rng.randint(1, 3)):
            text[rng.randrange(200)] = f"x{k}"
        rows.append((k, " ".join(text)))
    got = J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.class_id, r.n_links, r.n_shingles) for r in got.collect()} == brute(rows)


def test_awkward_rows(spark):
    got = J.near_duplicates(h.awkward(spark).withColumn("class", F.lit("mine")).withColumn("n", F.lit(1))).collect()
    assert len(got) == len(h.AWKWARD)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert [by[k].n_shingles for k in (1, 2, 3)] == [0, 0, 0] and [by[k].class_id for k in (1, 2, 3)] == [1, 2, 3]
    assert by[5].n_links == 2 and by[6].n_links == 2 and by[6].class_id == 5
    assert by[8].n_links == 1 and by[9].class_id == 8 and by[4].n_links == 0
    assert J.near_duplicates(h.empty(spark)).collect() == []


def test_keep_one(spark):
    docs = h.awkward(spark)
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 8, 10]
    assert J.keep_one(h.empty(spark)).collect() == []


def forest_pairs(spark, rows, target=J.TARGET_RECALL):
    """Pairs of ids that meet in a node of the forest, and the members of each node."""
    scratch = J.Scratch(spark)
    reps = scratch.write(J.representatives(J.document_signatures(spark.createDataFrame(rows, "doc_id long, text string"))), "reps")
    members = J.node_members(J.sorted_tries(reps, scratch), J.THRESHOLD, target).join(reps.select("rep", "first_doc"), "rep")
    nodes = [sorted(r.m) for r in members.groupBy("node", "size").agg(F.collect_set("first_doc").alias("m")).collect()]
    return {(a, b) for m in nodes for i, a in enumerate(m) for b in m[i + 1 :]}, nodes


def near_pairs(rows):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (h.words(t) for _, t in rows)]
    return {(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i + 1, len(rows)) if sets[i] != sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])}


@pytest.mark.parametrize("block", [128, 4])
def test_recall_of_the_forest(spark, monkeypatch, block):
    """Candidates alone, before clusters: pairs near the threshold, in sparse and in crowded nodes."""
    monkeypatch.setattr(J, "BLOCK", block)
    rng = random.Random(block)
    rows = []
    for group in range(60):
        base = [f"g{group}w{k}" for k in range(254)]
        # one to three words of 250 differ from the base: similarities about 0.79 to 0.96
        for copy in range(6):
            text = list(base)
            for at in rng.sample(range(5, 249), rng.choice([1, 2, 2, 3])):
                text[at] = f"x{group}-{copy}-{at}"
            rows.append((len(rows), " ".join(text)))
    wanted = {(min(p), max(p)) for p in near_pairs(rows)}
    met, nodes = forest_pairs(spark, rows)
    assert len(wanted) > 300 and len(wanted & met) / len(wanted) >= 0.99
    assert max(map(len, nodes)) <= 7


def test_prefixes_are_shortened_until_the_target(spark, monkeypatch):
    """A lower target leaves more of the crowded nodes out."""
    monkeypatch.setattr(J, "BLOCK", 4)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(60):
        text = list(base)
        for at in rng.sample(range(120), 2):
            text[at] = f"x{k}-{at}"
        rows.append((k, " ".join(text)))
    size = {target: sum(len(m) for m in forest_pairs(spark, rows, target)[1]) for target in (0.5, 0.99, 0.999999)}
    assert size[0.5] < size[0.99] <= size[0.999999]
    whole = J.TREES * J.missed(J.LEAST_DEPTH, J.THRESHOLD)
    assert whole < J.math.log(1 - J.TARGET_RECALL)


def test_tries_do_not_depend_on_partitions(spark):
    rows = corpus(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = []
        for parts in ("1", "9"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            found.append(forest_pairs(spark, rows)[0])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found[0] == found[1]


def test_hot_keys_are_split(spark, monkeypatch):
    from hayloft.llm import components as C

    monkeypatch.setattr(C, "HOT_ROWS", 10)
    left = spark.createDataFrame([(k, 0 if k % 3 else k) for k in range(100)], "row long, key long")
    right = spark.createDataFrame([(k, f"v{k}") for k in range(60)], "key long, value string")
    got = sorted(tuple(r) for r in C.split_join(left, right, ["key"], "row", "left").select("row", "key", "value").collect())
    assert got == sorted((k, 0 if k % 3 else k, f"v{0 if k % 3 else k}" if k % 3 or k < 60 else None) for k in range(100))
    rows = corpus(6)
    got = J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.class_id, r.n_links, r.n_shingles) for r in got.collect()} == brute(rows)


def test_components(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(1, 60)] + [(100, 101), (102, 101), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in components(spark, edges).collect()}
    assert got == {**dict.fromkeys(range(1, 61), 1), 100: 100, 101: 100, 102: 100}
