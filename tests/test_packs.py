import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from hayloft.operators import graph, packs

CANDIDATE = T.StructType(
    [
        T.StructField("query_id", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("start_line", T.LongType()),
        T.StructField("row_id", T.LongType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("size", T.IntegerType()),
        T.StructField("aspects", T.MapType(T.StringType(), T.IntegerType())),
    ]
)


def plain_greedy(rows, budget):
    """Every step looks at every row that fits."""
    chosen, covered, held, left = [], set(), {}, budget.total_bytes
    while True:
        fits = [k for k in range(len(rows)) if k not in [c for c, _ in chosen] and not packs.limits_of(rows[k][4], rows[k][1], left, held, budget)]
        if not fits:
            return chosen
        gain = lambda k: sum(w for a, w in rows[k][5].items() if a not in covered)  # noqa: B023, E731
        best = min(fits, key=lambda k: (-gain(k), -rows[k][0], *rows[k][1:4]))
        chosen.append((best, gain(best)))
        covered |= set(rows[best][5])
        held[rows[best][1]] = held.get(rows[best][1], 0) + 1
        left -= rows[best][4]


def random_rows(rng, n):
    words = "abcdefghij"
    return [(rng.randint(0, 3) / 2, rng.choice("xyz") + str(rng.randint(0, 3)), rng.randint(0, 4), k, rng.randint(0, 40), {w: rng.randint(1, 3) for w in rng.sample(words, rng.randint(0, 4))}) for k in range(n)]


def test_lazy_is_plain_greedy():
    rng = random.Random(5)
    for _ in range(300):
        rows = random_rows(rng, rng.randint(0, 25))
        budget = packs.Budget(rng.randint(0, 200), rng.randint(1, 5), rng.randint(1, 3))
        chosen, limits = packs.greedy_cover(rows, budget)
        assert chosen == plain_greedy(rows, budget)
        assert (len(chosen) == len(rows)) == (not limits)


def test_packs_of_queries(spark):
    """Nulls, a query of which nothing fits, files of a session, order of files and pieces."""
    rows = [
        (1, "b", 9, 1, 0.9, 10, {"u": 1, "v": 1}),
        (1, "b", 2, 2, 0.5, 10, {"w": 5}),
        (1, "a", 0, 3, 0.9, 10, {"u": 1}),
        (1, "c", 0, 4, 0.7, 10, None),
        (1, None, 0, 5, 0.7, 10, {"x": 9}),
        (1, "d", 0, 6, None, 10, {"x": 9}),
        (2, "a", 0, 7, 0.9, 999, {"u": 1}),
        (None, "a", 0, 8, 0.9, 1, {"u": 1}),
    ]
    made = spark.createDataFrame(rows, CANDIDATE)
    found = packs.covering_packs(made, packs.Budget(total_bytes=35, files=2, per_file=2))
    got = [tuple(r) for r in found.orderBy("file_rank", "ordinal").select("path", "row_id", "step", "gain", "reason", "file_rank", "ordinal", "limits_hit").collect()]
    assert got == [("a", 3, 3, 0, "semantic_match", 1, 1, ["max_files", "max_total_bytes"]), ("b", 2, 1, 5, "coverage", 2, 1, ["max_files", "max_total_bytes"]), ("b", 1, 2, 2, "coverage", 2, 2, ["max_files", "max_total_bytes"])]
    seen = spark.createDataFrame([(1, "b"), (1, "b")], "query_id long, path string")
    later = packs.covering_packs(made, packs.Budget(total_bytes=35, files=2, per_file=2), seen)
    assert sorted(r.path for r in later.collect()) == ["a", "c"]
    assert packs.covering_packs(made.limit(0)).collect() == []
    digest = packs.seen_digest(seen.unionByName(spark.createDataFrame([(1, "a")], seen.schema))).collect()
    import hashlib

    assert [d.seen_set_digest for d in digest] == [hashlib.sha256(b"a\nb").hexdigest()]
    sure = {r.query_id: (r.separation, r.low_confidence) for r in packs.confidence(spark.createDataFrame([(1, "a", k, s) for k, s in enumerate((9.0, 1.0, 1.0, 1.0))] + [(2, "a", 0, 3.0)], "query_id long, path string, row_id long, score double")).collect()}
    assert sure == {1: (1.7321, False), 2: (0.0, True)}


def breadth_first(edges, seeds, hops, direction):
    out, back = {}, {}
    for path, kind, name in edges:
        (out if kind == "imports" else back).setdefault(name, set()).add(path)
    near = {}
    for name in out.keys() & back.keys():
        for a in out[name]:
            for b in back[name]:
                if direction in ("imports", "both"):
                    near.setdefault(a, set()).add(b)
                if direction in ("importers", "both"):
                    near.setdefault(b, set()).add(a)
    best = {s: (0, s) for s in seeds}
    front = dict(best)
    for hop in range(1, hops + 1):
        found = {}
        for a, (_, root) in front.items():
            for b in near.get(a, ()):
                if b not in best:
                    found[b] = min(found.get(b, (hop, root)), (hop, root))
        best |= found
        front = found
    return {(p, h, r) for p, (h, r) in best.items()}


def test_reach_is_breadth_first(spark):
    """Hubs dealt to many parts, both as names and as files; cycles, seeds without edges, nulls, repeated rows."""
    rng = random.Random(7)
    edges = [(f"f{rng.randint(0, 120)}", rng.choice(("imports", "exports")), f"n{rng.randint(0, 150)}") for _ in range(220)]
    edges += [(f"f{k}", "imports", "hub") for k in range(60)] + [("f200", "exports", "hub")] + [("f201", "imports", f"n{k}") for k in range(50)]
    made = spark.createDataFrame([*edges, *edges[:9], (None, "imports", "hub"), ("f1", "exports", None)], "path string, kind string, name string")
    seeds = ["f3", "f90", "alone"]
    start = spark.createDataFrame([(s,) for s in [*seeds, "f3", None]], "path string")
    for direction in ("imports", "importers", "both"):
        got = {tuple(r) for r in graph.reach(made, start, 3, direction, hub=8).collect()}
        assert got == breadth_first(edges, seeds, 3, direction)


def test_hubs_are_dealt(spark):
    """A name of a third of all rows is spread over parts of about ``hub`` edges."""
    rows = spark.range(30_000).select(F.concat(F.lit("f"), "id").alias("path"), F.lit("imports").alias("kind"), F.when(F.col("id") % 3 == 0, "hub").otherwise(F.concat(F.lit("n"), "id")).alias("name"))
    dealt = graph._dealt(rows, ["kind", "name"], "path", "name", 1000)
    sizes = [r["count"] for r in dealt.where("name = 'hub'").groupBy("name_part").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 1300 and sum(sizes) == 10_000


def test_edges_and_graph_of_a_pack(spark):
    files = [("a.ts", 'import { x } from "m"\nimport { x } from "m"\nexport const k = 1'), ("b.ts", 'import { k } from "k"\nexport const m = 1\nexport const k = 2'), ("c.ts", None), (None, "import 'm'"), ("d.ts", "")]
    edges = graph.edges_of(spark.createDataFrame(files, "path string, text string"))
    assert {tuple(r) for r in edges.collect()} == {("a.ts", "imports", "m"), ("a.ts", "exports", "k"), ("b.ts", "imports", "k"), ("b.ts", "exports", "m"), ("b.ts", "exports", "k")}
    nodes = spark.createDataFrame([(1, "a.ts"), (1, "b.ts"), (1, "b.ts"), (2, "a.ts")], "query_id long, path string")
    got = {tuple(r)[:4] for r in graph.pack_graph(nodes, edges).collect()}
    assert got == {(1, "a.ts", "b.ts", "m"), (1, "b.ts", "a.ts", "k")}
    one = graph.pack_graph(nodes, edges, 1).collect()
    assert [(r.source, r.limits_hit) for r in one] == [("a.ts", ["max_edges"])]
