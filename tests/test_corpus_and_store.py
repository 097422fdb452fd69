import random

import pytest
from pyspark.sql import functions as F

from hayloft.operators import chunking
from hayloft.plans import sync
from hayloft.plans.snapshot import SnapshotError, Store
from hayloft.sources import corpus


def test_scan_honours_ignore_rules(spark, tmp_path):
    for name, body in {
        ".gitignore": "root_skip.txt\nlogs/*\n!logs/keep.rs\n/only_top.rs\n",
        "root_ok.rs": "a", "root_skip.txt": "b", "src/main.rs": "c", "src/logs/drop.rs": "d", "logs/keep.rs": "x", "logs/drop.rs": "y", "src/__init__.py": "z", "only_top.rs": "e", "src/only_top.rs": "f",
        "src/nested/.ggignore": "skip.txt\n", "src/nested/skip.txt": "g", "src/nested/keep+1 x.rs": "h", "node_modules/m.js": "i", ".hidden/h.rs": "j", "bin.exe": "k", "src/bad.rs": None,
    }.items():
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"\xff\xfeok" if body is None else body.encode())
    got = {r.path_key: r for r in corpus.scan(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["logs/keep.rs", "root_ok.rs", "src/__init__.py", "src/bad.rs", "src/logs/drop.rs", "src/main.rs", "src/nested/keep+1 x.rs", "src/only_top.rs"]
    assert got["src/bad.rs"].text.endswith("ok")


def test_chunks_of_files(spark):
    source = "import { x } from 'm'\nexport class A {\n  f() {}\n}\nexport function g() {\n}\n"
    rows = [("a.ts", source), ("b.py", "import os\n\ndef f():\n    return 1\n\nclass C:\n    pass\n"), ("c.md", "# T\nx\n## U\ny\n"), ("d.txt", "\n".join(map(str, range(131)))), ("e.txt", "z" * 2010), ("f.py", "def broken(:\n"), ("g.rs", ""), ("h.md", None)]
    files = spark.createDataFrame(rows, "path_key string, text string")
    got = chunking.chunk_files(files).collect()
    of = lambda p: sorted((r.start_line, r.end_line, r.chunk_type) for r in got if r.path_key == p)
    assert (1, 4, "class") in of("a.ts") and (4, 6, "function") in of("a.ts")
    assert (2, 4, "function") in of("b.py") and (5, 7, "class") in of("b.py")
    assert of("c.md") == [(0, 2, "block"), (2, 4, "block")]
    assert of("d.txt") == [(0, 75, "other"), (65, 131, "other"), (130, 131, "other")]
    assert sum(len(r.text) for r in got if r.path_key == "e.txt") == 2010
    assert of("f.py") and not of("g.rs") and not of("h.md")
    table = chunking.chunk_table(files)
    assert table.groupBy("path_key", "ordinal").count().where("count > 1").isEmpty()
    anchor = table.where("kind = 'anchor' and path_key = 'a.ts'").first()
    assert "Imports: m" in anchor.text and "Exports: A, g" in anchor.text


def test_markdown_sections_outside_fences(spark):
    body = "pre\n# A\nx\n```\n# no\n```\n### C\ny\n## B\n"
    got = chunking.markdown_sections(spark.createDataFrame([("p", body)], "path string, text string")).orderBy("start_line").collect()
    assert [(r.start_line, r.end_line, r.level) for r in got] == [(0, 1, 0), (1, 6, 1), (6, 8, 3), (8, 9, 2)]
    assert list(got[2].breadcrumbs) == ["Heading1: A", "Heading3: C"] and list(got[3].breadcrumbs) == ["Heading1: A", "Heading2: B"]


def files(spark, model):
    rows = [(p, t) for p, t in model.items()]
    return spark.createDataFrame(rows, "path_key string, text string").withColumn("hash", F.sha2("text", 256)).withColumn("size", F.length("text").cast("long"))


def served(store):
    rows = store.live().where("kind = 'text'").groupBy("path_key").agg(F.array_join(F.array_sort(F.collect_list("text")), "|").alias("t")).collect()
    return {r.path_key: r.t for r in rows}


def test_store_follows_a_model(spark, tmp_path):
    rng, model, store = random.Random(42), {}, Store(spark, f"file://{tmp_path}/store")
    for turn in range(5):
        for _ in range(rng.randint(1, 4)):
            name = f"f{rng.randint(0, 4)}.rs"
            kind = rng.choice(["set", "set", "set", "delete"])
            if kind == "delete":
                model.pop(name, None)
            else:
                model[name] = f"fn v{turn}_{rng.randint(0, 9)}() {{}}"
        model.setdefault("base.rs", "fn base() {}")
        old = store.active()
        before = served(store) if old else None
        sync.sync(store, files(spark, model))
        assert served(store) == model
        if old:
            assert {r.path_key for r in store.live(old).where("kind = 'text'").collect()} == set(before)
    again, counts = sync.sync(store, files(spark, model))
    assert counts == {} and again.snapshot_id == store.active().snapshot_id
    made = sync.compact(store)
    assert len(made.segments) == 1 and not made.tombstones and served(store) == model
    spared = sync.collect_garbage(store, newest=1, age_s=0)
    assert not any(spared.values())  # all is younger than the safety age
    gone = sync.collect_garbage(store, newest=1, age_s=0, safety_s=0)
    assert gone["segments"] and served(store) == model and sync.audit(store) == []
    copy = sync.clone(store, f"file://{tmp_path}/copy")
    assert served(copy) == model
    with pytest.raises(SnapshotError):
        sync.sync(store, files(spark, {**model, "new.rs": "fn new() {}"}), max_bytes=3)
    store.delete("active")
    assert store.active().snapshot_id == made.snapshot_id


def test_failures_leave_the_pointer(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    store = Store(spark, root)
    first, _ = sync.sync(store, files(spark, {"a.rs": "fn a() {}"}))
    for step in ("before_segment", "before_verify", "before_pointer"):
        with pytest.raises(SnapshotError):
            sync.sync(Store(spark, root, fail_at=step), files(spark, {"a.rs": f"fn b_{step}() {{}}"}))
        assert store.active().snapshot_id == first.snapshot_id
    embed = lambda rows: rows.withColumn("error", F.when(F.col("path_key") == "bad.rs", "no"))
    with pytest.raises(SnapshotError):
        sync.sync(store, files(spark, {"a.rs": "fn a() {}", "bad.rs": "fn x() {}"}), embed, strict=True)
    m, _ = sync.sync(store, files(spark, {"a.rs": "fn a() {}", "bad.rs": "fn x() {}", "c.rs": "fn c() {}"}), embed)
    assert m.degraded and set(served(store)) == {"a.rs", "c.rs"}
    m, _ = sync.sync(store, files(spark, {"a.rs": "fn a() {}", "bad.rs": "fn x() {}", "c.rs": "fn c() {}"}))
    assert not m.degraded and set(served(store)) == {"a.rs", "bad.rs", "c.rs"}
    epoch = store.acquire("one")
    with pytest.raises(SnapshotError):
        store.acquire("two")
    store.release("one", epoch)
    assert store.acquire("two") == epoch + 1
    with pytest.raises(SnapshotError):
        store.beat("one", epoch)
    with pytest.raises(SnapshotError):
        sync.collect_garbage(store)  # a writer is at work
    assert not store.write_new("{}", "lease", str(epoch + 1)) and store.holds("two", epoch + 1)
    store.release("two", epoch + 1)
    checks = {r.check: r.severity for r in sync.health(store, {"p95": 10, "off": 0}, {"p95": 20}).collect()}
    assert checks["snapshot"] == "ok" and checks["p95"] == "warn" and checks["off"] == "ok"


def test_a_sync_that_only_deletes_is_verified(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/store")
    first, _ = sync.sync(store, files(spark, {"a.rs": "fn a() {}", "b.rs": "fn b() {}"}))
    old = store.publish
    monkeypatch.setattr(store, "publish", lambda m: (store.delete("tombstones", m.tombstones[-1]["name"]), old(m))[1])
    with pytest.raises(SnapshotError, match="missing"):
        sync.sync(store, files(spark, {"a.rs": "fn a() {}"}))
    assert store.active().snapshot_id == first.snapshot_id


def test_compaction_when_due(spark, tmp_path, monkeypatch):
    from hayloft.plans import snapshot

    monkeypatch.setattr(snapshot, "COMPACT_SEGMENTS", 2)
    store = Store(spark, f"file://{tmp_path}/store")
    sync.sync_and_compact(store, files(spark, {"a.rs": "fn a() {}"}))
    m, _ = sync.sync_and_compact(store, files(spark, {"a.rs": "fn a() {}", "b.rs": "fn b() {}"}))
    assert len(m.segments) == 1 and not m.tombstones and set(served(store)) == {"a.rs", "b.rs"}


def test_imports_and_exports(spark):
    lines = [
        'import { a, b } from "mod-a"', "import x from './x.js'", "import 'side'", "import * as fs", "import os.path", "use std::io;", "  use crate ;", "const y = require( 'req' )", "let import_from = 1",
        "import {", "from 'late'", 'await import("dyn")', "use a as b;", 'import type T from "t"',
    ]
    wanted = ["a as b", "crate", "fs", "mod-a", "./x.js", "os", "req", "side", "std", "t"]
    given = [
        "export class A {", "export default function f() {}", "export default class {", "export { p, q as r }", "export const k = 1", "export async function no() {}", "module.exports = {}", "export * from 'm'",
        "export enum E {}", "exported = 1", "export default 5",
    ]
    row = spark.createDataFrame([(lines, given)], "i array<string>, e array<string>").select(chunking.imports_of(F.col("i")).alias("i"), chunking.exports_of(F.col("e")).alias("e")).first()
    assert list(row.i) == sorted(wanted)
    assert list(row.e) == sorted(["A", "f", "default", "p", "q as r", "k", "module.exports", "E"])


def test_braces_in_strings_and_comments(spark):
    text = "function f() {\n  let s = '}'; // }\n  /* } */ return `}`;\n}\nfunction g() {\n}\n"
    assert [(a, b, n) for a, b, _, n in chunking.brace_definitions(text)] == [(0, 4, "f"), (4, 6, "g")]
    body = "```\n~~~\n# no\n```\n# yes\n~~~\n```\n# no\n~~~\n# also\n"
    got = chunking.markdown_sections(spark.createDataFrame([("p", body)], "path string, text string")).where("level > 0").orderBy("start_line").collect()
    assert [(r.start_line, r.title) for r in got] == [(4, "yes"), (9, "also")] and [x[3] for x in chunking.markdown(body) if x[3]] == ["yes", "also"]


def test_files_that_are_read_or_ignored(spark):
    names = ["a.dart", "b.proto", "Makefile", "x/Dockerfile", "c.R", "d.exe", "vendor/v.rs", "out/o.rs", "p/out/o.rs", ".venv/a.py", "app.log", "Cargo.lock", "x/app.min.js", "coverage/c.js", "ok.clj"]
    files = spark.createDataFrame([(n,) for n in names], "path_key string").where(corpus.is_text_file(F.col("path_key")))
    kept = corpus.ignored(files, corpus.rule_table(spark, [])).where("not ignored")
    assert sorted(r.path_key for r in kept.collect()) == ["Makefile", "a.dart", "b.proto", "c.R", "ok.clj", "vendor/v.rs", "x/Dockerfile"]


def test_git_listing(spark, tmp_path):
    import subprocess

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / ".gitignore").write_text("out.rs\n")
    for name in ("a.rs", "b.rs", "out.rs"):
        (tmp_path / name).write_text("fn f() {}")
    git("add", "a.rs")
    listed = corpus.git_listing(spark, str(tmp_path))
    assert {r.path_key for r in listed.collect()} == {".gitignore", "a.rs", "b.rs"}
    got = corpus.scan(spark, str(tmp_path), listed_only=listed.where("path_key <> 'b.rs'"))
    assert [r.path_key for r in got.collect()] == ["a.rs"]


def test_suites(spark):
    from hayloft.operators import evaluation

    suite = """
[[case]]
id = "one"
query = "q"
expect_any_path_contains = ["a/", "zz"]
expect_all_path_regex = ["b[0-9]"]
[[case]]
id = "two"
query = "r"
mode = "debug"
expect_all_path_contains = ["c", "d"]
"""
    cases = evaluation.load_suite(spark, suite)
    hits = spark.createDataFrame([("one", 1, "x"), ("one", 2, "a/b7"), ("two", 1, "c")], "case_id string, rank int, path string")
    got = {r.case_id: r for r in evaluation.score_cases(cases, hits).collect()}
    assert got["one"].passed and got["one"].first_hit_rank == 2 and got["one"].reciprocal_rank == 0.5
    assert not got["two"].passed and list(got["two"].missing) == ["d"]
    total = evaluation.summarise(evaluation.score_cases(cases, hits)).where("mode is null").first()
    assert (total.total, total.passed, total.mrr) == (2, 1, 0.75)
    assert evaluation.gate(0.5, 0.75, (0.6, 0.76)) == ["pass_rate 0.5000 < 0.5800"]
    with pytest.raises(ValueError):
        evaluation.load_suite(spark, suite, ("three",))
