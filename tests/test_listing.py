import os
import subprocess
import time

import pytest
from pyspark.sql import functions as F

from hayloft.sources import listing
from hayloft.streaming import watch


def put(top, **files):
    for name, body in files.items():
        path = os.path.join(top, name.replace("__", "/").replace("_dot_", "."))
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(body)


def test_listing_in_parts(spark, tmp_path):
    """All files at any number of shares, hidden ones and links out of the root aside; a repository below is listed by git."""
    top, out = f"{tmp_path}/top", f"{tmp_path}/out"
    put(top, a_dot_py="1", d__b_dot_py="22", d__e__f__c_dot_md="3", d__skip__x_dot_py="4", _dot_hidden__h_dot_py="5", _dot_gitignore="skip/\n", repo__in_dot_py="6", repo__no_dot_log_dot_py="7", repo__sub__t_dot_py="8")
    put(out, secret_dot_py="9")
    os.makedirs(f"{top}/odd %41 name:x+y")
    put(f"{top}/odd %41 name:x+y", z_dot_py="10")
    os.symlink(f"{out}/secret.py", f"{top}/out.py")
    os.symlink(out, f"{top}/outdir")
    os.symlink(f"{top}/a.py", f"{top}/alias.py")
    os.symlink(f"{top}/none.py", f"{top}/dead.py")
    os.symlink(top, f"{top}/d/loop")
    subprocess.run(["git", "init", "-q", f"{top}/repo"], check=True)
    put(f"{top}/repo", _dot_git__info__exclude="no.log.py\n")
    want = {".gitignore", "a.py", "alias.py", "d/b.py", "d/e/f/c.md", "d/skip/x.py", "repo/in.py", "repo/sub/t.py", "odd %41 name:x+y/z.py"}
    listing.register(spark)
    for folders in (1, 3, 100):
        found = spark.read.format("corpus_listing").option("folders", folders).load(top).collect()
        assert {r.path_key for r in found} == want and len(found) == len(want)
    by_address = spark.read.format("corpus_listing").load(f"file://{top}".replace("%", "%25"))
    assert {r.path_key for r in by_address.collect()} == want
    sizes = {r.path_key: r.size for r in by_address.collect()}
    assert sizes["d/b.py"] == 2 and sizes["alias.py"] == 1
    plain = spark.read.format("corpus_listing").option("repositories", False).load(top)
    assert {r.path_key for r in plain.collect()} == want | {"repo/no.log.py"}
    read = {r.path_key: bytes(r.content).decode() for r in listing.files_of(spark, top).collect()}
    assert read == {"a.py": "1", "alias.py": "1", "d/b.py": "22", "d/e/f/c.md": "3", "repo/in.py": "6", "repo/sub/t.py": "8", "odd %41 name:x+y/z.py": "10"}
    os.makedirs(f"{tmp_path}/empty")
    assert spark.read.format("corpus_listing").load(f"{tmp_path}/empty").collect() == []
    assert listing.files_of(spark, f"{tmp_path}/empty").collect() == []


def test_shares_cover_once(tmp_path):
    """Whatever the number of shares, every folder is listed once, and a third of all below one folder is split."""
    for k in range(30):
        put(f"{tmp_path}", **{f"hot__s{k}__f_dot_py": "x", f"c{k}__f_dot_py": "y"})
    tree = listing.Tree(str(tmp_path))
    for wanted in (1, 2, 31, 40, 500):
        seen = [f for s in tree.deal(wanted) for f, _ in tree.folders(s.key, s.deep)]
        assert sorted(seen) == sorted(set(seen)) and len(seen) == 62
    assert max(len(list(tree.files(s.key, s.deep))) for s in tree.deal(62)) == 1


@pytest.mark.parametrize("folders", [1, 50])
def test_stream_of_changes(spark, tmp_path, folders):
    """Runs of one checkpoint: new and changed files once, deletes of files and of whole folders, nothing lost or repeated over restarts."""
    top, seen = f"{tmp_path}/top", []
    put(top, a_dot_py="1", d__b_dot_py="2", d__e__c_dot_py="3", keep__k_dot_py="4")
    listing.register(spark)
    known = set()

    def run(fail=False):
        got = []

        def each(batch, number):
            batch = batch.persist()
            names = spark.createDataFrame([(k,) for k in sorted(known)], "path_key string")
            changes = [tuple(r) for r in listing.changes_of(batch, names).collect()]
            batch.unpersist()
            if fail:
                raise ValueError("lost")
            got.extend(changes)

        stream = spark.readStream.format("corpus_changes").option("settle_ms", 100).option("folders", folders).load(top)
        query = stream.writeStream.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).foreachBatch(each).start()
        if fail:
            with pytest.raises(Exception):
                query.awaitTermination(120)
        else:
            query.awaitTermination(120)
        for path, action in got:
            (known.add if action == "upsert" else known.discard)(path)
        seen.append(sorted(got))
        return sorted(got)

    time.sleep(0.3)
    assert run() == [("a.py", "upsert"), ("d/b.py", "upsert"), ("d/e/c.py", "upsert"), ("keep/k.py", "upsert")]
    time.sleep(0.3)
    assert run() == []
    put(top, a_dot_py="11", new__n_dot_py="5")
    os.remove(f"{top}/d/e/c.py")
    time.sleep(0.3)
    run(fail=True)
    # after the failure, before the restart: one more change comes with the repeated batch or the one after, once
    os.rename(f"{top}/keep", f"{tmp_path}/gone")
    time.sleep(0.3)
    assert sorted(run() + run()) == [("a.py", "upsert"), ("d/e/c.py", "delete"), ("keep/k.py", "delete"), ("new/n.py", "upsert")]
    assert known == {"a.py", "d/b.py", "new/n.py"}


def test_reconcile_timers(spark, tmp_path):
    """A clock by data: full after 300 s, idle after 120 s without events, held while work is pending."""
    steps = [
        [("r", "tick", 0), ("busy", "change", 0)],
        [("r", "tick", 100)],
        [("r", "tick", 200)],
        [("r", "tick", 290)],
        [("other", "tick", 301)],
        [("other", "tick", 500)],
        [("busy", "synced", 560)],
        [("other", "tick", 570)],
        [("other", "tick", 571)],
        [("other", "tick", 800)],
    ]
    schema = "root string, event string, s long"
    for k, rows in enumerate(steps):
        spark.createDataFrame(rows, schema).select("root", "event", F.timestamp_seconds(F.col("s") + 1000).alias("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
        newest = max((os.path.join(f"{tmp_path}/e", f) for f in os.listdir(f"{tmp_path}/e") if f.endswith(".parquet") and f.startswith("part")), key=os.path.getmtime)
        os.utime(newest, (1_700_000_000 + k, 1_700_000_000 + k))
        os.rename(newest, f"{tmp_path}/e/step{k:02d}.parquet")
    stream = spark.readStream.schema("root string, event string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/e")
    got = []
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        due = watch.reconciles(stream, processing_time=False)
        query = due.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True)
        query.foreachBatch(lambda df, n: got.extend((r.root, r.due_ms // 1000 - 1000, r.reason) for r in df.collect())).start().awaitTermination(180)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    of = lambda root: [x[1:] for x in got if x[0] == root]
    # r: events up to 290 hold the idle clock, so the full one comes first; then quiet
    assert of("r")[:2] == [(300, "full"), (420, "idle")]
    # busy: pending from 0 to 560, so nothing before
    assert of("busy") and all(at >= 560 for at, _ in of("busy"))
