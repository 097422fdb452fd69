"""Incremental sync, compaction, clean-up, audit and health of a store."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hayloft.operators import changes, chunking
from hayloft.plans import snapshot
from hayloft.plans.snapshot import Manifest, SnapshotError, Store


def sync(store: Store, files: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None, strict: bool = False, owner: str = "sync", full: bool = True, max_bytes: int | None = None) -> tuple[Manifest | None, dict]:
    """Brings the store in line with ``files`` (path_key, hash, size, text) and publishes a snapshot.

    Only added and changed files are chunked and embedded.  ``embed`` adds
    ``embedding`` and may add ``error``: rows with an error are left out and make
    the snapshot degraded, or fail the sync if ``strict``.  With ``full=False``
    the files are a partial list and nothing is deleted.  More than ``max_bytes``
    of changed files are refused before anything is written.
    """
    epoch = store.acquire(owner)
    try:
        parent = store.active()
        stored = store.file_rows(parent)
        found = changes.detect_changes(files, stored).where(F.col("action") != "same")
        if not full:
            found = found.where(F.col("action") != "delete")
        name = f"sync_{uuid.uuid4().hex}"
        found.write.parquet(store.path("changes", name))
        found = store.spark.read.parquet(store.path("changes", name))
        counts = {r.action: r["count"] for r in found.groupBy("action").count().collect()}
        if not counts and parent is not None:
            return parent, counts
        # changed files are read once more, here; all that follows sees the same contents
        changed = files.join(found.where(F.col("action").isin("add", "modify")).select("path_key"), "path_key", "left_semi")
        changed.select("path_key", "hash", F.col("size").cast("long").alias("size"), "text").write.parquet(store.path("staging", f"{name}_files"))
        made = store.spark.read.parquet(store.path("staging", f"{name}_files"))
        store.beat(owner, epoch)
        if max_bytes is not None:
            total = made.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n
            if total > max_bytes:
                raise SnapshotError(f"{total} bytes changed, the budget is {max_bytes}")
        rows = chunking.chunk_table(made.select("path_key", "text"))
        rows = embed(rows) if embed else rows
        staged = store.path("staging", name)
        rows.write.parquet(staged)
        store.beat(owner, epoch)
        rows, errors = store.spark.read.parquet(staged), []
        if "error" in rows.columns:
            bad = rows.where(F.col("error").isNotNull()).groupBy("path_key").agg(F.min("error").alias("message"))
            # all of them go to a table; the manifest names it
            bad.write.json(store.path("errors", name))
            n_bad = store.spark.read.schema("path_key string, message string").json(store.path("errors", name)).count()
            errors = [{"name": name, "count": n_bad}] if n_bad else []
            if errors and strict:
                raise SnapshotError(f"{n_bad} files failed: {store.path('errors', name)}")
            failed = bad.select("path_key")
            rows = rows.join(failed, "path_key", "left_anti").drop("error")
        else:
            failed = store.spark.createDataFrame([], "path_key string")
        store.step("before_segment")
        rows.write.parquet(store.path("segments", name))
        n = store.spark.read.parquet(store.path("segments", name)).count()
        # deleted, replaced and emptied files hide their old rows
        dead = found.where(F.col("action").isin("delete", "modify")).join(failed, "path_key", "left_anti").select("path_key", F.when(F.col("action") == "delete", "delete").otherwise("replace").alias("reason"))
        dead.write.json(store.path("tombstones", name))
        n_dead = store.spark.read.schema("path_key string, reason string").json(store.path("tombstones", name)).count()
        written = store.spark.read.parquet(store.path("segments", name)).select("path_key").distinct().withColumn("segment", F.lit(name))
        before = store.index_rows(parent) if parent else store.spark.createDataFrame([], "path_key string, segment string")
        changes.merge_segment_index(before, dead, written).write.parquet(store.path("index", name))
        kept = stored.join(found.join(failed, "path_key", "left_anti").select("path_key"), "path_key", "left_anti")
        fresh = made.join(failed, "path_key", "left_anti").select("path_key", "hash", F.col("size").cast("long").alias("size"))
        kept.unionByName(fresh).write.parquet(store.path("files", name))
        if not store.holds(owner, epoch):
            raise SnapshotError("the lease was lost")
        m = store.new_manifest(parent, lease_epoch=epoch)
        m.segments = [*(parent.segments if parent else []), *([{"name": name, "rows": n}] if n else [])]
        m.tombstones = [*(parent.tombstones if parent else []), *([{"name": name, "count": n_dead}] if n_dead else [])]
        m.index = m.files = name
        m.degraded, m.errors = bool(errors), errors
        m = store.publish(m)
        for part in (name, f"{name}_files"):
            store.delete("staging", part)
        return m, counts
    finally:
        store.release(owner, epoch)


def compaction_due(m: Manifest) -> bool:
    return len(m.segments) >= snapshot.COMPACT_SEGMENTS or sum(x["count"] for x in m.tombstones) >= snapshot.COMPACT_TOMBSTONES


def sync_and_compact(store: Store, files: DataFrame, **more) -> tuple[Manifest | None, dict]:
    """``sync``, and a compaction if the store has come near its limits."""
    m, counts = sync(store, files, **more)
    return (compact(store), counts) if m and compaction_due(m) else (m, counts)


def compact(store: Store, owner: str = "compact", tries: int = 2) -> Manifest:
    """Rewrites the live view, files changed in place included, as one segment without tombstones; once more if the base changed."""
    try:
        return _compact(store, owner)
    except BaseChanged:
        if tries <= 1:
            raise
        return compact(store, owner, tries - 1)


class BaseChanged(SnapshotError):
    """Another snapshot was published meanwhile."""


def _compact(store: Store, owner: str) -> Manifest:
    epoch = store.acquire(owner)
    try:
        base = store.active()
        if base is None or not base.segments:
            raise SnapshotError("nothing to compact")
        name = f"compact_{uuid.uuid4().hex}"
        store.live(base).drop("segment").write.parquet(store.path("segments", name))
        rows = store.spark.read.parquet(store.path("segments", name))
        rows.select("path_key").distinct().withColumn("segment", F.lit(name)).write.parquet(store.path("index", name))
        now = store.active()
        if now is None or now.snapshot_id != base.snapshot_id:
            raise BaseChanged("the base snapshot changed")
        m = store.new_manifest(base, lease_epoch=epoch)
        m.segments, m.index, m.files = [{"name": name, "rows": rows.count()}], name, base.files
        m.degraded, m.errors = base.degraded, base.errors
        return store.publish(m)
    finally:
        store.release(owner, epoch)


def collect_garbage(store: Store, newest: int = 5, age_s: int = 600, pinned: tuple[str, ...] = (), dry_run: bool = False, now: datetime | None = None, safety_s: float = 180.0, owner: str = "garbage") -> dict[str, list[str]]:
    """Deletes snapshots beyond retention and the artifacts that no kept manifest refers to.

    Runs under the writer lease, so no sync is under way, and spares whatever was
    changed in the last ``safety_s`` seconds.
    """
    epoch = store.acquire(owner)
    try:
        manifests, active = store.manifests(), store.active()
        now = now or datetime.now(UTC)
        keep = {m.snapshot_id for m in manifests[:newest]} | set(pinned) | ({active.snapshot_id} if active else set())
        keep |= {m.snapshot_id for m in manifests if (now - datetime.fromisoformat(m.created_at)).total_seconds() <= age_s}
        kept = [m for m in manifests if m.snapshot_id in keep]
        used = {"segments": {s["name"] for m in kept for s in m.segments}, "tombstones": {x["name"] for m in kept for x in m.tombstones}, "index": {m.index for m in kept}, "files": {m.files for m in kept}}
        used |= {"errors": {e["name"] for m in kept for e in m.errors}, "manifests": {f"{m.snapshot_id}.json" for m in manifests if m.snapshot_id in keep}, "changes": set(), "staging": set()}
        gone = {kind: [n for n in store.names(kind) if n not in names and now.timestamp() - store.changed(kind, n) >= safety_s] for kind, names in used.items()}
        if not dry_run:
            store.beat(owner, epoch)
            for kind, names in gone.items():
                for n in names:
                    store.delete(kind, n)
        return gone
    finally:
        store.release(owner, epoch)


def audit(store: Store) -> list[str]:
    """Problems of the active snapshot."""
    m = store.active()
    return ["no snapshot"] if m is None else store.problems(m)


def clone(store: Store, target: str) -> Store:
    """A copy of a whole store under another folder, which must not exist."""
    jvm = store.spark.sparkContext._jvm
    conf = store.spark.sparkContext._jsc.hadoopConfiguration()
    made = Store(store.spark, target, store.fingerprint)
    if made.exists():
        raise SnapshotError(f"{target} exists")
    jvm.org.apache.hadoop.fs.FileUtil.copy(store.fs, store._path(store.root), made.fs, made._path(made.root), False, conf)
    return made


def repair_list(store: Store) -> DataFrame:
    """Paths whose current segment is missing: the ones to index again."""
    m = store.active()
    if m is None:
        return store.spark.createDataFrame([], "path_key string, segment string")
    missing = [s["name"] for s in m.segments if not store.exists("segments", s["name"])]
    return store.index_rows(m).where(F.col("segment").isin(missing))


def health(store: Store, budgets: dict[str, float] | None = None, observed: dict[str, float] | None = None) -> DataFrame:
    """check, severity (ok, warn, fail), detail; a budget of 0 is off, a missing measure or one over budget warns."""
    m = store.active()
    rows = [("snapshot", "ok" if m else "fail", m.snapshot_id if m else "none")]
    rows.append(("integrity", "fail" if m and store.problems(m) else "ok", "; ".join(store.problems(m)) if m else ""))
    rows.append(("degraded", "warn" if m and m.degraded else "ok", ""))
    rows.append(("compaction", "warn" if m and compaction_due(m) else "ok", ""))
    checks = store.spark.createDataFrame(rows, "check string, severity string, detail string")
    measured = [(name, float(budget), None if (observed or {}).get(name) is None else float(observed[name])) for name, budget in (budgets or {}).items()]
    compared = store.spark.createDataFrame(measured, "check string, budget double, value double")
    return checks.unionByName(compared.select("check", budget_severity(F.col("value"), F.col("budget")).alias("severity"), F.concat_ws(" of ", "value", "budget").alias("detail")))


def budget_severity(value: Column, budget: Column) -> Column:
    """ok or warn: a budget of 0 is off, a missing measure or one over budget warns."""
    return F.when(budget == 0, "ok").when(value.isNull() | (value > budget), "warn").otherwise("ok")


def progress_percent(processed: Column, total: Column) -> Column:
    """How far a sync is, in whole percent; 100 where there is nothing to do."""
    return F.when(total == 0, 100).otherwise(F.least(F.floor(processed * 100 / total), F.lit(100))).cast("int")
