"""Snapshots over immutable Parquet segments.

A store is a folder with ``segments/``, ``tombstones/``, ``manifests/`` and a
pointer.  A sync writes a segment with Spark, then a manifest, then swaps the
pointer; readers resolve the pointer once and see one manifest.  Manifests,
pointer and lease are a few small files, written by the driver through the
Hadoop file system, so a store can lie wherever Spark can write.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hayloft.operators import changes

VERSION = 1
MAX_SEGMENTS, MAX_TOMBSTONES = 64, 250_000
COMPACT_SEGMENTS, COMPACT_TOMBSTONES = 48, 200_000


class SnapshotError(Exception):
    """A store that can't be read or published."""


@dataclass
class Manifest:
    snapshot_id: str
    parent: str | None
    created_at: str
    fingerprint: str
    lease_epoch: int = 0
    version: int = VERSION
    segments: list[dict] = field(default_factory=list)  # name, rows
    tombstones: list[dict] = field(default_factory=list)  # name, count
    index: str | None = None  # path_key to segment
    files: str | None = None  # file metadata
    degraded: bool = False
    errors: list[dict] = field(default_factory=list)


class Store:
    """Files of one store; ``fail_at`` lets tests stop at a named step."""

    def __init__(self, spark: SparkSession, root: str, fingerprint: str = "", fail_at: str | None = None):
        self.spark, self.root, self.fingerprint, self.fail_at = spark, root.rstrip("/"), fingerprint, fail_at
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def step(self, name: str) -> None:
        if self.fail_at == name:
            raise SnapshotError(f"stopped at {name}")

    def path(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def exists(self, *parts: str) -> bool:
        return self.fs.exists(self._path(self.path(*parts)))

    def names(self, *parts: str) -> list[str]:
        where = self._path(self.path(*parts))
        return sorted(s.getPath().getName() for s in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def delete(self, *parts: str) -> None:
        self.fs.delete(self._path(self.path(*parts)), True)

    def read_text(self, *parts: str) -> str:
        stream = self.fs.open(self._path(self.path(*parts)))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_text(self, text: str, *parts: str) -> None:
        """Writes beside the target, then renames over it in one step: readers see the old text or the new."""
        target = self.path(*parts)
        side = f"{target}.{uuid.uuid4().hex}"
        stream = self.fs.create(self._path(side))
        stream.write(bytearray(text.encode()))
        stream.close()
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        over = gateway.new_array(kind, 1)
        over[0] = kind.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(target).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(self._path(side), self._path(target), over)

    def write_new(self, text: str, *parts: str) -> bool:
        """Writes a file that must not exist yet; False if it does."""
        try:
            stream = self.fs.create(self._path(self.path(*parts)), False)
        except Py4JJavaError:
            if self.exists(*parts):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def changed(self, *parts: str) -> float:
        """When a file or folder was last changed, in seconds."""
        return self.fs.getFileStatus(self._path(self.path(*parts))).getModificationTime() / 1000

    # manifests and pointer

    def manifest(self, snapshot_id: str) -> Manifest:
        made = Manifest(**json.loads(self.read_text("manifests", f"{snapshot_id}.json")))
        if made.version != VERSION:
            raise SnapshotError(f"manifest version {made.version}")
        return made

    def manifests(self) -> list[Manifest]:
        """All readable manifests, newest first."""
        out = []
        for name in self.names("manifests"):
            if name.endswith(".json"):
                try:
                    out.append(self.manifest(name.removesuffix(".json")))
                except (SnapshotError, ValueError, TypeError):
                    continue
        return sorted(out, key=lambda m: (m.created_at, m.snapshot_id), reverse=True)

    def active(self) -> Manifest | None:
        """The pointer's manifest, or the newest one that verifies if the pointer is missing or broken."""
        if self.exists("active"):
            try:
                return self.manifest(self.read_text("active").strip())
            except Exception:  # noqa: BLE001  any unreadable pointer or manifest leads to the search below
                pass
        return next((m for m in self.manifests() if not self.problems(m)), None)

    def problems(self, m: Manifest) -> list[str]:
        """Why a manifest can't be served; empty if it can."""
        out = []
        if m.fingerprint != self.fingerprint:
            out.append("fingerprint differs")
        if len(m.segments) > MAX_SEGMENTS:
            out.append(f"{len(m.segments)} segments")
        if sum(x["count"] for x in m.tombstones) > MAX_TOMBSTONES:
            out.append("too many tombstones")
        out += [f"segment {s['name']} is missing" for s in m.segments if not self.exists("segments", s["name"])]
        out += [f"tombstones {x['name']} are missing" for x in m.tombstones if not self.exists("tombstones", x["name"])]
        out += [f"{kind} {name} is missing" for kind, name in (("index", m.index), ("files", m.files)) if name and not self.exists(kind, name)]
        if not out and m.segments:
            rows = {r.segment: r.n for r in self.segments(m).groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()}
            out += [f"segment {s['name']} has {rows.get(s['name'], 0)} rows, not {s['rows']}" for s in m.segments if rows.get(s["name"], 0) != s["rows"]]
        if not out and m.tombstones:
            n, wanted = self.tombstone_rows(m).count(), sum(x["count"] for x in m.tombstones)
            out += [f"{n} tombstones, not {wanted}"] if n != wanted else []
        return out

    def publish(self, m: Manifest) -> Manifest:
        self.step("before_verify")
        if why := self.problems(m):
            raise SnapshotError("; ".join(why))
        self.write_text(json.dumps(asdict(m), indent=1, sort_keys=True), "manifests", f"{m.snapshot_id}.json")
        self.step("before_pointer")
        self.write_text(m.snapshot_id, "active")
        return m

    def new_manifest(self, parent: Manifest | None, **more) -> Manifest:
        return Manifest(uuid.uuid4().hex, parent.snapshot_id if parent else None, datetime.now(UTC).isoformat(timespec="microseconds"), self.fingerprint, **more)

    # tables

    def segments(self, m: Manifest) -> DataFrame:
        """All rows of a manifest's segments, with ``segment``."""
        if not m.segments:
            raise SnapshotError("no segments")
        return changes.union_segments([self.spark.read.parquet(self.path("segments", s["name"])).withColumn("segment", F.lit(s["name"])) for s in m.segments])

    def tombstone_rows(self, m: Manifest) -> DataFrame:
        schema = "path_key string, reason string"
        names = [self.path("tombstones", x["name"]) for x in m.tombstones]
        return self.spark.read.schema(schema).option("mode", "FAILFAST").json(names) if names else self.spark.createDataFrame([], schema)

    def index_rows(self, m: Manifest) -> DataFrame:
        schema = "path_key string, segment string"
        return self.spark.read.schema(schema).parquet(self.path("index", m.index)) if m.index else self.spark.createDataFrame([], schema)

    def file_rows(self, m: Manifest | None) -> DataFrame:
        schema = "path_key string, hash string, size long"
        return self.spark.read.schema(schema).parquet(self.path("files", m.files)) if m and m.files else self.spark.createDataFrame([], schema)

    def live(self, m: Manifest | None = None) -> DataFrame:
        """What a query sees: the one way to read a store."""
        m = m or self.active()
        if m is None:
            raise SnapshotError("no snapshot")
        return changes.visible(self.segments(m), self.tombstone_rows(m), self.index_rows(m))

    # lease: one file per epoch, each made by whoever comes first

    def _lease(self) -> tuple[int, dict]:
        """The newest epoch and its holder; 0 and nobody before the first."""
        epochs = [int(n) for n in self.names("lease") if n.isdigit()]
        if not epochs:
            return 0, {"owner": "", "beat": 0, "ttl": 0}
        return max(epochs), json.loads(self.read_text("lease", str(max(epochs))) or "{}") or {"owner": "", "beat": self.changed("lease", str(max(epochs))), "ttl": 60}

    def acquire(self, owner: str, ttl_s: float = 60.0) -> int:
        """Takes the writer lease and returns its epoch; a live lease of another owner is refused, a stale one taken over.

        The next epoch's file is made only where there is none, so of two takers one is refused.
        """
        now, (epoch, held) = time.time(), self._lease()
        if held["owner"] != owner and now - held["beat"] <= held["ttl"]:
            raise SnapshotError(f"lease held by {held['owner']}")
        if not self.write_new(json.dumps({"owner": owner, "beat": now, "ttl": ttl_s}), "lease", str(epoch + 1)):
            raise SnapshotError("another writer took the lease")
        for old in range(max(1, epoch - 3), epoch):
            self.delete("lease", str(old))
        return epoch + 1

    def holds(self, owner: str, epoch: int) -> bool:
        newest, held = self._lease()
        return newest == epoch and held["owner"] == owner

    def beat(self, owner: str, epoch: int, ttl_s: float = 60.0) -> None:
        """Keeps the lease alive; an error if it was lost."""
        if not self.holds(owner, epoch):
            raise SnapshotError("the lease was lost")
        self.write_text(json.dumps({"owner": owner, "beat": time.time(), "ttl": ttl_s}), "lease", str(epoch))

    def release(self, owner: str, epoch: int) -> None:
        """The file stays, as it remembers the epoch."""
        if self.holds(owner, epoch):
            self.write_text(json.dumps({"owner": "", "beat": 0, "ttl": 0}), "lease", str(epoch))
