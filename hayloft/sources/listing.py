"""Listings of a corpus as Spark data sources: what is there, and what changes.

    spark.dataSource.register(CorpusListing)
    spark.read.format("corpus_listing").load(root)
    spark.readStream.format("corpus_listing").load(root)

The driver sees folders only, and of these no more than it takes to have enough to deal
out; names of files are listed in tasks.  Options: ``folders`` (how many are dealt out,
256), ``hidden`` (false), ``repositories`` (true: a repository below the root is listed by git,
and by a walk where git fails), ``settle_ms`` (2000, streams).  Roots are paths or
addresses that Arrow reads; links and repositories exist on local paths only.
"""

from __future__ import annotations

import os
import subprocess
import time
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from hayloft.sources import corpus

LISTED = pa.schema([("path_key", pa.string()), ("address", pa.string()), ("size", pa.int64()), ("mtime", pa.timestamp("us", "UTC"))])
CHANGED = pa.schema([("path_key", pa.string()), ("action", pa.string()), ("size", pa.int64()), ("ts", pa.timestamp("us", "UTC"))])
SCHEMAS = {LISTED: "path_key string, address string, size long, mtime timestamp", CHANGED: "path_key string, action string, size long, ts timestamp"}
BATCH_ROWS = 4096


class Entry(NamedTuple):
    """A name in a folder; times in microseconds.  ``changed`` is also moved by a rename, where the file system says so."""

    name: str
    folder: bool
    size: int
    mtime: int
    changed: int


@dataclass(frozen=True)
class Tree:
    """A root and how its folders are listed; small, sent to tasks."""

    root: str
    hidden: bool = False
    repositories: bool = True

    @property
    def local(self) -> str | None:
        """The root as a path of this file system, or None."""
        if "://" not in self.root and not self.root.startswith("file:"):
            return os.path.abspath(self.root)
        parts = urlparse(self.root)
        return unquote(parts.path).rstrip("/") or "/" if parts.scheme == "file" else None

    def address(self, key: str) -> str:
        top = self.local or self.root.rstrip("/")
        return f"{top}/{key}" if key else top

    def entries(self, key: str) -> list[Entry]:
        """What stands in one folder, by name; nothing if the folder is gone.  Links out of the root, links to folders and dead links are left out."""
        out = []
        if self.local is None:
            from pyarrow import fs

            system, top = fs.FileSystem.from_uri(self.address(key))
            for info in system.get_file_info(fs.FileSelector(top, allow_not_found=True)):
                time_us = (info.mtime_ns or 0) // 1000
                out.append(Entry(info.base_name, info.type == fs.FileType.Directory, info.size or 0, time_us, time_us))
        else:
            inside = os.path.realpath(self.local).rstrip("/") + "/"
            try:
                with os.scandir(self.address(key)) as found:
                    for e in found:
                        try:
                            link, folder = e.is_symlink(), e.is_dir()
                            if link and (folder or not os.path.realpath(e.path).startswith(inside)):
                                continue
                            s = e.stat()
                            # a link counts as changed when it is set to another target, too
                            changed = max(s.st_mtime_ns, s.st_ctime_ns, e.stat(follow_symlinks=False).st_ctime_ns)
                        except OSError:
                            continue  # gone since it was listed, or a dead link
                        if folder or os.path.isfile(e.path):
                            out.append(Entry(e.name, folder, s.st_size, s.st_mtime_ns // 1000, changed // 1000))
            except (FileNotFoundError, NotADirectoryError):
                return []
        return sorted(e for e in out if self.hidden or not e.name.startswith(".") or e.name in corpus.IGNORE_FILES)

    def is_repository(self, key: str) -> bool:
        """Whether a folder below the root is a repository of its own."""
        return bool(key) and self.repositories and self.local is not None and os.path.exists(f"{self.address(key)}/.git")

    def of_repository(self, key: str) -> Iterator[tuple[str, Entry]] | None:
        """Files of a repository that git tracks or does not ignore; None where git fails."""
        top = self.address(key)
        try:
            said = subprocess.run(["git", "-C", top, "ls-files", "-z", "--cached", "--others", "--exclude-standard"], capture_output=True, check=True).stdout
        except (OSError, subprocess.CalledProcessError):
            return None
        names: dict[str, set[str]] = {}
        for name in said.decode("utf-8", "replace").split("\0"):
            folder, _, last = name.rpartition("/")
            if last:
                names.setdefault(folder, set()).add(last)
        return ((_below(key, folder), e) for folder in sorted(names) for e in self.entries(_below(key, folder)) if not e.folder and e.name in names[folder])

    def files(self, key: str, deep: bool) -> Iterator[tuple[str, Entry]]:
        """(folder, file) in one folder, or in all below it too."""
        todo = [key]
        while todo:
            folder = todo.pop()
            tracked = self.of_repository(folder) if self.is_repository(folder) else None
            if tracked is not None:
                yield from tracked
                continue
            for e in self.entries(folder):
                if not e.folder:
                    yield folder, e
                elif deep:
                    todo.append(_below(folder, e.name))

    def folders(self, key: str, deep: bool) -> Iterator[tuple[str, list[Entry]]]:
        """(folder, its entries) of one folder, or of all below it too; repositories are walked like other folders."""
        todo = [key]
        while todo:
            folder = todo.pop()
            held = self.entries(folder)
            yield folder, held
            if deep:
                todo += [_below(folder, e.name) for e in held if e.folder]

    def deal(self, wanted: int) -> list[Share]:
        """At least ``wanted`` folders if there are as many, widest first: opened ones with their own files, the others with all below them."""
        todo, opened = deque([""]), []
        while todo and len(todo) + len(opened) < wanted:
            key = todo.popleft()
            if self.is_repository(key):
                opened.append(Share(key, True))
                continue
            opened.append(Share(key, False))
            todo += [_below(key, e.name) for e in self.entries(key) if e.folder]
        return opened + [Share(key, True) for key in todo]


def _below(folder: str, name: str) -> str:
    return f"{folder}/{name}" if folder and name else folder or name


class Share(InputPartition):
    """A folder to list; ``deep``: with all below it.  For streams with the times between which changes count."""

    def __init__(self, key: str, deep: bool, after: int = -1, until: int = -1):
        super().__init__(key)
        self.key, self.deep, self.after, self.until = key, deep, after, until


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


class _Listing(DataSourceReader):
    def __init__(self, tree: Tree, wanted: int):
        self.tree, self.wanted = tree, wanted

    def partitions(self):
        return self.tree.deal(self.wanted)

    def read(self, partition):
        rows = ((_below(folder, e.name), self.tree.address(_below(folder, e.name)), e.size, e.mtime) for folder, e in self.tree.files(partition.key, partition.deep))
        return _batches(rows, LISTED)


class _Changes(DataSourceStreamReader):
    """Files and folders by the time of their change.  An offset is a time, so the checkpoint holds no listing.

    A batch takes the changes after its first and up to its second time; what changes
    again before it is read has a later time and comes with a later batch.
    """

    def __init__(self, tree: Tree, wanted: int, settle_ms: int):
        self.tree, self.wanted, self.settle_ms = tree, wanted, settle_ms
        self._last = -1

    def initialOffset(self):  # noqa: N802
        return {"us": -1}

    def latestOffset(self):  # noqa: N802
        self._last = max(self._last, time.time_ns() // 1000 - 1000 * self.settle_ms)
        return {"us": self._last}

    def partitions(self, start, end):
        self._last = max(self._last, end["us"])
        return [Share(s.key, s.deep, start["us"], end["us"]) for s in self.tree.deal(self.wanted)]

    def read(self, partition):
        return _batches(self._rows(partition), CHANGED)

    def _rows(self, share: Share) -> Iterator[tuple]:
        new = lambda us: share.after < us <= share.until
        for folder, held in self.tree.folders(share.key, share.deep):
            for e in held:
                if not e.folder and new(e.changed):
                    yield _below(folder, e.name), "upsert", e.size, e.changed
            changed = self._changed(folder)
            if changed is not None and new(changed):
                yield folder, "folder", len(held), changed
                for e in held:
                    yield _below(folder, e.name), "entry", e.size, changed

    def _changed(self, folder: str) -> int | None:
        """When names in a folder last came or went; None where the file system does not say."""
        if self.tree.local is None:
            return None
        try:
            return os.stat(self.tree.address(folder)).st_mtime_ns // 1000
        except OSError:
            return None

    def commit(self, end):
        pass

    def stop(self):
        pass


class CorpusListing(DataSource):
    """Batch: path_key, address, size, mtime of files.  Stream: path_key, action, size, ts.

    Actions: ``upsert`` (a file is new or changed), ``folder`` (names came or went
    in it) and ``entry`` (a name that is in such a folder).  ``changes_of`` turns them
    into upserts and deletes.
    """

    @classmethod
    def name(cls):
        return "corpus_listing"

    def _tree(self) -> Tree:
        said = lambda name, default: str(self.options.get(name, default)).lower() == "true"
        return Tree(self.options["path"].rstrip("/") or "/", said("hidden", "false"), said("repositories", "true"))

    def schema(self):
        return SCHEMAS[LISTED]

    def reader(self, schema):
        return _Listing(self._tree(), int(self.options.get("folders", 256)))

    def streamReader(self, schema):  # noqa: N802
        return _Changes(self._tree(), int(self.options.get("folders", 256)), int(self.options.get("settle_ms", 2000)))


class CorpusChanges(CorpusListing):
    """The stream of ``CorpusListing`` under a name of its own, as a source has one schema."""

    @classmethod
    def name(cls):
        return "corpus_changes"

    def schema(self):
        return SCHEMAS[CHANGED]


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CorpusListing)
    spark.dataSource.register(CorpusChanges)


def files_of(spark: SparkSession, root: str, endings: tuple[str, ...] = corpus.TEXT_ENDINGS, max_bytes: int = corpus.MAX_FILE_BYTES, hidden: bool = False, repositories: bool = True) -> DataFrame:
    """path_key, size, mtime, content of the files that are read: listed, ignored and read in tasks.

    Each file is read whole between two equal looks at its size and time; content is null
    where it kept changing, and of files that went meanwhile.  Only the texts of ignore files reach the driver.
    """
    register(spark)
    listed = spark.read.format("corpus_listing").option("hidden", hidden).option("repositories", repositories).load(root)
    named = F.element_at(F.split("path_key", "/"), -1).isin(*corpus.IGNORE_FILES)
    rules = corpus.read_stable(listed.where(named).select(F.col("address").alias("path"), "path_key"), max_bytes).select("path_key", "content").collect()
    table = corpus.rule_table(spark, [(r.path_key.rpartition("/")[0], bytes(r.content).decode("utf-8", "replace")) for r in rules if r.content is not None])
    kept = listed.where((F.col("size") <= max_bytes) & corpus.is_text_file(F.col("path_key"), endings))
    if not hidden:
        kept = kept.where(~F.col("path_key").rlike(r"(^|/)\."))
    kept = corpus.ignored(kept, table).where(~F.col("ignored"))
    return corpus.read_stable(kept.select(F.col("address").alias("path"), "path_key"), max_bytes)


def changes_of(batch: DataFrame, known: DataFrame) -> DataFrame:
    """path_key, action (upsert, delete) from rows of the stream and the paths (path_key) that are known.

    A known path goes when a folder above it has changed and no longer holds the
    part of the path that follows, so a folder that went takes all below it along.
    """
    upserts = batch.where(F.col("action") == "upsert").select("path_key").distinct()
    folders = batch.where(F.col("action") == "folder").select(F.col("path_key").alias("_folder")).distinct()
    entries = batch.where(F.col("action") == "entry").select(F.col("path_key").alias("_child")).distinct()
    parts = F.split("path_key", "/")
    at = known.select("path_key", F.explode(F.sequence(F.lit(0), F.size(parts) - 1)).alias("_k"))
    above = at.select("path_key", F.array_join(F.slice(parts, F.lit(1), F.col("_k")), "/").alias("_folder"), F.array_join(F.slice(parts, F.lit(1), F.col("_k") + 1), "/").alias("_child"))
    gone = above.join(folders, "_folder", "left_semi").join(entries, "_child", "left_anti").select("path_key").distinct()
    gone = gone.join(upserts, "path_key", "left_anti")
    return upserts.withColumn("action", F.lit("upsert")).unionByName(gone.withColumn("action", F.lit("delete")))
