"""Corpus scan: files below a folder, by Spark's binary reader and hierarchical ignore rules."""

from __future__ import annotations

import os
import re
import time
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hayloft.functions import identity, paths
from hayloft.operators.changes import case_collisions
from hayloft.sources.ignore import ignored

MAX_FILE_BYTES = 10 << 20
# fixed values: names of ignore files, later ones over earlier ones in a folder
IGNORE_FILES = (".gitignore", ".ggignore", ".smignore")
# fixed values: endings and names of files that are read; parameters of ``scan``
TEXT_ENDINGS = (
    "bash", "bzl", "c", "c++", "cc", "cjs", "clj", "cljc", "cljs", "cmake", "cpp", "cr", "cs", "css", "cts", "cxx", "dart", "diff", "dockerfile", "edn", "el", "env", "ex", "exs",
    "f03", "f08", "f90", "f95", "gitignore", "go", "gql", "gradle", "graphql", "h", "h++", "hcl", "hpp", "hs", "htm", "html", "hxx", "java", "jl", "js", "json", "jsx", "kt", "kts",
    "lhs", "lua", "m", "makefile", "markdown", "md", "mermaid", "mjs", "mk", "ml", "mli", "mm", "mmd", "mts", "nim", "odin", "patch", "php", "proto", "py", "pyi", "r", "rb", "rs",
    "sc", "scala", "sh", "sql", "star", "sv", "svelte", "svh", "swift", "tf", "tfvars", "toml", "ts", "tsx", "txt", "v", "vue", "xml", "xsd", "xsl", "xslt", "yaml", "yml", "zig", "zsh",
)
TEXT_NAMES = ("dockerfile", "makefile")
# fixed values: patterns that are ignored unless told otherwise
DEFAULT_IGNORES = (
    "**/Datasets/**", "**/node_modules/**", "**/dist/**", "**/build/**", "**/out/**", "**/target/**", "**/__pycache__/**", "**/.git/**", "**/.venv/**", "**/venv/**",
    "*.lock", "*.bin", "*.ipynb", "*.pyc", "*.onnx", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "composer.lock", "Cargo.lock", "Gemfile.lock",
    "*.min.js", "*.min.css", "*.map", "**/coverage/**", "**/.nyc_output/**", "**/.pytest_cache/**",
)

RULE = T.StructType(
    [
        T.StructField("rule_order", T.IntegerType()),
        T.StructField("base_dir", T.StringType()),
        T.StructField("pattern", T.StringType()),
        T.StructField("negated", T.BooleanType()),
        T.StructField("dir_only", T.BooleanType()),
        T.StructField("regex", T.StringType()),
    ]
)


def glob_regex(pattern: str, base_dir: str = "") -> str:
    """A regular expression for one ignore pattern below ``base_dir``, over whole relative paths."""
    anchored = "/" in pattern.rstrip("/")
    body = pattern.strip("/")
    out, k = "", 0
    while k < len(body):
        if body.startswith("**/", k):
            out, k = out + "(?:[^/]+/)*", k + 3
        elif body.startswith("/**", k) and k + 3 == len(body):
            out, k = out + "/.+", k + 3
        elif body.startswith("**", k):
            out, k = out + ".*", k + 2
        elif body[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif body[k] == "?":
            out, k = out + "[^/]", k + 1
        elif body[k] == "[" and "]" in body[k + 2 :]:
            end = body.index("]", k + 2)
            inner = body[k + 1 : end].replace("\\", "\\\\")
            out, k = out + "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]", end + 1
        else:
            out, k = out + re.escape(body[k]), k + 1
    prefix = re.escape(base_dir.strip("/")) + "/" if base_dir.strip("/") else ""
    return "^" + prefix + ("" if anchored else "(?:[^/]+/)*") + out + "$"


def parse_rules(text: str, base_dir: str = "", first: int = 0) -> list[tuple]:
    """Rules of one ignore file, in order; blank lines and comments are none."""
    out = []
    for line in text.split("\n"):
        line = line.rstrip("\r").rstrip()
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        body = line[1:] if negated else line.removeprefix("\\")
        if body.strip("/"):
            out.append((first + len(out), base_dir, body, negated, body.endswith("/"), glob_regex(body, base_dir)))
    return out


def rule_table(spark: SparkSession, listed: list[tuple[str, str]], defaults: tuple[str, ...] = DEFAULT_IGNORES) -> DataFrame:
    """Rules of the defaults and of ignore files given as (folder, text), outer folders first."""
    rows = parse_rules("\n".join(defaults))
    for base, text in sorted(listed, key=lambda x: (x[0].count("/") if x[0] else -1, x[0])):
        rows += parse_rules(text, base, len(rows))
    return spark.createDataFrame(rows, RULE)


def unlisted(spark: SparkSession, root: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, str]]]:
    """What Spark's file listing leaves out: address, time (ms) and size of files whose name starts with ``_``, and (path, text) of ignore files.

    One walk over the names on the driver; contents are read of ignore files only.
    """
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, rules = [], []
    walk = fs.listFiles(top, True)
    while walk.hasNext():
        status = walk.next()
        path = status.getPath()
        name = path.getName()
        if name in IGNORE_FILES:
            stream = fs.open(path)
            rules.append((path.toUri().getPath(), bytes(stream.readAllBytes()).decode("utf-8", "replace")))
            stream.close()
        elif "/_" in path.toUri().getPath():
            found.append((path.toString(), status.getModificationTime(), status.getLen()))
    return found, rules


def read_paths(spark: SparkSession, addresses: list[str], max_bytes: int) -> DataFrame:
    """path, modificationTime, length, content of files given by address, read in tasks."""

    def run(batches):
        from pyarrow import fs as arrow_fs

        for batch in batches:
            rows = []
            for address in batch.column("path").to_pylist():
                scheme, _, rest = address.partition(":")
                system, path = (arrow_fs.LocalFileSystem(), "/" + rest.lstrip("/")) if scheme == "file" else arrow_fs.FileSystem.from_uri(address)
                info = system.get_file_info(path)
                if info.size <= max_bytes:
                    with system.open_input_stream(path) as f:
                        rows.append({"path": address, "modificationTime": info.mtime, "length": info.size, "content": f.readall()})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64()), ("content", pa.binary())]))

    names = spark.createDataFrame([(a,) for a in addresses], "path string")
    return names.mapInArrow(run, "path string, modificationTime timestamp, length long, content binary")


def is_text_file(path: Column, endings: tuple[str, ...] = TEXT_ENDINGS) -> Column:
    """Whether a path is read: by its ending or, without one, by its name; in any case."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return paths.extension(path).isin(*endings) | name.isin(*TEXT_NAMES)


def _kept(listed: DataFrame, base: str, rule_files: list[tuple[str, str]], endings: tuple[str, ...], hidden: bool, listed_only: DataFrame | None) -> DataFrame:
    """Listed files (path) with their path_key, those that are read and not ignored."""
    top = unquote(urlparse(base).path) if "://" in base else os.path.abspath(base)
    path = F.url_decode(F.replace(F.regexp_replace("path", r"^[a-z]+:(//[^/]*)?(?=/)", ""), F.lit("+"), F.lit("%2B")))
    files = listed.withColumn("path_key", paths.normalised(F.substr(path, F.lit(len(top) + 2)))).where(F.col("path_key").isNotNull())
    rules = [(f[len(top) + 1 :].rpartition("/")[0], body) for f, body in rule_files]
    kept = files.where(is_text_file(F.col("path_key"), endings))
    if not hidden:
        kept = kept.where(~F.col("path_key").rlike(r"(^|/)\."))
    if listed_only is not None:
        kept = kept.join(listed_only.select("path_key"), "path_key", "left_semi")
    return ignored(kept, rule_table(listed.sparkSession, rules)).where(~F.col("ignored"))


def stable_read(read, stat, attempts: int = 3, wait: float = 0.05):
    """(content, what ``stat`` says of it), or (None, ...) for a file that changes during each attempt; ``stat`` gives (size, time)."""
    for k in range(attempts):
        before = stat()
        content = read()
        after = stat()
        if before == after and len(content) == after[0]:
            return content, after
        if k + 1 < attempts:
            time.sleep(wait * 2**k)
    return None, after


def read_stable(files: DataFrame, max_bytes: int) -> DataFrame:
    """path_key, size, mtime, content of files (path, path_key), read in tasks; content is null where a file kept changing or has gone."""

    def run(batches):
        from pyarrow import fs as arrow_fs

        for batch in batches:
            rows = []
            for address, key in zip(batch.column("path").to_pylist(), batch.column("path_key").to_pylist(), strict=True):
                scheme, _, rest = address.partition(":")
                if address.startswith("/"):
                    system, path = arrow_fs.LocalFileSystem(), address
                else:
                    system, path = (arrow_fs.LocalFileSystem(), unquote("/" + rest.lstrip("/"))) if scheme == "file" else arrow_fs.FileSystem.from_uri(address)

                def stat(system=system, path=path):
                    info = system.get_file_info(path)
                    return info.size, info.mtime

                def read(system=system, path=path):
                    with system.open_input_stream(path) as f:
                        return f.read(max_bytes + 1)

                try:
                    content, (size, mtime) = stable_read(read, stat)
                except FileNotFoundError:
                    content, size, mtime = None, None, None
                rows.append({"path_key": key, "size": size, "mtime": mtime, "content": content})
                if sum(len(r["content"] or b"") for r in rows) > 1 << 24:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("path_key", pa.string()), ("size", pa.int64()), ("mtime", pa.timestamp("us", "UTC")), ("content", pa.binary())])
    return files.select("path", "path_key").mapInArrow(run, "path_key string, size long, mtime timestamp, content binary")


def changes_since(spark: SparkSession, root: str, known: DataFrame, endings: tuple[str, ...] = TEXT_ENDINGS, max_bytes: int = MAX_FILE_BYTES, hidden: bool = False) -> DataFrame:
    """path_key, action, size, mtime, hash, text of the files that differ from ``known`` (path_key, size, mtime, hash).

    First sizes and times of all files are listed, and files that have kept both
    are done with: they are never opened.  Only the others are read, each as a whole
    or not at all (``unstable``).  Actions: add, modify, touch (new time, same
    content), unstable, delete.
    """
    base = root.rstrip("/")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select("path", "modificationTime", "length")
    marked, rule_files = unlisted(spark, base)
    if marked:
        more = spark.createDataFrame(marked, "path string, ms long, length long")
        listed = listed.unionByName(more.select("path", F.timestamp_millis("ms").alias("modificationTime"), "length"))
    there = _kept(listed.where(F.col("length") <= max_bytes), base, rule_files, endings, hidden, None).select("path", "path_key", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    before = known.select("path_key", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.col("hash").alias("_hash"))
    # the file system's times are whole milliseconds
    same = (there.path_key == before.path_key) & (F.col("size") == F.col("_size")) & (F.date_trunc("MILLISECOND", "mtime") == F.date_trunc("MILLISECOND", "_mtime"))
    fresh = read_stable(there.join(before, same, "left_anti"), max_bytes).withColumn("hash", F.sha2("content", 256))
    action = F.when(F.col("hash").isNull(), "unstable").when(F.col("_hash").isNull(), "add").when(F.col("hash") == F.col("_hash"), "touch").otherwise("modify")
    text = F.decode(F.make_valid_utf8(F.col("content").cast("string")).cast("binary"), "utf-8")
    changed = fresh.join(before.select("path_key", "_hash"), "path_key", "left").select("path_key", action.alias("action"), "size", "mtime", "hash", text.alias("text"))
    gone = before.join(there.select("path_key"), "path_key", "left_anti").select("path_key", F.lit("delete").alias("action"))
    return changed.unionByName(gone, allowMissingColumns=True)


def scan(spark: SparkSession, root: str, endings: tuple[str, ...] = TEXT_ENDINGS, max_bytes: int = MAX_FILE_BYTES, hidden: bool = False, listed_only: DataFrame | None = None) -> DataFrame:
    """path_key, path_key_ci, size, mtime, hash, head_hash, text of the files below ``root`` that are neither ignored nor hidden.

    Sizes are filtered in the reader, before contents are read.  ``listed_only``
    (path_key), for example ``git_listing``, restricts the scan to a listing.
    """
    base = root.rstrip("/")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select("path", "modificationTime", "length", "content")
    marked, rule_files = unlisted(spark, base)
    listed = read.where(F.col("length") <= max_bytes)
    if marked:
        listed = listed.unionByName(read_paths(spark, [m[0] for m in marked], max_bytes))
    out = _kept(listed, base, rule_files, endings, hidden, listed_only)
    return out.select(
        "path_key",
        F.lower("path_key").alias("path_key_ci"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("mtime"),
        F.sha2("content", 256).alias("hash"),
        identity.head_hash(F.col("content")).alias("head_hash"),
        F.decode(F.make_valid_utf8(F.col("content").cast("string")).cast("binary"), "utf-8").alias("text"),
    )


def git_listing(spark: SparkSession, root: str) -> DataFrame:
    """path_key of the tracked files of a work tree on the driver and of untracked ones that git does not ignore."""
    import subprocess

    out = subprocess.run(["git", "-C", root, "ls-files", "-z", "--cached", "--others", "--exclude-standard"], capture_output=True, check=True).stdout
    return spark.createDataFrame([(p,) for p in sorted(set(out.decode("utf-8", "replace").split("\0")) - {""})], "path_key string")


def check_collisions(files: DataFrame) -> None:
    """Raises if paths differ only in case, naming the first ones."""
    found = case_collisions(files).limit(20).collect()
    if found:
        raise ValueError("paths that differ only in case: " + "; ".join(", ".join(r.paths) for r in found))
