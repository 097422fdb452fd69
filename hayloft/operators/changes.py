"""Change detection, visibility, compaction and retention of versioned rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def detect_changes(current: DataFrame, stored: DataFrame) -> DataFrame:
    """path_key, action (add, modify, delete, same) from two tables of path_key and hash."""
    both = current.select("path_key", F.col("hash").alias("now"), F.lit(1).alias("_c")).join(stored.select("path_key", F.col("hash").alias("then"), F.lit(1).alias("_s")), "path_key", "full_outer")
    action = F.when(F.col("_s").isNull(), "add").when(F.col("_c").isNull(), "delete").when(F.col("now").eqNullSafe(F.col("then")), "same").otherwise("modify")
    return both.select("path_key", action.alias("action"))


def with_renames(changes: DataFrame, current: DataFrame, stored: DataFrame) -> DataFrame:
    """Marks an added path as ``rename`` of a deleted one with the same hash, if both are the only ones."""
    gone = changes.where(F.col("action") == "delete").join(stored.select("path_key", "hash"), "path_key").groupBy("hash").agg(F.min("path_key").alias("old_path"), F.count(F.lit(1)).alias("n_old"))
    new = changes.where(F.col("action") == "add").join(current.select("path_key", "hash"), "path_key").groupBy("hash").agg(F.min("path_key").alias("path_key"), F.count(F.lit(1)).alias("n_new"))
    pairs = new.join(gone, "hash").where((F.col("n_old") == 1) & (F.col("n_new") == 1)).select("path_key", "old_path")
    out = changes.join(pairs, "path_key", "left").join(pairs.select(F.col("old_path").alias("path_key"), F.lit(True).alias("_from")), "path_key", "left")
    return out.select("path_key", F.when(F.col("old_path").isNotNull(), "rename").when(F.col("_from"), "rename_from").otherwise(F.col("action")).alias("action"), "old_path")


def visible(rows: DataFrame, tombstones: DataFrame, current: DataFrame) -> DataFrame:
    """Rows of paths without a tombstone, or in their path's current segment.  Both side tables have one row per path."""
    dead = tombstones.select("path_key").distinct()
    # only tombstoned paths need their current segment: one join against what is usually a small table
    now = dead.join(current.select("path_key", F.col("segment").alias("_now")), "path_key", "left").withColumn("_dead", F.lit(True))
    joined = rows.join(now, "path_key", "left")
    return joined.where(F.col("_dead").isNull() | F.coalesce(F.col("segment") == F.col("_now"), F.lit(False))).drop("_dead", "_now")


def union_segments(parts: list[DataFrame]) -> DataFrame:
    """The rows of all segments; columns that a segment doesn't have are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def segment_counts(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """segment, rows, paths, bytes of a store's rows."""
    return rows.groupBy("segment").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("path_key").alias("paths"), F.sum(F.octet_length(text_col)).alias("bytes"))


def manifest_totals(counts: DataFrame, tombstones: DataFrame) -> DataFrame:
    """One row of sums for a manifest: rows, size_bytes, segments, tombstones."""
    total = counts.agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("size_bytes"), F.count(F.lit(1)).alias("segments"))
    return total.crossJoin(tombstones.agg(F.count(F.lit(1)).alias("tombstones")))  # one row each


def compact(rows: DataFrame, tombstones: DataFrame, current: DataFrame, segment: str) -> DataFrame:
    """The live view as one segment; rows of files changed in place stay."""
    return visible(rows, tombstones, current).withColumn("segment", F.lit(segment))


def merge_segment_index(parent: DataFrame, tombstones: DataFrame, added: DataFrame) -> DataFrame:
    """Where each path lives now: the parent's paths without tombstone, and the added ones."""
    kept = parent.join(tombstones.select("path_key"), "path_key", "left_anti").join(added.select("path_key"), "path_key", "left_anti")
    return kept.unionByName(added)


def retained(snapshots: DataFrame, newest: int = 5, age_s: int = 600, now=None, pinned: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``age_rank`` and ``retain``: active, pinned, young or among the newest; snapshots have snapshot_id, created_at, active.

    ``by`` names the columns of a store; without it all rows are one store's
    snapshots, which are few.  ``now`` may be a column.
    """
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("created_at"), F.desc("snapshot_id")))
    out = snapshots.withColumn("age_rank", rank)
    if pinned is not None:
        out = out.join(pinned.select("snapshot_id", F.lit(True).alias("_pin")).distinct(), "snapshot_id", "left")
    else:
        out = out.withColumn("_pin", F.lit(None).cast("boolean"))
    young = F.unix_timestamp(F.lit(now) if now is not None else F.current_timestamp()) - F.unix_timestamp("created_at") <= age_s
    keep = F.coalesce("active", F.lit(False)) | F.coalesce("_pin", F.lit(False)) | young | (F.col("age_rank") <= newest)
    return out.withColumn("retain", keep).drop("_pin")


def unreferenced(artifacts: DataFrame, manifests: DataFrame) -> DataFrame:
    """Artifacts (name) that no retained manifest (segments: array) refers to."""
    used = manifests.select(F.explode("segments").alias("name")).distinct()
    return artifacts.join(used, "name", "left_anti")


def case_collisions(files: DataFrame) -> DataFrame:
    """Keys that differ only in case, with all their spellings."""
    return files.groupBy(F.lower("path_key").alias("path_key_ci")).agg(F.array_sort(F.collect_set("path_key")).alias("paths")).where(F.size("paths") > 1)


def orphans(folders: DataFrame, known: DataFrame, key: str = "store") -> DataFrame:
    """Folders of stores that no metadata knows."""
    return folders.join(known.select(key).distinct(), key, "left_anti")


def directory_digests(files: DataFrame, by: str = "dir") -> DataFrame:
    """by, files, bytes, digest of each folder's files (name, size, hash in hex).

    The digest sums part of each file's hash over name and content, so that it
    doesn't depend on order and no folder comes together in one task.
    """
    own = F.conv(F.left(F.sha2(F.concat("name", F.lit("\0"), "hash").cast("binary"), 256), F.lit(12)), 16, 10).cast("decimal(20,0)")
    total = files.groupBy(by).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.sum(own).alias("_sum"))
    return total.select(by, "files", "bytes", F.col("_sum").cast("string").alias("digest"))
