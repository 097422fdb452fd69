"""A graph of files by the names they import and export, and what lies within some hops of given files.

The graph is kept as edges between files and names: files that share a name are
never paired.  A hop goes from files to names and on to files, and each half
keeps one row for what it reaches, so a name that a third of all files import costs its edges,
not their square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hayloft.functions import text
from hayloft.operators import chunking
from hayloft.sources.shared import Scratch

#: Edges of one file or name that a task takes before they are dealt to several.
HUB = 20_000
#: Keys over that size which are sent to all tasks; beyond it they are joined.
SENT = 100_000


def edges_of(files: DataFrame) -> DataFrame:
    """path, kind (imports, exports), name of files (path, text): one row for each distinct name.  Null texts have none."""
    lines = text.lines(F.coalesce("text", F.lit("")))
    rows = files.where(F.col("path").isNotNull()).select("path", lines.alias("_l"))
    rows = rows.select("path", chunking.imports_of(F.col("_l")).alias("imports"), chunking.exports_of(F.col("_l")).alias("exports"))
    marked = lambda kind: F.transform(kind, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))
    each = F.explode(F.concat(marked("imports"), marked("exports")))
    return rows.select("path", each.alias("e")).select("path", "e.kind", "e.name").distinct()


def _dealt(edges: DataFrame, keys: list[str], by: str, name: str, hub: int) -> DataFrame:
    """``edges`` with the number of parts of their key and the part they are in, by a hash of ``by``."""
    sizes = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hub)
    sizes = sizes.select(*keys, F.ceil(F.col("_n") / hub).cast("int").alias(f"{name}_parts"))
    few = sizes.limit(SENT + 1).count() <= SENT
    dealt = edges.join(F.broadcast(sizes) if few else sizes, keys, "left")
    parts = F.coalesce(f"{name}_parts", F.lit(1))
    return dealt.withColumn(f"{name}_parts", parts).withColumn(f"{name}_part", F.pmod(F.xxhash64(by), parts).cast("int"))


def _in_parts(parts: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), parts - 1))


def reach(edges: DataFrame, seeds: DataFrame, hops: int = 2, direction: str = "both", hub: int = HUB) -> DataFrame:
    """path, hops, root: files within ``hops`` of the ``seeds`` (path), by how many and from which (the least of the nearest).

    ``direction``: ``imports`` goes to what files import, ``importers`` to what
    imports them, ``both`` either way.  Seeds without edges are reached by
    themselves.  Keys with more than ``hub`` edges are dealt to several tasks.  Each
    hop is a written table; a name is passed once, at its first hop.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark)
    kinds = {"imports": ["imports"], "importers": ["exports"], "both": ["imports", "exports"]}[direction]
    other = F.when(F.col("kind") == "imports", "exports").otherwise("imports")
    whole = edges.dropna(subset=["path", "name"]).select("path", "kind", "name").distinct()
    links = scratch.write(_dealt(_dealt(scratch.write(whole, "edges"), ["kind", "name"], "path", "name", hub), ["path"], "name", "path", hub), "links")
    # from a file to its names, and from a name to its files; the parts of a key stand beside it
    out = links.where(F.col("kind").isin(kinds)).select("path", F.col("path_part").alias("part"), "kind", "name")
    back = links.select("kind", "name", F.col("name_part").alias("part"), "path")
    path_parts = links.groupBy("path").agg(F.max("path_parts").alias("parts"))
    name_parts = links.groupBy("kind", "name").agg(F.max("name_parts").alias("parts"))
    reached = frontier = scratch.write(seeds.dropna(subset=["path"]).select("path", F.lit(0).alias("hops"), F.col("path").alias("root")).distinct(), "hop0")
    passed = None
    for hop in range(1, hops + 1):
        asked = frontier.join(path_parts, "path").select("path", "root", _in_parts(F.col("parts")).alias("part"))
        names = asked.join(out, ["path", "part"]).groupBy(other.alias("kind"), "name").agg(F.min("root").alias("root"))
        if passed is not None:
            names = names.join(passed, ["kind", "name"], "left_anti")
        names = scratch.write(names, f"names{hop}")
        passed = names.select("kind", "name") if passed is None else passed.unionByName(names.select("kind", "name"))
        spread = names.join(name_parts, ["kind", "name"]).select("kind", "name", "root", _in_parts(F.col("parts")).alias("part"))
        found = spread.join(back, ["kind", "name", "part"]).groupBy("path").agg(F.min("root").alias("root"))
        frontier = scratch.write(found.join(reached, "path", "left_anti").select("path", F.lit(hop).alias("hops"), "root"), f"hop{hop}")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def pack_graph(packs: DataFrame, edges: DataFrame, limit: int = 200) -> DataFrame:
    """query_id, source, target, name, limits_hit: which files of a pack import what others of the same pack export.

    Nodes are files of the pack only.  The first ``limit`` edges of a query by
    source, target and name; ``limits_hit`` says that there were more.
    """
    nodes = packs.select("query_id", "path").distinct()
    known = nodes.join(edges, "path")
    side = lambda kind, name: known.where(F.col("kind") == kind).select("query_id", F.col("path").alias(name), "name")
    rows = side("imports", "source").join(side("exports", "target"), ["query_id", "name"]).where(F.col("source") != F.col("target"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("source", "target", "name"))
    more = F.count(F.lit(1)).over(Window.partitionBy("query_id")) > limit
    hit = F.when(more, F.array(F.lit("max_edges"))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("_place", place).withColumn("limits_hit", hit).where(F.col("_place") <= limit).select("query_id", "source", "target", "name", "limits_hit")
