"""Joins that survive hot keys, and connected components over a table of edges.

Components go by least labels and pointer jumping.  Every round joins labels
to edges, takes the least label around each node and then replaces each label
by its own label, so that rounds follow the logarithm of a component's width.
Each round is written to the shared folder, which cuts the lineage; nothing but
one yes or no per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Scratch

#: Left rows of one key that stay together in ``split_join``.
HOT_ROWS = 20_000
#: The most keys that can count as hot at once, whatever the data.
HOT_KEYS = 100_000


def split_join(left: DataFrame, right: DataFrame, keys: list[str], spread: str, how: str = "inner", hot_rows: int | None = None) -> DataFrame:
    """``left`` joined to ``right``, which has few rows a key, where a key of ``left`` may be hot.

    A key with more than ``hot_rows`` (``HOT_ROWS``) left rows (more than a ``HOT_KEYS``-th of all rows,
    if that is larger) is cut into parts by a hash of column ``spread``, and its
    right rows are given to each part.  Thus at most ``HOT_KEYS`` small rows are
    broadcast.  ``left`` should be a written table, as it is counted first.
    """
    rows, hot_rows = left.count(), hot_rows or HOT_ROWS
    if rows <= hot_rows:
        return left.join(right, keys, how)
    least = max(hot_rows, rows // HOT_KEYS)
    hot = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > least)
    hot = F.broadcast(hot.select(*keys, F.ceil(F.col("_rows") / least).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = left.join(hot, keys, "left").withColumn("_part", F.pmod(F.xxhash64(spread, F.lit(11)), parts).cast("int")).drop("_parts")
    copied = right.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copied, [*keys, "_part"], how).drop("_part")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) from edges with columns a and b (long)."""
    scratch = Scratch(spark)
    edges = edges.where(F.col("a") != F.col("b")).select("a", "b")
    both = scratch.write(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")), "0")
    turn = 0
    while True:
        near = split_join(both.withColumnRenamed("b", "node"), labels, ["node"], "a").groupBy("a").agg(F.min("label").alias("near"))
        turn += 1
        step = scratch.write(labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), f"{turn}-step")
        target = step.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        done = scratch.write(split_join(step, target, ["label"], "node").select("node", "old", F.col("jump").alias("label")), str(turn))
        scratch.drop(str(turn - 1), f"{turn}-step")
        labels = done.select("node", "label")
        if done.where(F.col("old") != F.col("label")).isEmpty():
            scratch.drop("edges")
            return labels
