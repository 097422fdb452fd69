"""Evidence packs: of the candidates of each query those that cover most of it within budgets of bytes and files."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hayloft.operators import ranking


@dataclass(frozen=True)
class Budget:
    """What a pack may hold; ``candidates`` bounds what is looked at for a query, so a task never holds more."""

    total_bytes: int = 64 << 10
    files: int = 20
    per_file: int = 5
    candidates: int = 2000


def limits_of(size: int, path: str, left: int, held: dict[str, int], budget: Budget) -> list[str]:
    """The limits that keep one candidate out of a pack with ``left`` bytes and ``held`` pieces of each file, sorted by name."""
    n = held.get(path, 0)
    out = []
    if n == 0 and len(held) >= budget.files:
        out.append("max_files")
    if n >= budget.per_file:
        out.append("max_per_file")
    if size > left:
        out.append("max_total_bytes")
    return out


def greedy_cover(rows: list[tuple], budget: Budget) -> tuple[list[tuple[int, int]], list[str]]:
    """([(index, weight newly covered)] in order of choice, limits that kept candidates out).

    ``rows``: (score, path, start_line, row_id, size, {aspect: weight}).  Each step takes
    the fitting candidate that covers most new weight, ties by score (falling), path,
    line and id; without new weight left that is the order of scores.  A gain only
    falls as the pack grows and what does not fit never fits again, so a stale gain
    is an upper bound: only the head of the queue is computed anew.
    """
    order = sorted(range(len(rows)), key=lambda k: (-rows[k][0], rows[k][1], rows[k][2], rows[k][3]))
    queue = [(-sum(rows[k][5].values()), place, k) for place, k in enumerate(order)]
    heapq.heapify(queue)
    covered: set[str] = set()
    held: dict[str, int] = {}
    left, chosen, out = budget.total_bytes, [], []
    while queue:
        bound, place, k = queue[0]
        _, path, _, _, size, aspects = rows[k]
        if limits_of(size, path, left, held, budget):
            out.append(k)
            heapq.heappop(queue)
            continue
        gain = sum(w for a, w in aspects.items() if a not in covered)
        if gain != -bound:
            heapq.heapreplace(queue, (-gain, place, k))
            continue
        heapq.heappop(queue)
        chosen.append((k, gain))
        covered.update(aspects)
        held[path] = held.get(path, 0) + 1
        left -= size
    kept_out = {name for k in out for name in limits_of(rows[k][4], rows[k][1], left, held, budget)}
    return chosen, sorted(kept_out)


def covering_packs(candidates: DataFrame, budget: Budget = Budget(), seen: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """query_id, path, start_line, row_id, score, size, step, gain, reason, file_rank, ordinal, limits_hit.

    ``candidates``: query_id, path, start_line, row_id, score, size, aspects (map of
    string to integer weight; null: none).  Rows with a null query, path, score or size take no
    part, and a query of which nothing fits has no rows.  A task holds the best ``budget.candidates`` of one query.  Files come by their best score,
    then path; pieces of a file by line, then id.  ``seen`` (query_id, path): files
    of earlier answers in a session, left out.
    """
    usable = candidates.dropna(subset=["query_id", "path", "score", "size"])
    if seen is not None:
        usable = usable.join(seen.select("query_id", "path").distinct(), ["query_id", "path"], "left_anti")
    fields = ["query_id", "path", "start_line", "row_id", "score", "size"]
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "path", "start_line", "row_id")
    bounded = usable.select(*fields, "aspects").withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= budget.candidates)
    key_type = candidates.schema["query_id"].dataType.simpleString()

    def choose(key, part: pd.DataFrame) -> pd.DataFrame:
        rows = [(-float(p), path, 0, 0, int(size), dict(aspects or {})) for p, path, size, aspects in zip(part._place, part.path, part["size"], part.aspects, strict=True)]
        chosen, limits = greedy_cover(rows, budget)
        k = [i for i, _ in chosen]
        return pd.DataFrame({"query_id": part.query_id.iloc[k], "_place": part._place.iloc[k], "step": np.arange(1, len(k) + 1), "gain": np.array([g for _, g in chosen], dtype=np.int64), "limits_hit": pd.Series([limits] * len(k), dtype=object).set_axis(part.index[k])})

    picked = bounded.select("query_id", "_place", "path", "size", "aspects").groupBy("query_id").applyInPandas(choose, f"query_id {key_type}, _place int, step int, gain long, limits_hit array<string>")
    packs = bounded.drop("aspects").join(picked, ["query_id", "_place"]).drop("_place")
    packs = packs.withColumn("reason", F.when(F.col("gain") > 0, "coverage").otherwise("semantic_match"))
    packs = packs.withColumn("_best", F.max("score").over(Window.partitionBy("query_id", "path")))
    packs = packs.withColumn("file_rank", F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.desc("_best"), "path"))).drop("_best")
    ordinal = F.row_number().over(Window.partitionBy("query_id", "path").orderBy("start_line", "row_id", "step"))
    return packs.withColumn("ordinal", ordinal).select(*fields, "step", "gain", "reason", "file_rank", "ordinal", "limits_hit")


def confidence(candidates: DataFrame, limit: int = 2000, least: float = 1.0) -> DataFrame:
    """query_id, separation, low_confidence: how far the best of the first ``limit`` scores lies above their mean, in deviations.

    Relative, so that it does not drift with a model's scores.  Equal scores, or one alone, separate nothing.
    """
    best = ranking.candidate_cap(candidates, ["query_id"], limit).groupBy("query_id").agg(F.max("score").alias("top"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("spread"))
    separation = F.when(F.col("spread") > 1e-9, (F.col("top") - F.col("mean")) / F.col("spread")).otherwise(0.0)
    return best.select("query_id", F.round(separation, 4).alias("separation")).withColumn("low_confidence", F.col("separation") < least)


def seen_digest(seen: DataFrame) -> DataFrame:
    """query_id, seen_set_digest: SHA-256 over the sorted distinct paths of a session, one to a line."""
    return seen.groupBy("query_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("path")), "\n").cast("binary"), 256).alias("seen_set_digest"))
