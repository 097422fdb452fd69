"""Hierarchical ignore rules as automata: one for each folder that has rules, one pass for each path.

The patterns of a folder become a trie of path segments: literal segments by
name, segments with wildcards by a pattern of their own, and ``**`` as a state
that stays.  Walking a path's segments keeps the set of states reached; at each folder
above it, and at the path itself, the highest rule among them is that folder's
word, and over all folders with rules the last rule in order decides.

Paths meet the rules of the folders above them by an equi-join on the folder, so
the number of rules has no limit.  A folder with many paths below (the root has
all of them) is dealt to several groups, each with that folder's rules.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Paths of one folder that meet its rules as one group.
GROUP_PATHS = 20_000


class State:
    """A node of the trie."""

    __slots__ = ("ends", "literal", "stays", "through", "wild")

    def __init__(self, stays: bool = False):
        self.literal: dict[str, State] = {}
        self.wild: dict[str, tuple[re.Pattern, State]] = {}
        self.through: State | None = None  # behind ``**``
        self.stays = stays
        self.ends: list[tuple[int, bool]] = []  # (rule, for folders only)


class Automaton:
    """The rules of one folder; ``rules``: (order, pattern, for folders only, regex of the whole path)."""

    def __init__(self, rules: list[tuple[int, str, bool, str]]):
        self.root, self.odd = State(), []
        for order, pattern, dir_only, regex in rules:
            body = pattern.strip("/")
            segments = body.split("/")
            if "/" not in pattern.rstrip("/"):
                segments = ["**", *segments]
            if any("**" in s and s != "**" for s in segments) or re.search(r"\[[^\]]*/", body):
                self.odd.append((order, dir_only, re.compile(regex)))  # wildcards that cross segments
            else:
                self._add(segments, order, dir_only)

    def _add(self, segments: list[str], order: int, dir_only: bool) -> None:
        state = self.root
        if len(segments) > 1 and segments[-1] == "**":
            segments = [*segments, "*"]  # all below, but not the folder itself
        for s in segments:
            if s == "**":
                state.through = state.through or State(True)
                state = state.through
            elif any(c in s for c in "*?["):
                if s not in state.wild:
                    state.wild[s] = (re.compile(segment_regex(s)), State())
                state = state.wild[s][1]
            else:
                state = state.literal.setdefault(s, State())
        state.ends.append((order, dir_only))

    def matches(self, path: str, base: str) -> list[tuple[int, int]]:
        """(depth, highest rule) of the path below ``base`` and the folders above it."""
        own = path[len(base) + 1 :] if base else path
        segments = own.split("/")
        above = base.count("/") + 1 if base else 0
        now, out = self._with_through([self.root]), []
        for k, s in enumerate(segments):
            is_dir = k + 1 < len(segments)
            reached = []
            for state in now:
                if state.stays:
                    reached.append(state)
                if s in state.literal:
                    reached.append(state.literal[s])
                reached += [after for pattern, after in state.wild.values() if pattern.fullmatch(s)]
            now = self._with_through(list({id(x): x for x in reached}.values()))
            best = max((order for x in now for order, dir_only in x.ends if is_dir or not dir_only), default=-1)
            if self.odd:
                prefix = "/".join([base, *segments[: k + 1]] if base else segments[: k + 1])
                best = max([best, *(order for order, dir_only, regex in self.odd if (is_dir or not dir_only) and regex.search(prefix))])
            if best >= 0:
                out.append((above + k, best))
        return out

    @staticmethod
    def _with_through(states: list[State]) -> list[State]:
        out, seen = [], set()
        while states:
            x = states.pop()
            if id(x) not in seen:
                seen.add(id(x))
                out.append(x)
                if x.through:
                    states.append(x.through)
        return out


def segment_regex(segment: str) -> str:
    """One segment with ``*``, ``?`` and classes."""
    out, k = "", 0
    while k < len(segment):
        c = segment[k]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in segment[k + 2 :]:
            end = segment.index("]", k + 2)
            inner = segment[k + 1 : end].replace("\\", "\\\\")
            out, k = out + "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]", end
        else:
            out += re.escape(c)
        k += 1
    return f"(?s:{out})"


def ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``ignored``: for each path and folder above it the last matching rule decides; a blocked folder blocks all below."""
    given = rules.select("rule_order", F.trim(F.col("base_dir"), F.lit("/")).alias("base"), "pattern", "negated", "dir_only", "regex")
    parts = F.split("path_key", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    named = files.where(F.col("path_key").isNotNull()).select("path_key").distinct()
    met = named.select("path_key", F.explode(above).alias("base")).join(given.select("base").distinct(), "base")
    hot = met.groupBy("base").agg(F.ceil(F.count(F.lit(1)) / GROUP_PATHS).cast("int").alias("parts")).where(F.col("parts") > 1)
    dealt = met.join(hot, "base", "left").select("base", F.coalesce(F.pmod(F.xxhash64("path_key"), F.col("parts")).cast("int"), F.lit(0)).alias("part"), "path_key")
    copied = given.join(hot, "base", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts", "negated")

    def match(paths: pa.Table, own: pa.Table) -> pa.Table:
        automaton = Automaton(list(zip(*(own.column(c).to_pylist() for c in ("rule_order", "pattern", "dir_only", "regex")), strict=True)))
        base = paths.column("base")[0].as_py() if len(paths) else ""
        found = [(p, depth, order) for p in paths.column("path_key").to_pylist() for depth, order in automaton.matches(p, base)]
        columns = list(zip(*found, strict=True)) if found else [[], [], []]
        return pa.table([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32())], names=["path_key", "depth", "rule_order"])

    hits = dealt.groupBy("base", "part").cogroup(copied.groupBy("base", "part")).applyInArrow(match, "path_key string, depth int, rule_order int")
    last = hits.groupBy("path_key", "depth").agg(F.max("rule_order").alias("rule_order")).join(rules.select("rule_order", "negated"), "rule_order")
    blocked = last.groupBy("path_key").agg(F.bool_or(~F.col("negated")).alias("_blocked"))
    return files.join(blocked, "path_key", "left").withColumn("ignored", F.coalesce("_blocked", F.lit(False))).drop("_blocked")
