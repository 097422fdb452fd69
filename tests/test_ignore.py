"""Ignore automata against a regular expression for each rule."""

import random
import re

import pytest
from pyspark.sql import functions as F

from hayloft.sources import corpus, ignore


def plain(path, rules):
    parts, blocked = path.split("/"), False
    for k in range(1, len(parts) + 1):
        prefix, hit = "/".join(parts[:k]), None
        for order, _base, _pattern, negated, dir_only, regex in rules:
            if (k < len(parts) or not dir_only) and re.search(regex, prefix):
                hit = not negated
        blocked |= bool(hit)
    return blocked


def some(seed, n_rules=60, n_paths=400):
    rng = random.Random(seed)
    names = ["a", "b", "c", "ab", "abc", "x.py", "y.rs", "a b", "é", "[z]", "log.1"]
    paths = sorted({"/".join(rng.choice(names) for _ in range(rng.randint(1, 5))) for _ in range(n_paths)})
    segments = [*names, "*", "**", "a*", "*.py", "?", "[ab]", "[!a]*", "l?g.*", "a**c", "[a/b]", "*b*"]
    rules = []
    for base in ["", "a", "a/b", "ab", "c/a b"]:
        lines = []
        for _ in range(n_rules // 5):
            body = "/".join(rng.choice(segments) for _ in range(rng.choice([1, 1, 1, 2, 3])))
            lines.append(rng.choice(["", "", "!"]) + rng.choice(["", "", "/"]) + body + rng.choice(["", "", "/", "/**"]))
        rules += corpus.parse_rules("\n".join(lines), base, len(rules))
    return paths, rules


@pytest.mark.parametrize("seed", range(4))
def test_same_as_a_pattern_for_each_rule(seed):
    for more in range(12):
        paths, rules = some(seed * 100 + more, rng_size(more))
        by_base = {}
        for r in rules:
            by_base.setdefault(r[1], []).append((r[0], r[2], r[4], r[5]))
        negated = {r[0]: r[3] for r in rules}
        automata = {b: ignore.Automaton(own) for b, own in by_base.items()}
        for path in paths:
            last = {}
            for base, automaton in automata.items():
                if not base or path.startswith(base + "/"):
                    for depth, order in automaton.matches(path, base):
                        last[depth] = max(last.get(depth, -1), order)
            assert any(not negated[o] for o in last.values()) == plain(path, rules), path


def rng_size(k):
    return 5 * (1 + k % 4 * 4)


def test_many_rules_and_a_hot_root(spark, monkeypatch):
    monkeypatch.setattr(ignore, "GROUP_PATHS", 50)
    paths, rules = some(7)
    rules = [*rules, *corpus.parse_rules("\n".join(f"never{k}" for k in range(12_000)), "", len(rules))]
    files = spark.createDataFrame([(p, k) for k, p in enumerate([*paths, paths[0]])] + [(None, -1)], "path_key string, ignored_before int")
    got = corpus.ignored(files, spark.createDataFrame(rules, corpus.RULE)).collect()
    assert len(got) == len(paths) + 2
    want = {p: plain(p, [r for r in rules if not r[2].startswith("never")]) for p in paths}
    assert all(r.ignored == (want[r.path_key] if r.path_key else False) for r in got) and len(set(want.values())) == 2
    none = spark.createDataFrame([], corpus.RULE)
    assert corpus.ignored(files, none).where(F.col("ignored")).isEmpty()
