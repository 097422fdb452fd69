"""Summaries of Mermaid diagrams, for embedding text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: how many parts a summary names
MAX_EDGES, MAX_LINKS, MAX_NODES, MAX_MESSAGES = 48, 24, 48, 48
_DIRECTIVE = re.compile(r"(?i)^(graph |flowchart |%%|subgraph |end$|classdef |class |style |linkstyle |direction )")
_NODE = re.compile(r"^([A-Za-z0-9_.-]+)\s*(?:[\[({>]+\"?([^\])}\"]*)\"?[\])}]+)?")
_LABELLED = re.compile(r"^(.*?)\s*--\s*([^->|][^>|]*?)\s*-->\s*(.*)$|^(.*?)\s*-->\|([^|]*)\|\s*(.*)$|^(.*?)\s*-->\s*(.*)$")
_CLICK = re.compile(r"(?i)^click\s+(\S+)\s+(?:href\s+|call\s+)?\"?([^\"\s]+)")
_MESSAGE = re.compile(r"^([^-:>]+?)\s*-{1,2}>>?[+-]?\s*([^:]+?)\s*:\s*(.+)$")
_FENCE = re.compile(r"^[\s>]*(```|~~~)\s*(\S*)")


def fences(text: str) -> list[str]:
    """Bodies of fenced mermaid blocks, also inside quotes."""
    out, body, mark = [], None, None
    for line in text.split("\n"):
        m = _FENCE.match(line)
        if body is None:
            if m and m[2].lower() == "mermaid":
                body, mark = [], m[1]
        elif m and m[1] == mark:
            out.append("\n".join(body))
            body = None
        else:
            body.append(re.sub(r"^\s*(>\s?)+", "", line))
    return out


def _node(text: str) -> tuple[str, str | None]:
    m = _NODE.match(text.strip())
    return (m[1], (m[2] or "").strip() or None) if m else (text.strip(), None)


def flowchart(block: str) -> str | None:
    """Edges and links by node label, or the nodes if there are none."""
    labels: dict[str, str] = {}
    edges, links = [], []
    for raw in block.split("\n"):
        line = raw.strip().rstrip(";")
        if not line or _DIRECTIVE.match(line):
            continue
        if m := _CLICK.match(line):
            links.append((m[1], m[2]))
        elif "-->" in line and (m := _LABELLED.match(line)):
            left, label, right = next((x for x in (m.group(1, 2, 3), m.group(4, 5, 6)) if x[0] is not None), (m[7], None, m[8]))
            ends = []
            for side in (left, right):
                name, text = _node(side)
                if text:
                    labels.setdefault(name, text)
                ends.append((name, text))
            edges.append((*ends, label))
        elif m := _NODE.match(line):
            if m[2]:
                labels.setdefault(m[1], m[2].strip())
    named = lambda end: end[1] or labels.get(end[0], end[0])
    parts = []
    if edges:
        parts.append("Mermaid flowchart edges: " + "; ".join(f"{named(a)} -> {named(b)}" + (f" ({label.strip()})" if label else "") for a, b, label in edges[:MAX_EDGES]))
    if links:
        parts.append("Mermaid flowchart links: " + "; ".join(f"{labels.get(k, k)} links to {t}" for k, t in links[:MAX_LINKS]))
    if not parts and labels:
        parts.append("Mermaid flowchart nodes: " + "; ".join(v if v == k else f"{v} ({k})" for k, v in list(labels.items())[:MAX_NODES]))
    return "\n".join(parts) or None


def sequence(block: str) -> str | None:
    found = [m for line in block.split("\n") if (m := _MESSAGE.match(line.strip()))]
    return "Mermaid sequence messages: " + "; ".join(f"{m[1]} -> {m[2]}: {m[3]}" for m in found[:MAX_MESSAGES]) if found else None


def summary(text: str | None, is_diagram_file: bool) -> str | None:
    """The summaries of all diagrams of a file, or None."""
    out = []
    for block in [text or ""] if is_diagram_file else fences(text or ""):
        head = next((x.strip().lower() for x in block.split("\n") if x.strip()), "")
        first, second = (sequence, flowchart) if head.startswith("sequencediagram") else (flowchart, sequence)
        made = first(block) or (None if head.startswith(("graph ", "flowchart ", "sequencediagram")) else second(block))
        if made and head:
            out.append(made)
    return "\n".join(out) or None


@F.pandas_udf(T.StringType())
def diagram_summary(text: pd.Series, is_diagram_file: pd.Series) -> pd.Series:
    return pd.Series([summary(t, bool(d)) for t, d in zip(text, is_diagram_file, strict=True)], dtype=object)
