"""Text helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lines(text: Column) -> Column:
    """Lines without their ends; a final line end opens no further line, and a carriage return before it goes."""
    parts = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"\r$", ""))
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).when(text.endswith("\n"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def utf8_cut(text: Column, limit: Column) -> Column:
    """The longest prefix of at most ``limit`` bytes that ends between characters."""
    raw = text.cast("binary")

    def cut(k: int) -> Column:
        part = F.substring(raw, F.lit(1), F.greatest(limit - k, F.lit(0)))
        return F.when(F.is_valid_utf8(part.cast("string")), part.cast("string"))

    return F.when(F.octet_length(text) <= limit, text).otherwise(F.coalesce(*(cut(k) for k in range(4))))


def sanitised(text: Column) -> Column:
    """No terminal escape sequences, and no control characters but line feed and tab."""
    bare = F.regexp_replace(text, "\\x1b\\[[0-9;?]*[ -/]*[@-~]", "")
    return F.regexp_replace(bare, "[\\x00-\\x08\\x0b-\\x1f\\x7f]", "")


def preview(text: Column, max_lines: int, max_chars: int) -> Column:
    """The first lines, cut to a number of characters; an ellipsis marks what is left out."""
    all_lines = lines(text)
    head = F.array_join(F.slice(all_lines, 1, max_lines), "\n")
    short = F.left(head, F.lit(max_chars))
    return F.when((F.size(all_lines) > max_lines) | (F.length(head) > max_chars), F.concat(short, F.lit("..."))).otherwise(head)


def contains_ignoring_case(text: Column, part: Column) -> Column:
    return F.contains(F.lower(text), F.lower(part))


def human_size(n: Column) -> Column:
    """Bytes with one decimal above 1 KB."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        out = F.when(n >= 1024**power, F.concat(F.format_string("%.1f", n / float(1024**power)), F.lit(f" {unit}"))).otherwise(out)
    return out


def age(seconds: Column) -> Column:
    return (
        F.when(seconds < 60, "just now")
        .when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m ago")))
        .when(seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h ago")))
        .otherwise(F.concat(F.floor(seconds / 86400).cast("string"), F.lit("d ago")))
    )


def repository_slug(url: Column) -> Column:
    """owner-name of a remote address; empty if it has none."""
    part = F.regexp_extract(url, r"[:/]([^/:]+/[^/]+?)(\.git)?/?$", 1)
    return F.replace(part, F.lit("/"), F.lit("-"))


def error_code(message: Column) -> Column:
    """The code before a colon if it is a known one, else by words in the message."""
    # fixed values: codes of the query protocol
    low = F.lower(message)
    named = F.trim(F.substring_index(low, ":", 1))
    known = named.isin("busy", "timeout", "cancelled", "invalid_request", "internal", "incompatible") & message.contains(":")
    out = F.when(known, named)
    for word, code in (("busy", "busy"), ("timeout", "timeout"), ("cancel", "cancelled"), ("invalid", "invalid_request"), ("incompatible", "incompatible")):
        out = out.when(low.contains(word), code)
    return out.otherwise("internal")


def exit_status(code: Column) -> Column:
    # fixed values: exit statuses of the query protocol
    return F.when(code == "busy", 10).when(code == "timeout", 11).when(code == "cancelled", 12).when(code == "incompatible", 13).otherwise(1)


# fixed values: lines of a snippet by mode
SNIPPET_LINES = {"full": None, "long": 24, "default": 12, "short": 8, "none": 0}


def snippet(text: Column, mode: str = "default") -> Column:
    """The first lines of a hit: none, 8, 12, 24 or all of them."""
    budget = SNIPPET_LINES[mode]
    if budget is None:
        return text
    return F.array_join(F.slice(lines(text), 1, budget), "\n") if budget else F.lit("")


def lines_left_out(text: Column, mode: str = "default") -> Column:
    """How many lines a snippet leaves out: the remainder that a reader is told of."""
    budget = SNIPPET_LINES[mode]
    return F.lit(0) if budget is None else F.greatest(F.size(lines(text)) - budget, F.lit(0))


def tags(chunk_type: Column, is_test: Column, is_anchor: Column) -> Column:
    definition = chunk_type.isin("function", "class", "method", "interface", "typealias")
    return F.array_compact(F.array(F.when(definition, F.lit("Definition")), F.when(is_test, F.lit("Test")), F.when(is_anchor, F.lit("Anchor"))))


def embedding_text(text: Column, summary: Column, prefix: Column) -> Column:
    """What is embedded: a prefix for documents, a summary of diagrams if there is one, the text."""
    return F.concat(F.coalesce(prefix, F.lit("")), F.when(summary.isNotNull(), F.concat(F.lit("[diagram-summary]\n"), summary, F.lit("\n\n"))).otherwise(""), text)


def chunk_header(breadcrumbs: Column, text: Column) -> Column:
    """A chunk under the path of its headings."""
    return F.concat(F.array_join(breadcrumbs, " > "), F.lit("\n---\n"), text)


def byte_range(line_array: Column, first: Column, last: Column) -> Column:
    """(start, end) in bytes of the lines from ``first`` to before ``last``, each with its line feed."""
    size = lambda n: F.aggregate(F.slice(line_array, F.lit(1), n), F.lit(0).cast("long"), lambda s, x: s + F.octet_length(x) + 1)
    return F.struct(size(first).alias("start"), size(last).alias("end"))


def error_envelope(code: Column, message: Column) -> Column:
    """The JSON that a failed query returns."""
    return F.to_json(F.struct(F.struct(code.alias("code"), message.alias("message")).alias("error")))
