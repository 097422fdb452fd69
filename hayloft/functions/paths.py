"""Predicates and classes of paths, as Column expressions.

Four sets of endings coexist on purpose: retrieval, ranking, buckets and
embedding prefixes each have their own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: endings by purpose
RETRIEVAL_DOCS = ("md", "mdx", "txt", "json", "yaml", "yml", "toml")
RETRIEVAL_GRAPHS = ("mmd", "mermaid")
RANKING_DOCS = ("md", "mdx", "txt", "json", "html", "htm", "css", "yaml", "yml", "toml", "lock")
BUCKET_DOCS = ("md", "mdx", "markdown", "txt", "json", "html", "htm", "css", "yaml", "yml", "toml")
PREFIX_DOCS = ("mmd", "mermaid", "md", "mdx", "markdown", "txt", "json", "yaml", "yml", "toml")
MARKDOWN = ("md", "markdown", "mmd")
# fixed values: language names by ending
LANGUAGES = {
    "bash": "bash", "c": "c", "cc": "cpp", "cpp": "cpp", "cs": "csharp", "css": "css", "cxx": "cpp", "go": "go", "h": "cpp", "hpp": "cpp", "htm": "html", "html": "html", "java": "java",
    "js": "javascript", "json": "json", "jsx": "javascript", "kt": "kotlin", "md": "markdown", "mermaid": "mermaid", "mmd": "mermaid", "php": "php", "py": "python", "rb": "ruby", "rs": "rust",
    "sass": "scss", "scala": "scala", "scss": "scss", "sh": "bash", "sql": "sql", "swift": "swift", "toml": "toml", "ts": "typescript", "tsx": "typescript", "xml": "xml", "yaml": "yaml", "yml": "yaml",
}


def extension(path: Column) -> Column:
    """The lower-cased ending after the last dot of the last path part; empty without one."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def _ends(path: Column, endings: tuple[str, ...]) -> Column:
    return path.rlike(r"\.(" + "|".join(endings) + ")$")


def is_graph(path: Column) -> Column:
    """Retrieval class graph; case-sensitive."""
    return _ends(path, RETRIEVAL_GRAPHS)


def is_doc(path: Column) -> Column:
    """Retrieval class doc; case-sensitive."""
    return _ends(path, RETRIEVAL_DOCS)


def retrieval_class(path: Column) -> Column:
    return F.when(is_graph(path), "graph").when(is_doc(path), "doc").otherwise("code")


def bucket(path: Column) -> Column:
    e = extension(path)
    return F.when(e.isin(*RETRIEVAL_GRAPHS), "graph").when(e.isin(*BUCKET_DOCS), "docs").otherwise("code")


def bucket_rank(name: Column) -> Column:
    return F.when(name == "code", 0).when(name == "docs", 1).otherwise(2)


def is_test(path: Column) -> Column:
    low = F.lower(path)
    return low.contains(".test.") | low.contains(".spec.") | low.contains("__tests__")


def ranks_as_graph(path: Column) -> Column:
    return extension(path).isin(*RETRIEVAL_GRAPHS)


def ranks_as_doc(path: Column) -> Column:
    return extension(path).isin(*RANKING_DOCS) | F.lower(path).contains("/docs/")


def is_markdown(path: Column) -> Column:
    """Whether a file is cut by its headings."""
    return extension(path).isin(*MARKDOWN)


def takes_prefix(path: Column) -> Column:
    return extension(path).isin(*PREFIX_DOCS)


def in_scope(path: Column, scope: str | None, whole_parts: bool = True) -> Column:
    """Below a folder; ``whole_parts=False`` is a plain string prefix."""
    if not scope:
        return F.lit(True)
    if not whole_parts:
        return path.startswith(scope)
    scope = scope.rstrip("/")
    return (path == scope) | path.startswith(scope + "/")


def like_literal(text: str) -> str:
    """Escapes a literal for LIKE ... ESCAPE '\\\\'."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("'", "''")


def normalised(path: Column) -> Column:
    """Forward slashes, no leading ``./``; null where a part is ``..`` or the path is absolute."""
    p = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(\./)+", "")
    return F.when(p.rlike(r"(^|/)\.\.(/|$)") | p.startswith("/"), None).otherwise(p)


def language(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit("text"))


def is_shown_kind(kind: Column, anchors: bool = False) -> Column:
    """Leaves anchors out unless they are asked for."""
    return F.lit(True) if anchors else kind.isNull() | (kind != "anchor")


def from_file_uri(uri: Column) -> Column:
    """The path of a ``file:`` address, percent signs decoded; a plus sign is one."""
    bare = F.regexp_replace(uri, "^file:(//[^/]*)?", "")
    return F.url_decode(F.replace(bare, F.lit("+"), F.lit("%2B")))
