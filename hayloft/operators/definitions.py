"""Definitions in source text: a small reader that follows nesting and forgives errors.

Text is cut into words and marks, comments and strings left out.  At the
beginning of a statement the reader looks for a definition of its language; one
with a body is read into, so methods and inner functions come out as well, each
with the labels of what it stands in.  A missing brace ends at the end of the
text, a surplus one is passed over.  An export is not part of what it exports.
Python goes by indentation.

Not told apart: regular expressions from divisions, so a brace within one counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: what labels say, by keyword
LABELS = {
    "function": "Function", "fn": "Function", "method": "Method", "class": "Class", "interface": "Interface", "type": "Type",
    "struct": "Symbol", "enum": "Symbol", "trait": "Symbol", "impl": "Symbol", "mod": "Symbol", "const": "Symbol", "static": "Symbol",
}
TYPES = {"function": "function", "fn": "function", "method": "function", "class": "class", "struct": "class", "enum": "class", "impl": "class", "interface": "interface", "trait": "interface", "type": "typealias"}
SCRIPT = ("function", "class", "interface", "type", "enum")
RUST = ("fn", "struct", "enum", "trait", "impl", "mod", "type", "const", "static")
MODIFIERS = {"export", "default", "declare", "abstract", "async", "public", "private", "protected", "readonly", "override", "static", "get", "set", "pub", "unsafe", "extern", "crate", "const"}
NO_METHODS = {"if", "for", "while", "switch", "catch", "return", "function", "match", "loop", "await", "typeof", "new", "super", "with"}

_QUIET = r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\])*(?:"|\Z)"""
_TEXT = r"""`(?:\\.|[^`\\])*(?:`|\Z)|'(?:\\.|[^'\\\n])*'?"""
_RAW = r"""\br(?P<raw>\#*)".*?(?:"(?P=raw)|\Z)|'(?:\\[^\n]{1,10}?|[^'\\\n])'|'\w+"""
_MARK = r"""(?P<token>[A-Za-z_$][\w$]*|=>|->|[{}()\[\];=<>:,.@\#*&|?+!/-])"""
_TOKEN = re.compile(f"{_QUIET}|{_TEXT}|{_MARK}", re.DOTALL)
_RUST_TOKEN = re.compile(f"{_QUIET}|{_RAW}|{_MARK}", re.DOTALL)
_VALUE = re.compile(r"=>|\bfunction\b|\bclass\b")


class Definition(NamedTuple):
    """Lines from ``first`` to ``end`` (exclusive), and the labels from the outermost on; the last is its own."""

    first: int
    end: int
    type: str
    labels: tuple[str, ...]


class _Reader:
    def __init__(self, text: str, ending: str):
        self.rust = ending == "rs"
        self.words = RUST if self.rust else SCRIPT
        self.tokens: list[str] = []
        self.lines: list[int] = []
        line, at = 0, 0
        for m in (_RUST_TOKEN if self.rust else _TOKEN).finditer(text):
            line, at = line + text.count("\n", at, m.start()), m.start()
            if m["token"]:
                self.tokens.append(m["token"])
                self.lines.append(line)
        self.found: list[Definition] = []

    def at(self, i: int) -> str:
        return self.tokens[i] if 0 <= i < len(self.tokens) else ""

    def line(self, i: int) -> int:
        return self.lines[min(i, len(self.lines) - 1)]

    def closed(self, i: int) -> int:
        """Behind the bracket that closes the one at ``i``."""
        depth = 0
        while i < len(self.tokens):
            depth += (self.tokens[i] in "{([") - (self.tokens[i] in "})]")
            i += 1
            if depth <= 0:
                break
        return i

    def starts(self, i: int) -> bool:
        """Whether a statement may begin at ``i``."""
        before = self.at(i - 1)
        return before in ("", "{", "}", ";", "]") or (self.lines[i] > self.lines[i - 1] and before not in ("=", "(", ",", "=>", ":", ".", "&", "|", "?", "+", "return"))

    def body(self, i: int, labels: tuple[str, ...], inside: str) -> int:
        """Reads statements up to the closing brace; returns what follows it."""
        while i < len(self.tokens) and self.tokens[i] != "}":
            if self.starts(i):
                after = self.statement(i, labels, inside)
                if after > i:
                    i = after
                    continue
            i = self.body(i + 1, labels, "block") if self.tokens[i] == "{" else i + 1
        return i + 1

    def modifier(self, k: int) -> bool:
        word, after = self.at(k), self.at(k + 1)
        if word not in MODIFIERS or (after in ("=", "(", ":", ";") and word != "pub"):
            return False  # another word, or a name
        if word in ("const", "static"):  # in Rust an item unless it is a function; in scripts only of an enum
            return after in (("fn", "unsafe", "async", "extern") if self.rust else ("enum",)) or (word == "static" and not self.rust)
        return True

    def statement(self, i: int, labels: tuple[str, ...], inside: str) -> int:
        """Behind the definition that begins at ``i``, or ``i``."""
        k, first = i, None
        while self.modifier(k):
            if self.at(k) not in ("export", "default") and first is None:
                first = k
            k += 1
            if self.rust and self.at(k - 1) == "pub" and self.at(k) == "(":
                k = self.closed(k)
        word, first = self.at(k), k if first is None else first
        if word in self.words and re.match(r"[A-Za-z_$*<]", self.at(k + 1)):
            return self.named(i, first, k, labels)
        if not self.rust and word in ("const", "let", "var") and inside in ("file", "class"):
            return self.value(i, first, k, labels)
        if not self.rust and inside == "class" and re.match(r"[A-Za-z_$]", word) and word not in NO_METHODS and self.at(k + 1) in ("(", "<"):
            return self.bodied(i, first, self.at(k), "method", k + 1, labels)
        return i

    def named(self, i: int, first: int, k: int, labels: tuple[str, ...]) -> int:
        word, k = self.tokens[k], k + 1
        if self.at(k) == "<":  # of an impl
            depth = 0
            while k < len(self.tokens):
                depth += (self.tokens[k] == "<") - (self.tokens[k] == ">")
                k += 1
                if depth <= 0:
                    break
        k += self.at(k) == "*"
        if word in ("type", "const", "static") or (self.rust and word == "mod" and self.at(k + 1) == ";"):
            end = self.ended(k)
            self.found.append(Definition(self.line(first), self.line(end - 1) + 1, TYPES.get(word, "other"), (*labels, f"{LABELS[word]}: {self.at(k)}")))
            return end
        return self.bodied(i, first, self.at(k), word, k + 1, labels)

    def ended(self, k: int) -> int:
        """Behind the end of a statement without a body of its own."""
        while k < len(self.tokens):
            if self.tokens[k] == ";":
                return k + 1
            if self.tokens[k] == "}" or (self.lines[k] > self.lines[k - 1] and self.starts(k) and self.tokens[k] not in ("=", "|", "&", ".")):
                return k
            k = self.closed(k) if self.tokens[k] in "{([" else k + 1
        return k

    def bodied(self, i: int, first: int, name: str, word: str, k: int, labels: tuple[str, ...]) -> int:
        while k < len(self.tokens) and self.tokens[k] not in ("{", ";", "}"):
            k = self.closed(k) if self.tokens[k] in "([" else k + 1
            if self.at(k - 1) == ":" and self.at(k) == "{":  # a type, not the body
                k = self.closed(k)
        if self.at(k) != "{":
            # without a body: a declaration only, but for types
            if word in ("struct", "enum") and self.at(k) == ";":
                self.found.append(Definition(self.line(first), self.line(k) + 1, TYPES[word], (*labels, f"{LABELS[word]}: {name}")))
                return k + 1
            return i
        own = (*labels, f"{LABELS[word]}: {name}")
        place = len(self.found)
        end = self.body(k + 1, own, "class" if word in ("class", "interface", "trait", "impl", "enum") else "block")
        self.found.insert(place, Definition(self.line(first), self.line(end - 1) + 1, TYPES.get(word, "other"), own))
        return end

    def value(self, i: int, first: int, k: int, labels: tuple[str, ...]) -> int:
        """A constant that holds a function or class."""
        end = self.ended(k + 1)
        if not _VALUE.search(" ".join(self.tokens[k:end])):
            return i
        own, place = (*labels, f"Function: {self.at(k + 1)}"), len(self.found)
        inner = next((x for x in range(k, end) if self.tokens[x] == "{"), None)
        if inner is not None:
            self.body(inner + 1, own, "block")
        self.found.insert(place, Definition(self.line(first), self.line(end - 1) + 1, "function", own))
        return end


_PY_QUIET = re.compile(r"""\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|\#[^\n]*""", re.DOTALL)
_PY_HEAD = re.compile(r"(\s*)(?:async\s+)?(def|class)\s+(\w+)")


def _python(text: str) -> list[Definition]:
    """By indentation: a definition lasts until a line that stands no deeper; strings and brackets don't count."""
    rows = _PY_QUIET.sub(lambda m: re.sub(r"[^\n]", "_", m[0]).replace("\n", "\n\0") if m[0][0] != "#" else " " * len(m[0]), text).split("\n")
    out: list[list] = []
    open_: list[tuple[int, int]] = []  # indentation, place in out
    depth, last, decorated = 0, 0, None
    for k, row in enumerate(rows):
        if not row.strip():
            continue
        if depth == 0 and row[0] != "\0":  # not within a string
            indent = len(row) - len(row.lstrip())
            while open_ and indent <= open_[-1][0]:
                out[open_.pop()[1]][1] = last + 1
            head = _PY_HEAD.match(row)
            if head:
                word = "class" if head[2] == "class" else "method" if open_ and out[open_[-1][1]][2] == "class" else "function"
                labels = out[open_[-1][1]][3] if open_ else ()
                open_.append((indent, len(out)))
                out.append([k if decorated is None else decorated, k + 1, TYPES[word], (*labels, f"{LABELS[word]}: {head[3]}")])
            decorated = (k if decorated is None else decorated) if row.lstrip().startswith("@") else None
        depth = max(0, depth + sum(row.count(c) for c in "([{") - sum(row.count(c) for c in ")]}"))
        last = k
    for _, place in open_:
        out[place][1] = last + 1
    return [Definition(*x) for x in out]


ENDINGS = ("py", "rs", "ts", "tsx", "js", "jsx")


def definitions(text: str, ending: str) -> list[Definition]:
    """All definitions of a text, outer before inner."""
    if ending == "py":
        return _python(text)
    reader = _Reader(text, ending)
    i = 0
    while i < len(reader.tokens):
        i = reader.body(i, (), "file")
    return reader.found


def with_gaps(text: str, ending: str) -> Iterator[Definition]:
    """Definitions, and blocks of what stands between the outermost; nothing if there are none."""
    found = definitions(text, ending)
    rows, at = text.split("\n"), 0
    blank = lambda a, b: not any(r.strip() for r in rows[a:b])
    for d in found:
        if len(d.labels) == 1:
            if d.first > at and not blank(at, d.first):
                yield Definition(at, d.first, "block", ())
            at = max(at, d.end)
        yield d
    if found and not blank(at, len(rows)):
        yield Definition(at, len(rows), "block", ())


SCHEMA = "start_line int, end_line int, chunk_type string, label string, breadcrumb string, depth int"


class DefinitionsOf:
    """Table function: definitions and gaps of a text, by the ending of its path."""

    def eval(self, path: str, text: str):
        ending = (path or "").rsplit(".", 1)[-1].lower()
        if ending in ENDINGS and text:
            for d in with_gaps(text, ending):
                yield d.first, d.end, d.type, d.labels[-1] if d.labels else "", " > ".join(d.labels), len(d.labels)


def register(spark) -> None:
    """Makes ``definitions_of(path, text)`` a table function of SQL, for use with LATERAL."""
    spark.udtf.register("definitions_of", F.udtf(DefinitionsOf, returnType=SCHEMA))


def definition_rows(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """The rows of ``files`` without the text, each with its definitions and gaps."""
    register(files.sparkSession)
    rest = ", ".join(f"`{c}`" for c in files.columns if c != text_col)
    return files.sparkSession.sql(f"SELECT {rest}, d.* FROM {{files}} f, LATERAL definitions_of(`{path_col}`, `{text_col}`) d", files=files)
