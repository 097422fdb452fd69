"""The reader of definitions on written samples, broken text, and as a table function."""

import random

from hayloft.operators import chunking
from hayloft.operators.definitions import ENDINGS, definition_rows, definitions, with_gaps

SCRIPT = """// it's { "
import { x } from "m{";
export class C1 extends Base<T> {
  private n = 1;
  async m0(a: string, b = "}") {
    const s = `{${a}`;
    if (a) { return b; }
  }
  get size(): { a: number } { return 1; }
}
export const f1 = (x) => {
  return function inner() { return x; };
};
const plain = 3;
export interface I { a: string; b(): void }
export type T1 = { a: string };
function top(a, b) {
  class Local { go() {} }
  function deep() { return '}'; }
}
console.log("tail {");
"""
RUST = """use std::fmt;
#[derive(Debug)]
pub struct P<'a> { x: &'a str, c: char }
pub struct U(u8);
impl<'a> P<'a> {
    pub fn new(x: &'a str) -> Self { let c = '{'; Self { x, c } }
    fn two(&self) -> Vec<u8> where Self: Sized {
        fn inner() {}
        vec![1]
    }
}
pub(crate) trait Tr { fn sig(&self); fn with(&self) { } }
impl Tr for P<'_> {}
const K: u32 = { 3 };
mod tests { fn t() { let s = r#"}"#; } }
"""
PYTHON = '''import os
@dec(
  1)
class A(object):
    """doc
def not_one(): pass
"""
    x = [1,
2]
    async def m(self, a="):"):
        def inner():
            pass
        return 1

    @property
    def p(self): return 2
def f(
    a,
):
    return a
print("x")
'''


def spans(text, ending):
    return [(d.first, d.end, d.type, " > ".join(d.labels)) for d in with_gaps(text, ending)]


def test_scripts():
    assert spans(SCRIPT, "ts") == [
        (0, 2, "block", ""),
        (2, 10, "class", "Class: C1"),
        (4, 8, "function", "Class: C1 > Method: m0"),
        (8, 9, "function", "Class: C1 > Method: size"),
        (10, 13, "function", "Function: f1"),
        (13, 14, "block", ""),
        (14, 15, "interface", "Interface: I"),
        (15, 16, "typealias", "Type: T1"),
        (16, 20, "function", "Function: top"),
        (17, 18, "class", "Function: top > Class: Local"),
        (17, 18, "function", "Function: top > Class: Local > Method: go"),
        (18, 19, "function", "Function: top > Function: deep"),
        (20, 22, "block", ""),
    ]


def test_rust():
    assert spans(RUST, "rs") == [
        (0, 2, "block", ""),
        (2, 3, "class", "Symbol: P"),
        (3, 4, "class", "Symbol: U"),
        (4, 11, "class", "Symbol: P"),
        (5, 6, "function", "Symbol: P > Function: new"),
        (6, 10, "function", "Symbol: P > Function: two"),
        (7, 8, "function", "Symbol: P > Function: two > Function: inner"),
        (11, 12, "interface", "Symbol: Tr"),
        (11, 12, "function", "Symbol: Tr > Function: with"),
        (12, 13, "class", "Symbol: Tr"),
        (13, 14, "other", "Symbol: K"),
        (14, 15, "other", "Symbol: tests"),
        (14, 15, "function", "Symbol: tests > Function: t"),
    ]


def test_python():
    assert spans(PYTHON, "py") == [
        (0, 1, "block", ""),
        (1, 16, "class", "Class: A"),
        (9, 13, "function", "Class: A > Method: m"),
        (10, 12, "function", "Class: A > Method: m > Function: inner"),
        (14, 16, "function", "Class: A > Method: p"),
        (16, 20, "function", "Function: f"),
        (20, 22, "block", ""),
    ]


def test_broken_text_is_forgiven():
    assert spans("class A {\n m() {\n", "ts") == [(0, 2, "class", "Class: A"), (1, 2, "function", "Class: A > Method: m")]
    assert spans("}}}\nfunction f() { }", "js") == [(0, 1, "block", ""), (1, 2, "function", "Function: f")]
    rng = random.Random(1)
    for ending, text in (("ts", SCRIPT), ("rs", RUST), ("py", PYTHON)):
        for _ in range(300):
            a, b = sorted(rng.choices(range(len(text)), k=2))
            cut = text[:a] + text[b:]
            rows = cut.count("\n") + 1
            for d in definitions(cut, ending):
                assert 0 <= d.first < d.end <= rows and d.labels
    for bad in ("", "export", "class", "fn", "impl<", "const", "type X", "'", "`", "pub(", "/*", '"""', "@"):
        for ending in ENDINGS:
            definitions(bad, ending)


def test_table_functions(spark):
    files = spark.createDataFrame([(1, "a.ts", SCRIPT), (2, "b/c.RS", RUST), (3, "d.py", PYTHON), (4, "e.txt", "plain"), (5, None, None), (6, "g.py", None)], "id long, path string, text string")
    rows = definition_rows(files).collect()
    assert {r.id for r in rows} == {1, 2, 3} and sum(r.id == 1 for r in rows) == 13
    chunking.register(spark)
    got = spark.sql("SELECT path AS path_key, c.* FROM {f} f, LATERAL chunks_of(path, text) c", f=files).collect()
    want = chunking.chunk_files(files.withColumnRenamed("path", "path_key")).collect()
    assert sorted((r.path_key or "", r.ordinal, r.start_line, r.end_line, r.chunk_type, r.label, r.chunk) for r in got) == sorted((r.path_key or "", r.ordinal, r.start_line, r.end_line, r.chunk_type, r.label, r.text) for r in want)
