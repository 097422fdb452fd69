"""The given tables, and the corpus that the registered queries derive from them.

A document stands for a file: its path comes from source, language and id, its
ending from the id, its segment from the id.  Every seventh path is
tombstoned; every fourteenth also has a second version in a newer segment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hayloft.operators import changes

# fixed values: endings by doc_id % 8
ENDINGS = (".py", ".md", ".mmd", ".json", ".test.ts", ".html", ".rs", ".mermaid")

# heads, methods and tails of generated files: W, ID and J are filled in
SCRIPT_FILE = (
    """// W it's { "\nimport { x } from "m{";\nexport class CID {""",
    """  async mJ(a, b = "}") {\n    const s = `{${a}`;\n    if (a) { return '{'; }\n  }""",
    """}\nexport const fID = (x) => {\n  return x;\n};\nconsole.log("W {");""",
)
RUST_FILE = (
    """// W it's {\npub struct SID<'a> { x: &'a str }\nimpl<'a> SID<'a> {""",
    """    pub fn mJ(&self) -> char {\n        let c = '{';\n        c\n    }""",
    """}\nfn fID() -> &'static str {\n    r#"}"W"#\n}\nuse std::fmt;""",
)
PYTHON_FILE = (
    """# W (\nimport os\nclass CID(object):""",
    """    @property\n    def mJ(self, a=")"):\n        \"\"\"W\ndef no(): \"\"\"""",
    """def fID(\n        a,\n    ):\n    return a\nprint("W")""",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_path(docs: DataFrame) -> DataFrame:
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("doc_id") % 8 + 1).cast("int"))
    return docs.withColumn("path", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), ending))).withColumn("segment", F.concat(F.lit("seg_"), (F.col("doc_id") % 4).cast("string")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_path(table(spark, sf_dir, "documents"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path_key, segment, text, doc_id of all stored rows, second versions included."""
    first = documents(spark, sf_dir).select(F.col("path").alias("path_key"), "segment", "text", "doc_id")
    second = first.where(F.col("doc_id") % 14 == 0).select("path_key", F.lit("seg_4").alias("segment"), F.concat("text", F.lit(" (changed)")).alias("text"), "doc_id")
    return changes.union_segments([first, second])


def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).where(F.col("doc_id") % 7 == 0).select(F.col("path").alias("path_key"))


def current_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return docs.where((F.col("doc_id") % 7 != 0) | (F.col("doc_id") % 14 == 0)).select(F.col("path").alias("path_key"), F.when(F.col("doc_id") % 14 == 0, "seg_4").otherwise(F.col("segment")).alias("segment"))


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk per document with a vector: row_id, path, start_line, num_lines, chunk_type, is_anchor, embedding."""
    vectors = table(spark, sf_dir, "embeddings")
    n = vectors.agg(F.count(F.lit(1)).alias("n"))
    docs = documents(spark, sf_dir).crossJoin(F.broadcast(n))  # one row
    kind = F.when(F.col("doc_id") % 5 == 0, "function").when(F.col("doc_id") % 5 == 1, "class").otherwise("other")
    chunk = docs.select(
        F.col("doc_id").cast("string").alias("row_id"),
        "doc_id",
        "path",
        (F.col("doc_id") % 90).cast("int").alias("start_line"),
        (F.col("doc_id") % 30 + 1).cast("int").alias("num_lines"),
        kind.alias("chunk_type"),
        (F.col("doc_id") % 11 == 0).alias("is_anchor"),
        (F.col("doc_id") % F.col("n")).alias("vec_id"),
    )
    return chunk.join(vectors.select("vec_id", "embedding"), "vec_id").drop("vec_id")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 100, as stated queries."""
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source file of each document: doc_id, path, text.

    By id a script, Rust or Python, with a type of 1 to 4 methods and a function.
    Words of the document stand in comments and strings, among braces and quotes
    that must not count.
    """
    n, name = (F.col("doc_id") % 4 + 1).cast("int"), F.col("doc_id").cast("string")
    said = F.regexp_replace(F.substring(F.coalesce("text", F.lit("")), 1, 30), "[^A-Za-z]", " ")

    def put(template: str, j=None):
        """``template`` with ID for the id, J for a method's number and W for the words, which come last as they may hold ID, J or W."""
        made = F.replace(F.lit(template), F.lit("ID"), name)
        made = made if j is None else F.replace(made, F.lit("J"), j.cast("string"))
        return F.replace(made, F.lit("W"), said)

    def file(head: str, method: str, tail: str):
        methods = F.transform(F.sequence(F.lit(0), n - 1), lambda j: put(method, j))
        return F.concat_ws("\n", put(head), F.array_join(methods, "\n"), put(tail))

    kind = F.col("doc_id") % 3
    text = F.when(kind == 0, file(*SCRIPT_FILE)).when(kind == 1, file(*RUST_FILE)).otherwise(file(*PYTHON_FILE))
    ending = F.when(kind == 0, ".ts").when(kind == 1, ".rs").otherwise(".py")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("src/f"), name, ending).alias("path"), text.alias("text"))
