"""Token counts of flat token files by a separator scan.

A flat token file is a run of fixed-width little-endian token ids in which an
end-of-document id follows every document; there is no index.  Files are cut
into blocks.  Each block is searched for the separator at once; a prefix scan
over the blocks' few numbers (separators, tokens after the last one) then
tells each block how many documents and how many tokens of an unfinished
document precede it, which stitches documents that cross block edges.

Spark lists the files; blocks, as byte ranges, are what is dealt out, so a file
of any size is read by many tasks.  Where a file system has no Arrow reader
(``RANGED``), whole files come through Spark's binary reader instead and must fit
a row.  The prefix scan goes in two levels over the blocks' few numbers, so that
one huge file's blocks are no hot key either.

Defined results: an empty file has no documents; an empty document counts 0
tokens; tokens after a file's last separator are an unfinished document,
returned with ``complete`` false; bytes that don't fill a token at a file's end
are ignored (the writer ends each file with one).
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import shared_folder, small_batches, string_buffers, written

BLOCK_TOKENS = 1 << 18
FILE_BYTES = 4 << 20
SEPARATOR = 50256
#: Schemes whose files are read by byte ranges.
RANGED = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs", "abfss": "abfss"}
#: Blocks that share a task's open file, and a window of the prefix scan.
NEIGHBOURS, STRETCH = 16, 4096


@lru_cache(maxsize=2)
def encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def token_width(ids: int) -> int:
    """Bytes of a token where ``ids`` numbers, from 0, must have room."""
    return 2 if ids <= 1 << 16 else 4


def _runs(batches, file_bytes: int, text_col: str):
    """Cuts a partition's rows into files: (file number, batch, first row, last row), by text bytes alone.

    Tokens never outnumber the bytes of a text, so a file has at most
    ``file_bytes`` tokens and those of one document more.
    """
    number, held = 0, 0
    for batch in batches:
        _, offsets = string_buffers(batch.column(text_col))
        first = 0
        for r in range(batch.num_rows):
            size = int(offsets[r + 1] - offsets[r]) + 1
            if held and held + size > file_bytes:
                if r > first:
                    yield number, batch, first, r
                number, held, first = number + 1, 0, r
            held += size
        if batch.num_rows > first:
            yield number, batch, first, batch.num_rows


def write_token_files(docs: DataFrame, path: str, ranks: str | None = None, file_bytes: int = FILE_BYTES, text_col: str = "text", id_col: str | None = None) -> int:
    """Encodes whole texts into flat files of ids below ``path``, one per ``part=P/file=N`` folder.

    Ids have 16 bits, or 32 if the vocabulary needs them (``token_width``).  P is the input partition and N counts its files.  Spark's text writer puts
    a row's bytes as they are, and one line break at the file's end.

    With ``id_col``, those folders stand below ``kind=tokens``, and below
    ``kind=order`` the same task writes each row's ordinal and id, which
    ``saved_order`` reads.  Both come from one evaluation of ``docs``, so they
    agree even if another job would split the table otherwise.  Returns the
    width of an id in bytes.
    """
    ranks = ranks or default_ranks()
    width = token_width(max(SEPARATOR, encoder(ranks).max_token_value) + 1)
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType if id_col else T.LongType()
    schema = T.StructType([T.StructField("file", T.IntegerType()), T.StructField("tokens", T.BinaryType()), T.StructField("ordinal", T.LongType()), T.StructField("id", id_type)])

    def run(batches):
        e, number, parts = encoder(ranks), None, []

        def whole(ids: pa.DataType):
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([b"".join(parts)], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, ids)], names=schema.names)

        ids = pa.int64()
        for n, batch, first, last in _runs(batches, file_bytes, text_col):
            ids = batch.column(id_col).type if id_col else ids
            if number is not None and n != number:
                yield whole(ids)
                parts = []
            number, k, before = n, last - first, len(parts)
            for text in batch.column(text_col).slice(first, k).to_pylist():
                parts.append(np.array([*e.encode_ordinary(text or ""), SEPARATOR], f"<u{width}").tobytes())
            if id_col:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, n), pa.int32()), pa.nulls(k, pa.binary()), pa.array(np.arange(before, before + k), pa.int64()), batch.column(id_col).slice(first, k)], names=schema.names)
        if parts:
            yield whole(ids)

    made = docs.select(*dict.fromkeys([text_col, *([id_col] if id_col else [])])).mapInArrow(run, schema)
    tokens, place = F.col("tokens").cast("string"), F.to_json(F.struct("ordinal", "id"))
    value, kind = F.when(F.col("tokens").isNull(), place).otherwise(tokens), F.when(F.col("tokens").isNull(), "order").otherwise("tokens")
    rows = made.select(value.alias("value"), kind.alias("kind"), F.spark_partition_id().alias("part"), "file")
    folders = ["kind", "part", "file"] if id_col else ["part", "file"]
    rows.select("value", *folders).write.partitionBy(*folders).option("lineSep", "\n").text(path)
    return width


def saved_order(spark: SparkSession, path: str, id_type: T.DataType, id_col: str = "doc_id") -> DataFrame:
    """part, file, ordinal and id of every row, as ``write_token_files`` has written them beside the tokens."""
    schema = T.StructType([T.StructField("ordinal", T.LongType()), T.StructField("id", id_type), T.StructField("kind", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("file", T.IntegerType())])
    rows = spark.read.schema(schema).json(path).where(F.col("kind") == "order")
    return rows.select("part", "file", "ordinal", F.col("id").alias(id_col))


def token_blocks(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS, width: int = 2, only: str = "") -> DataFrame:
    """file path, block number and bytes of every block of the token files below ``path`` (of those whose path contains ``only``)."""
    size = block_tokens * width
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where((F.col("length") >= width) & F.contains("path", F.lit(only)))
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size))).alias("block")
    if path.partition(":")[0] not in RANGED:
        return files.select("path", "content", numbers).select("path", "block", F.substring("content", (F.col("block") * size + 1).cast("int"), F.lit(size)).alias("bytes"))
    # names and sizes only: contents are not read here
    ranges = files.select("path", "length", numbers).repartition("path", F.floor(F.col("block") / NEIGHBOURS))

    def run(batches):
        from urllib.parse import unquote

        from pyarrow import fs

        name = file = None
        for batch in batches:
            for k in range(batch.num_rows):
                address, length, block = (batch.column(c)[k].as_py() for c in ("path", "length", "block"))
                if address != name:
                    scheme, _, rest = address.partition(":")
                    system, place = (fs.LocalFileSystem(), "/" + unquote(rest).lstrip("/")) if scheme == "file" else fs.FileSystem.from_uri(f"{RANGED[scheme]}:{rest}")
                    name, file = address, system.open_input_file(place)
                raw = file.read_at(min(size, length - block * size), block * size)
                yield pa.RecordBatch.from_arrays([pa.array([address]), pa.array([block], pa.int64()), pa.array([raw], pa.binary())], names=["path", "block", "bytes"])

    return ranges.mapInArrow(run, "path string, block long, bytes binary")


def scan_blocks(blocks: DataFrame, separator: int = SEPARATOR, width: int = 2) -> DataFrame:
    """For each block: tokens, separators, and their places in it."""

    def run(batches):
        for batch in batches:
            found, tokens = [], []
            for raw in batch.column("bytes"):
                raw = raw.as_py()
                ids = np.frombuffer(raw[: len(raw) // width * width], f"<u{width}")
                found.append(np.flatnonzero(ids == separator))
                tokens.append(len(ids))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])])
            places = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*found, np.zeros(0, np.int64)]), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("block"), pa.array(tokens, pa.int64()), places], names=["path", "block", "tokens", "places"])

    return blocks.mapInArrow(run, "path string, block long, tokens long, places array<long>")


def block_offsets(scanned: DataFrame) -> DataFrame:
    """path, block, and what precedes it in its file: from (tokens), documents (separators), open (place after the last separator).

    A prefix scan over one small row per block: inside stretches of ``STRETCH``
    blocks, then over the stretches of a file.
    """
    n = F.size("places").cast("long")
    facts = scanned.select("path", "block", F.floor(F.col("block") / STRETCH).alias("stretch"), "tokens", n.alias("n"), F.when(n > 0, F.element_at("places", -1)).alias("last"))
    inside = Window.partitionBy("path", "stretch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    own = facts.withColumn("from", F.coalesce(F.sum("tokens").over(inside), zero)).withColumn("documents", F.coalesce(F.sum("n").over(inside), zero))
    own = own.withColumn("last", F.col("from") + F.col("last")).withColumn("before", F.last("last", ignorenulls=True).over(inside))
    outside = Window.partitionBy("path").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    whole = own.groupBy("path", "stretch").agg(F.sum("tokens").alias("tokens"), F.sum("n").alias("n"), F.max("last").alias("last"))
    whole = whole.withColumn("from_0", F.coalesce(F.sum("tokens").over(outside), zero)).withColumn("documents_0", F.coalesce(F.sum("n").over(outside), zero))
    whole = whole.withColumn("before_0", F.last(F.col("from_0") + F.col("last"), ignorenulls=True).over(outside)).select("path", "stretch", "from_0", "documents_0", "before_0")
    both = own.join(whole, ["path", "stretch"])
    open_ = F.coalesce(F.col("from_0") + F.col("before"), F.col("before_0"), F.lit(-1)) + 1
    return both.select("path", "block", (F.col("from_0") + F.col("from")).alias("from"), (F.col("documents_0") + F.col("documents")).alias("documents"), open_.alias("open"))


def document_lengths(scanned: DataFrame) -> DataFrame:
    """path, ordinal in the file, first token and n_tokens of each document, from scanned blocks (a written table)."""
    n = F.size("places")
    own = scanned.join(block_offsets(scanned), ["path", "block"])
    ends = F.transform("places", lambda p: p + F.col("from"))
    starts = F.concat(F.array(F.col("open")), F.transform(ends, lambda p: p + 1))
    whole = own.select(
        "path",
        F.explode(F.transform(F.arrays_zip(F.slice(starts, 1, n).alias("start"), ends.alias("end")), lambda x, i: F.struct((F.col("documents") + i).alias("ordinal"), x["start"].alias("start"), x["end"].alias("end")))).alias("d"),
    ).select("path", "d.ordinal", F.col("d.start").alias("first_token"), (F.col("d.end") - F.col("d.start")).alias("n_tokens"), F.lit(True).alias("complete"))
    last = own.select("path", (F.col("from") + F.col("tokens")).alias("tokens"), F.when(n > 0, F.col("from") + F.element_at("places", -1) + 1).otherwise(F.col("open")).alias("start"), (F.col("documents") + n).alias("ordinal"))
    tail = last.groupBy("path").agg(F.max("tokens").alias("tokens"), F.max("start").alias("start"), F.max("ordinal").alias("ordinal"))
    unfinished = tail.where(F.col("tokens") > F.col("start")).select("path", "ordinal", F.col("start").alias("first_token"), (F.col("tokens") - F.col("start")).alias("n_tokens"), F.lit(False).alias("complete"))
    return whole.unionByName(unfinished)


def count_tokens(spark: SparkSession, path: str, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS, width: int = 2, only: str = "") -> DataFrame:
    """Documents and their token counts of all flat token files below ``path`` (of those whose path contains ``only``)."""
    return document_lengths(written(spark, scan_blocks(token_blocks(spark, path, block_tokens, width, only), separator, width), "scanned"))


def placed_counts(order: DataFrame, found: DataFrame) -> DataFrame:
    """Joins the counts of whole documents to ``saved_order``; a row without its counterpart is an error."""
    place = found.select(
        F.regexp_extract("path", r"part=(\d+)/file=(\d+)/", 1).cast("int").alias("part"),
        F.regexp_extract("path", r"part=(\d+)/file=(\d+)/", 2).cast("int").alias("file"),
        "ordinal", "first_token", "n_tokens",
    )
    both = order.withColumn("_placed", F.lit(True)).join(place, ["part", "file", "ordinal"], "full")
    lost = F.col("_placed").isNull() | F.col("n_tokens").isNull()
    return both.withColumn("n_tokens", F.when(lost, F.raise_error(F.lit("documents and token files do not agree")).cast("long")).otherwise(F.col("n_tokens"))).drop("_placed")


def op8_token_count_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document, read from flat files made of the whole table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = shared_folder(spark) + "/tokens"
    width = write_token_files(docs, path, id_col="doc_id")
    found = count_tokens(spark, path, width=width, only="/kind=tokens/")
    counted = placed_counts(saved_order(spark, path, docs.schema["doc_id"].dataType), found)
    return counted.select("doc_id", "n_tokens", "part", "file", "ordinal", "first_token")
