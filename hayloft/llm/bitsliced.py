"""Exact top-k inner products by a bit-sliced index.

The index keeps, for a block of rows, one bitmap per attribute and binary
digit.  For a query the bitmaps of its weighted attributes are added with
carry-save adders, bitmap by bitmap, which yields the binary digits of every
row's score as bitmaps again.  The top rows are then chosen from the most
significant slice downward: rows that must be in, rows still equal.  What is
equal at the end is the boundary, resolved exactly by id.

Attributes are shifted to be non-negative; negative digits of weights
use complemented bitmaps.  Both only add a constant to a query's scores, which is taken off at
the end.

Each index block meets each pack of queries once, dealt out over tasks by
(block, copy), where a copy of a block meets at most ``COPY_PACKS`` packs; the best
rows of the blocks are merged per query.

Defined results: vectors that are null, or hold null or non-finite components,
take no part as query or candidate, nor do those with a component of 2**61 and
more after scaling, with which only zeros give a score of 64 bits;
sums may have any number of digits, and a chosen score beyond 64 bits is an error;
shorter vectors count as padded by zeros; rows with a null id are candidates,
and come last among equal scores;
a repeated id is another row (only the query's own row is left out); an empty
table, or one without queries, gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import Scratch

BLOCK_ROWS = 1 << 14
QUERY_BLOCK = 64
COPY_PACKS = 64
SCALE = 64
#: Components are below this after scaling.
LARGEST = 1 << 61
#: Stands for a null id inside the index; the row numbers of such rows begin at NULL_ROWS, above all others.
NULL_ID, NULL_ROWS = (1 << 63) - 1, 1 << 62


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """row, vec_id and q = floor(scale * x) of the vectors that take part."""
    ok = F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok &= F.forall(vector_col, lambda x: F.abs(x.cast("double") * scale) < float(LARGEST))
    q = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    row = F.monotonically_increasing_id() + F.when(F.col(id_col).isNull(), F.lit(NULL_ROWS)).otherwise(F.lit(0))
    return vectors.where(F.coalesce(ok, F.lit(False))).select(row.alias("row"), F.col(id_col).alias("vec_id"), q.alias("q"))


def slices(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(bitmaps[attribute, digit, word], least value by attribute, digits) of integer rows."""
    n, dims = values.shape
    low = values.min(axis=0)
    shifted = (values - low).T.astype(np.uint64)
    digits = max(1, int(shifted.max()).bit_length()) if shifted.size else 1
    words = -(-n // 64)
    out = np.zeros((dims, digits, words * 8), np.uint8)
    for d in range(digits):
        bits = ((shifted >> np.uint64(d)) & np.uint64(1)).astype(np.uint8)
        packed = np.packbits(bits, axis=1, bitorder="little")
        out[:, d, : packed.shape[1]] = packed
    return out.view(np.uint64), low, digits


def add_bitmaps(columns: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The digits, least significant first, of the sums of weighted bitmaps: columns[p] has stacks of weight 2**p."""
    out: list[np.ndarray] = []
    p = 0
    while p < len(columns):
        parts = [c for c in columns[p] if len(c)]
        stack = np.concatenate(parts) if len(parts) > 1 else parts[0] if parts else None
        carries: list[np.ndarray] = []
        while stack is not None and len(stack) > 1:
            n = len(stack) // 3
            if n:
                a, b, c = stack[:n], stack[n : 2 * n], stack[2 * n : 3 * n]
                half = a ^ b
                carry = a & b
                total = half ^ c
                half &= c
                carry |= half
                rest = stack[3 * n :]
                stack = np.concatenate([total, rest]) if len(rest) else total
            else:
                carry = stack[:1] & stack[1:]
                stack = stack[:1] ^ stack[1:]
            carries.append(carry)
        out.append(stack[0] if stack is not None else None)
        if carries:
            if p + 1 == len(columns):
                columns.append([])
            columns[p + 1] += carries
        p += 1
    return out


def signed_digits(query: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """By power of two, the attributes with digit 1 and -1 in the form without neighbouring non-zero digits."""
    out, rest = [], query.astype(np.int64).copy()
    while rest.any():
        odd = (rest & 1) == 1
        digit = np.where(odd, 2 - (rest & 3), 0)
        out.append((np.flatnonzero(digit == 1), np.flatnonzero(digit == -1)))
        rest = (rest - digit) >> 1
    return out


def dims_bits(a: np.ndarray, b: np.ndarray) -> int:
    """Bits that the inner product of two integer vectors has at most."""
    return sum(int(np.abs(x).max(initial=0)).bit_length() for x in (a, b)) + len(a).bit_length()


def score_slices(bitmaps: np.ndarray, inverse: np.ndarray, low: np.ndarray, query: np.ndarray) -> tuple[list[np.ndarray], int]:
    """(digit bitmaps of sums, constant): score = sum + constant."""
    digits = bitmaps.shape[1]
    weights = signed_digits(query)
    columns: list[list[np.ndarray]] = [[] for _ in range(digits + len(weights))]
    # more than 62 bits can only come about where the product of the largest ones has them
    wide = dims_bits(query, low) > 62
    constant = int((query.astype(object) * low.astype(object)).sum()) if wide else int((query * low).sum())
    for b, (plus, minus) in enumerate(weights):
        constant -= len(minus) * ((1 << digits) - 1) << b
        for d in range(digits):
            if len(plus):
                columns[b + d].append(bitmaps[plus, d])
            if len(minus):
                columns[b + d].append(inverse[minus, d])
    return add_bitmaps(columns), constant


def top_rows(sums: list[np.ndarray], eligible: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sure, boundary) bitmaps: at most k sure rows; boundary rows tie for the remaining places."""
    sure, equal = np.zeros_like(eligible), eligible.copy()
    if int(np.bitwise_count(equal).sum()) <= k:
        return equal, sure
    for digit in reversed(sums):
        if digit is None:
            continue
        high = equal & digit
        n = int(np.bitwise_count(sure).sum()) + int(np.bitwise_count(high).sum())
        if n > k:
            equal = high
        else:
            sure |= high
            equal &= ~digit
            if n == k:
                return sure, np.zeros_like(equal)
    return sure, equal


def members(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def values_at(sums: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Sums of rows: 64-bit integers, or Python's where there are more digits."""
    kind = np.int64 if len(sums) <= 62 else object
    out = np.zeros(len(rows), kind)
    for p, digit in enumerate(sums):
        if digit is not None:
            out += ((digit[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)).astype(kind) * (1 << p)
    return out


def search_block(bitmaps: np.ndarray, low: np.ndarray, rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_rows: np.ndarray, k: int):
    """Yields (query position, chosen positions, scores) for a block; ties of the boundary go to smaller ids."""
    words = bitmaps.shape[2]
    everyone = np.zeros(words * 8, np.uint8)
    packed = np.packbits(np.ones(len(rows), np.uint8), bitorder="little")
    everyone[: len(packed)] = packed
    everyone = everyone.view(np.uint64)
    inverse = ~bitmaps
    place = {int(r): i for i, r in enumerate(rows)}
    for n, query in enumerate(queries):
        eligible = everyone
        own = place.get(int(query_rows[n]))
        if own is not None:
            eligible = everyone.copy()
            eligible[own >> 6] &= ~(np.uint64(1) << np.uint64(own & 63))
        sums, constant = score_slices(bitmaps, inverse, low, query)
        sure, boundary = top_rows(sums, eligible, k)
        chosen, ties = members(sure), members(boundary)
        if len(ties):
            ties = ties[np.lexsort((rows[ties], ids[ties]))][: k - len(chosen)]
        chosen = np.concatenate([chosen, ties])
        values = values_at(sums, chosen)
        if values.dtype == object or abs(constant) >= 1 << 62:
            exact = [int(v) + constant for v in values]
            if any(abs(v) >= 1 << 63 for v in exact):
                raise OverflowError("a score among the best leaves 64 bits")
            yield n, chosen, np.array(exact, np.int64)
        else:
            yield n, chosen, values + constant


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of lists as a matrix, padded by zeros."""
    values, length = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if (length == dims).all():
        return values.reshape(-1, dims).astype(np.int64)
    out = np.zeros((len(length), dims), np.int64)
    out[np.arange(dims) < length[:, None]] = values
    return out


def _ids(column) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NULL_ID).to_numpy().astype(np.int64)


def build_index(rows: DataFrame, blocks: int, dims: int) -> DataFrame:
    """One row per block of about ``BLOCK_ROWS`` rows, numbered from 0 and chosen by a hash: bitmaps and the rows they stand for."""

    def run(table: pa.Table) -> pa.Table:
        whole = table.combine_chunks()
        bitmaps, low, digits = slices(_matrix(whole.column("q").chunk(0), dims))
        rows, ids = whole.column("row").to_numpy().astype(np.int64), _ids(whole.column("vec_id"))
        binary = [pa.array([x.tobytes()], pa.binary()) for x in (bitmaps, low, rows, ids)]
        return pa.table([whole.column("block").slice(0, 1), *binary, pa.array([digits], pa.int32())], names=["block", "bitmaps", "low", "rows", "ids", "digits"])

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    return dealt.groupBy("block").applyInArrow(run, "block long, bitmaps binary, low binary, rows binary, ids binary, digits int")


def pack_queries(rows: DataFrame, dims: int, parts: int) -> DataFrame:
    """Queries in packs of up to QUERY_BLOCK."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, QUERY_BLOCK):
                part = batch.slice(a, QUERY_BLOCK)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_matrix(part.column("q"), dims).tobytes()], pa.binary()), pa.array([part.column("row").to_numpy().tobytes()], pa.binary()), pa.array([_ids(part.column("vec_id")).tobytes()], pa.binary())],
                    names=["queries", "query_rows", "query_ids"],
                )

    return rows.repartition(parts).mapInArrow(run, "queries binary, query_rows binary, query_ids binary")


def top_k(vectors: DataFrame, is_query: F.Column, k: int = 20, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each row that ``is_query`` holds for."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = scratch.write(quantised(vectors, scale=scale), "quantised")
    facts = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("q")), F.lit(0)).alias("dims"), F.count_if(is_query).alias("queries")).first()
    if not facts.dims or not facts.queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims, n_blocks, n_packs = facts.dims, math.ceil(facts.n / BLOCK_ROWS), math.ceil(facts.queries / QUERY_BLOCK)
    copies = max(math.ceil(2 * spark.sparkContext.defaultParallelism / n_blocks), math.ceil(n_packs / COPY_PACKS))
    index = scratch.write(build_index(rows, n_blocks, dims), "index")
    packs = scratch.write(pack_queries(rows.where(is_query), dims, max(1, min(n_packs, 1000))), "queries")
    copied = index.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    dealt = packs.withColumn("copy", F.pmod(F.xxhash64("query_rows"), F.lit(copies)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))

    def run(block: pa.Table, packs: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(5)]
        if block.num_rows and packs.num_rows:
            get = lambda table, c, r=0: np.frombuffer(table.column(c)[r].as_py(), np.int64)
            low, rows, ids = (get(block, c) for c in ("low", "rows", "ids"))
            bitmaps = get(block, "bitmaps").view(np.uint64).reshape(dims, block.column("digits")[0].as_py(), -1)
            queries, query_rows, query_ids = (np.concatenate([get(packs, c, r) for r in range(packs.num_rows)]) for c in ("queries", "query_rows", "query_ids"))
            for n, chosen, scores in search_block(bitmaps, low, rows, ids, queries.reshape(-1, dims), query_rows, k):
                same = np.ones(len(chosen), np.int64)
                for column, x in zip(out, (query_rows[n] * same, query_ids[n] * same, rows[chosen], ids[chosen], scores), strict=True):
                    column.append(x)
        return pa.table([pa.array(np.concatenate(c)) for c in out], names=["query_row", "query_id", "row", "vec_id", "score"])

    # a group is one copy of a block and its share of the packs, both bounded
    found = copied.groupBy("block", "copy").cogroup(dealt.groupBy("block", "copy")).applyInArrow(run, "query_row long, query_id long, row long, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    known = lambda c, row: F.when(F.col(row) < NULL_ROWS, F.col(c)).alias(c)
    return best.select(known("query_id", "query_row"), "rank", known("vec_id", "row"), "score")


def op4_topk_bitsliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows for every row whose vec_id is divisible by 20."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 20 == 0)


ORACLE_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY rank <= 20
"""
