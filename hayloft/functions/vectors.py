"""Vector kernels over array columns, all in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product over the common length."""
    n = F.least(F.size(a), F.size(b))
    both = F.zip_with(F.slice(_doubles(a), 1, n), F.slice(_doubles(b), 1, n), lambda x, y: x * y)
    return F.aggregate(both, F.lit(0.0), lambda s, x: s + x)


def l2_normalised(v: Column) -> Column:
    """Unit length; a zero vector is unchanged."""
    norm = F.sqrt(F.aggregate(_doubles(v), F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(_doubles(v), lambda x: F.when(norm > 0, x / norm).otherwise(x))


def finite(v: Column) -> Column:
    """Non-finite components become 0."""
    return F.transform(_doubles(v), lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x))


def max_abs(v: Column) -> Column:
    return F.array_max(F.transform(_doubles(v), F.abs))


def quantisation_scale(v: Column) -> Column:
    """max|x| / 127; 1 for an all-zero or empty vector."""
    m = F.coalesce(max_abs(v), F.lit(0.0))
    return F.when(m > 0, m / 127).otherwise(1.0)


def quantised(v: Column) -> Column:
    """int8 components, truncated toward zero."""
    scale = quantisation_scale(v)
    return F.transform(_doubles(v), lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), x / scale)).cast("int").cast("tinyint"))


def dequantised(q: Column, scale: Column, dim: int) -> Column:
    """Rows of ``dim`` components; all-zero rows and a ragged tail are dropped."""
    rows = F.when(F.floor(F.size(q) / dim) > 0, F.transform(F.sequence(F.lit(0), (F.floor(F.size(q) / dim) - 1).cast("int")), lambda i: F.slice(q, i * dim + 1, F.lit(dim)))).otherwise(F.array())
    live = F.filter(rows, lambda r: F.exists(r, lambda x: x != 0))
    return F.transform(live, lambda r: F.transform(r, lambda x: x * scale))


def max_sim(query: Column, doc: Column) -> Column:
    """Sum over query tokens of the best inner product with a document token; empty gives 0."""
    best = F.transform(query, lambda q: F.coalesce(F.array_max(F.transform(doc, lambda d: dot(q, d))), F.lit(0.0)))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x)


def max_sim_quantised(query: Column, doc: Column, scale: Column) -> Column:
    """The same on int8 document tokens: all-zero tokens are skipped, the scale is applied once."""
    live = F.filter(doc, lambda d: F.exists(d, lambda x: x != 0))
    return max_sim(query, live) * scale


def mean_pool(tokens: Column) -> Column:
    """Component-wise mean of token vectors."""
    first = _doubles(F.element_at(tokens, 1))
    total = F.aggregate(F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), first, lambda s, t: F.zip_with(s, _doubles(t), lambda a, b: a + b))
    return F.transform(total, lambda x: x / F.size(tokens))


def first_pool(tokens: Column) -> Column:
    return F.element_at(tokens, 1)


def length_embedding(text: Column, dim: int) -> Column:
    """A deterministic stand-in for a model: the byte length, then zeros."""
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.when(i == 0, F.octet_length(text).cast("double")).otherwise(0.0))


def length_bucket(length: Column) -> Column:
    return F.ceil(length / 32)
