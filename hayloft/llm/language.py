"""Language identification by error-correcting output codes.

Each language has a codeword.  One binary byte-trigram classifier for each bit
weighs how much likelier a trigram is under the languages whose bit is 1 than
under the others; it is fitted from trigram counts of all training documents,
summed by Spark.  Decoding takes the codeword of least loss, where a bit's loss
counts by how well its classifier separates.  If the runner-up is nearly as
good, the document is flagged ambiguous.

Defined results: ``und`` with score 0 for a null text, a text without a letter,
or when no document has a language to learn; whole texts count, of any length;
equal texts get equal answers; languages beyond the most frequent ones are not
learned; columns named like a result are replaced; the columns lang, source and doc_id are never
inputs of a prediction.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import LOWER, WORD, Block, blocks, small_batches

BUCKET_BITS = 14
AMBIGUOUS = 0.15


def trigrams(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(position, bucket) of every byte trigram inside a row, after lowering and with spaces for all but letters."""
    low = LOWER[block.data]
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # capitals of the Latin-1 letters: C3 80-9E stand 32 below their small forms
    accented = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)) + 1
    low[accented] += 32
    low[~WORD[low] | ((low >= 48) & (low <= 57))] = 32
    x = low.astype(np.uint32)
    bucket = (((x[:-2] << 16) | (x[1:-1] << 8) | x[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)
    keep = ((low[:-2] != 32) | (low[1:-1] != 32)) & ((low[1:-1] != 32) | (low[2:] != 32))
    edge = block.offsets[1:-1]
    for back in (1, 2):
        at = edge - back
        keep[at[(at >= 0) & (at < len(keep))]] = False
    at = np.flatnonzero(keep)
    return at, bucket[at].astype(np.int64)


def has_letter(block: Block) -> np.ndarray:
    """Whether each row has a letter of any script."""
    low = LOWER[block.data]
    total = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122))])
    out = total[block.offsets[1:]] > total[block.offsets[:-1]]
    for k in np.flatnonzero(~out):
        text = block.data[block.offsets[k] : block.offsets[k + 1]].tobytes()
        out[k] = any(c.isalpha() for c in text.decode("utf-8", "replace"))
    return out


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of +-1: all splits of up to 5 languages, else the best of many random codes."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        return np.array([[1, *bits] for bits in itertools.product([1, -1], repeat=n - 1) if -1 in bits]).T.astype(float)
    rng, bits = np.random.default_rng(seed), max(15, 6 * int(np.ceil(np.log2(n))))
    best, apart = None, -1
    for _ in range(300):
        code = rng.choice([-1.0, 1.0], (n, bits))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        gap = (code.shape[1] - (code @ code.T - 2 * code.shape[1] * np.eye(n)).max()) / 2
        if gap > apart:
            best, apart = code, gap
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weight: np.ndarray  # buckets x bits
    trust: np.ndarray  # by bit, sums to 1

    def decide(self, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, score, ambiguous) from bit margins of each row."""
        loss = np.stack([(np.logaddexp(0, -margin * c) * self.trust).sum(axis=1) for c in self.code], axis=1)
        chance = np.exp(-4 * (loss - loss.min(axis=1, keepdims=True)))
        chance /= chance.sum(axis=1, keepdims=True)
        ranked = np.sort(chance, axis=1)
        second = ranked[:, -2] if ranked.shape[1] > 1 else np.zeros(len(ranked))
        return loss.argmin(axis=1), ranked[:, -1], ranked[:, -1] - second < AMBIGUOUS


def language_counts(training: DataFrame, languages: list[str], text_col: str = "text", label_col: str = "lang") -> np.ndarray:
    """Trigram counts by language over all training documents; the driver gets at most languages x buckets sums."""
    number = {v: k for k, v in enumerate(languages)}

    def count(batches):
        total = np.zeros(len(languages) << BUCKET_BITS, np.int64)
        for batch in batches:
            label = np.array([number.get(v, -1) for v in batch.column(label_col).to_pylist()], np.int64)
            for block in blocks(batch.column(text_col)):
                at, bucket = trigrams(block)
                row = np.repeat(label[block.first : block.last], np.diff(block.offsets))
                known = row[at] >= 0
                total += np.bincount((row[at[known]] << BUCKET_BITS) + bucket[known], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["k", "n"])

    out = np.zeros(len(languages) << BUCKET_BITS, np.int64)
    for r in training.select(label_col, text_col).mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.k] = r.n
    return out.reshape(len(languages), -1)


def fit(training: DataFrame, text_col: str = "text", label_col: str = "lang", max_languages: int = 500) -> Model:
    """Learns the ``max_languages`` most frequent languages (ties: in order); rows of others count as unlabelled."""
    training = training.where(F.col(label_col).isNotNull())
    small_batches(training.sparkSession)
    found = training.groupBy(label_col).count().orderBy(F.desc("count"), label_col).limit(max_languages).collect()
    languages = sorted(r[0] for r in found)
    code = codewords(len(languages))
    counts = language_counts(training, languages, text_col, label_col) + 0.05 if languages else np.ones((0, 1 << BUCKET_BITS))
    share = counts / counts.sum(axis=1, keepdims=True)
    weight, trust = np.zeros((1 << BUCKET_BITS, code.shape[1] if len(languages) else 0)), []
    for b in range(weight.shape[1]):
        if len(languages) < 2:
            trust.append(1.0)
            continue
        yes, no = share[code[:, b] > 0].mean(axis=0), share[code[:, b] < 0].mean(axis=0)
        weight[:, b] = np.log(yes) - np.log(no)
        trust.append(float(((yes - no) * weight[:, b]).sum()))
    trust = np.array(trust)
    return Model(languages, code, weight, trust / trust.sum() if len(trust) else trust)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Columns of ``docs`` and lang_pred, score (0 to 1), ambiguous."""
    own = ["lang_pred", "score", "ambiguous"]
    rest = docs.drop(*own)
    schema = T.StructType([*rest.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    # one row of weights per bucket, whatever the corpus
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        names = np.array([*m.languages, "und"], object)
        for batch in batches:
            out: list[list] = [[], [], []]
            for block in blocks(batch.column(text_col)):
                known = has_letter(block) if m.languages else np.zeros(block.rows, bool)
                at, bucket = trigrams(block)
                ends = np.searchsorted(at, block.offsets)
                n = np.maximum(np.diff(ends), 1)
                margin = np.empty((block.rows, m.weight.shape[1]))
                for b in range(margin.shape[1]):
                    total = np.concatenate([[0.0], np.cumsum(m.weight[:, b][bucket])])
                    margin[:, b] = np.diff(total[ends])
                # evidence grows with the root of the length: neighbouring trigrams are not independent
                margin /= np.sqrt(n)[:, None]
                best, score, unsure = m.decide(margin) if m.languages else (np.full(block.rows, -1), np.zeros(block.rows), np.ones(block.rows, bool))
                out[0] += names[np.where(known, best, len(m.languages))].tolist()
                out[1] += np.where(known, score, 0.0).tolist()
                out[2] += (unsure | ~known).tolist()
            if out[0]:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.bool_())], names=[*batch.schema.names, *own])

    return rest.mapInArrow(run, schema)


def held_out(modulus: int, remainder: int, id_col: str = "doc_id") -> F.Column:
    """Whether a document is kept from learning; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def identify_languages(docs: DataFrame) -> DataFrame:
    """Fits on the documents that aren't held out and predicts all."""
    training = docs.where(~held_out(4, 2) & F.col("doc_id").isNotNull()).select("lang", "text")
    return predict(docs, fit(training))


def op6_language_ecoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out(4, 2) & F.col("doc_id").isNotNull()).select("lang", "text"))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "ambiguous")
