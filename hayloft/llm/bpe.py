"""Byte-pair encoding by a segment tree over the ranks of adjacent pairs.

For each piece of text a segment tree holds the merge rank of every adjacent
pair of symbols at its leaves and the least (rank, position) at each inner
node.  The root therefore names the leftmost pair of lowest rank; merging it
changes three leaves, each updated along one path in logarithmic time, until
the root shows that no pair can merge.  Many pieces of like width are encoded
together: one numpy step advances all their trees.  A few, such as one very long
unspaced run, have their trees in plain lists, one after the other.

Distinct pieces are encoded once per worker and kept in a cache of bounded
bytes; a full cache is dropped and refilled, which changes nothing but time.

Defined results: a null text is empty; an empty text has no tokens; texts of
any length are encoded whole; strings of special tokens inside a text become
those tokens, as the tokenizers library does; repeated rows are encoded alike;
other columns are passed through or ignored.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .blocks import small_batches

NO_RANK = np.int64(1) << 60
#: Bytes of pieces and ids that a worker's cache holds; longer pieces are not kept.
CACHE_BYTES, CACHED_PIECE = 32 << 20, 256
#: Fewer pieces of a width than this are merged one by one.
LOCKSTEP = 24
#: Leaves that one numpy step holds at most (or one long piece).
STEP_LEAVES = 1 << 19
#: White space in the sense of Unicode.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A vocabulary file with word ends (``</w>``), lower-casing and dropped white space."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        suffix = spec["model"]["end_of_word_suffix"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*vocab.values(), *self.specials.values()]))
        for token, i in [*vocab.items(), *self.specials.items()]:
            self.tokens[i] = token
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + suffix] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        into = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = (left << 32) | right
        order = np.argsort(key, kind="stable")
        self.pair_key, self.pair_rank, self.pair_into = key[order], order.astype(np.int64), into[order]
        self.by_rank = into.tolist()
        self.rank_of = dict(zip(key.tolist(), range(len(key)), strict=True))
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) or r"(?!)")
        self.piece_pattern = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
        self.cache: dict[str, bytes] = {}
        self.cached = 0

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols; NO_RANK where a pair doesn't merge or a side is missing (-1)."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where((self.pair_key[at] == key) & (left >= 0) & (right >= 0), self.pair_rank[at], NO_RANK)

    def encode_pieces(self, pieces: list[str]) -> list[np.ndarray]:
        """Token ids of each piece."""
        raw = [p.encode() for p in pieces]
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(raw)
        by_width: dict[int, list[int]] = {}
        for k, b in enumerate(raw):
            if len(b) == 1:
                out[k] = self.final[[b[0]]]
            elif b:
                by_width.setdefault(max(2, 1 << (len(b) - 2).bit_length()) if len(b) > 2 else 1, []).append(k)
        for width, members in by_width.items():
            if len(members) < LOCKSTEP:
                for k in members:
                    out[k] = self._merge_one(raw[k], width)
                continue
            step = max(1, STEP_LEAVES // width)
            for i in range(0, len(members), step):
                self._merge([raw[k] for k in members[i : i + step]], width, out, members[i : i + step])
        return out

    def _merge_one(self, raw: bytes, width: int) -> np.ndarray:
        """Runs the segment tree of one piece with 2 to ``width`` + 1 bytes."""
        n, none = len(raw), int(NO_RANK)
        first = np.append(self.inner[np.frombuffer(raw, np.uint8)[:-1]], self.final[raw[-1]])
        shift = max(1, width.bit_length())
        place = (1 << shift) - 1
        rank = self.pair_ranks(first[:-1], first[1:])
        tree = np.full(2 * width, none, np.int64)
        tree[width : width + n - 1] = np.where(rank < NO_RANK, (rank << shift) | np.arange(n - 1), none)
        level = width
        while level > 1:
            tree[level // 2 : level] = np.minimum(tree[level : 2 * level : 2], tree[level + 1 : 2 * level : 2])
            level //= 2
        tree, symbol = tree.tolist(), first.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        by_rank, ranks = self.by_rank, self.rank_of

        def put(leaf: int) -> None:
            beyond = after[leaf]
            r = ranks.get((symbol[leaf] << 32) | symbol[beyond]) if beyond < n and symbol[leaf] >= 0 else None
            node = leaf + width
            tree[node] = none if r is None else (r << shift) | leaf
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                least = a if a < b else b
                if tree[node] == least:
                    break
                tree[node] = least

        while tree[1] < none:
            best = tree[1]
            at = best & place
            gone = after[at]
            symbol[at], symbol[gone] = by_rank[best >> shift], -1
            after[at] = beyond = after[gone]
            if beyond < n:
                before[beyond] = at
            if gone < width:
                put(gone)
            put(at)
            if before[at] >= 0:
                put(before[at])
        return np.array([x for x in symbol if x >= 0], np.int64)

    def _merge(self, raw: list[bytes], width: int, out: list[np.ndarray], names: list[int]) -> None:
        """Runs the segment trees of pieces with 2 to ``width`` + 1 bytes."""
        n, columns = len(raw), width + 1
        size = np.array([len(b) for b in raw])
        symbol = np.full((n, columns + 1), -1, np.int64)  # the last column stays -1: "no symbol here"
        flat = np.frombuffer(b"".join(raw), np.uint8)
        inside = np.arange(columns) < size[:, None]
        symbol[:, :columns][inside] = self.inner[flat]
        every = np.arange(n)
        ends = np.cumsum(size) - 1
        symbol[every, size - 1] = self.final[flat[ends]]
        after = np.tile(np.arange(1, columns + 2), (n, 1))
        after[:, columns] = columns
        after[every, size - 1] = columns
        before = np.tile(np.arange(-1, columns), (n, 1))
        before[:, 0] = columns
        # leaf i holds the pair that starts at symbol i: rank and position in one number
        tree = np.full((n, 2 * width), NO_RANK << 1, np.int64)
        rank = self.pair_ranks(symbol[:, :width].ravel(), symbol[:, 1:columns].ravel()).reshape(n, width)
        place = np.arange(width)
        shift = max(1, width.bit_length())
        tree[:, width:] = np.where(rank < NO_RANK, (rank << shift) | place, NO_RANK << 1)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2

        def put(rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            node = leaf + width
            tree[rows, node] = value
            node = node >> 1
            for _ in range(width.bit_length() - 1):
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                node = node >> 1

        def leaf_value(rows: np.ndarray, leaf: np.ndarray) -> np.ndarray:
            r = self.pair_ranks(symbol[rows, leaf], symbol[rows, after[rows, leaf]])
            return np.where(r < NO_RANK, (r << shift) | leaf, NO_RANK << 1)

        root = 1
        rows = np.flatnonzero(tree[:, root] < NO_RANK)
        by_rank = np.empty(len(self.pair_rank), np.int64)
        by_rank[self.pair_rank] = self.pair_into
        while len(rows):
            best = tree[rows, root]
            at = best & ((1 << shift) - 1)
            gone = after[rows, at]
            symbol[rows, at] = by_rank[best >> shift]
            symbol[rows, gone] = -1
            beyond = after[rows, gone]
            after[rows, at] = beyond
            before[rows, beyond] = at
            paired = gone < width
            put(rows[paired], gone[paired], np.full(int(paired.sum()), NO_RANK << 1))
            put(rows, at, leaf_value(rows, at))
            prior = before[rows, at]
            some = prior < columns
            put(rows[some], prior[some], leaf_value(rows[some], prior[some]))
            rows = rows[tree[rows, root] < NO_RANK]
        left = symbol[:, :columns]
        kept = left >= 0
        ids, count = left[kept], np.cumsum(kept.sum(axis=1))
        for k, name in enumerate(names):
            out[name] = ids[count[k - 1] if k else 0 : count[k]]

    def pieces(self, text: str) -> list[str]:
        """The normalised pieces of a stretch without special tokens."""
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return self.piece_pattern.findall(text.replace("Σ", "σ").lower())

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of the given pieces; those that the cache doesn't have are encoded."""
        known = {p: self.cache[p] for p in pieces if p in self.cache}
        new = [p for p in pieces if p not in known]
        for p, ids in zip(new, self.encode_pieces(new), strict=True):
            known[p] = ids.astype("<u4").tobytes()
            if len(p) <= CACHED_PIECE:
                size = 200 + 4 * len(p) + len(known[p])
                if self.cached + size > CACHE_BYTES:
                    self.cache, self.cached = {}, 0
                self.cache[p] = known[p]
                self.cached += size
        return known

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Token ids of whole texts as little-endian unsigned 32-bit numbers."""
        split: list[list] = []
        for text in texts:
            parts, at = [], 0
            for m in self.special_pattern.finditer(text):
                parts += [self.pieces(text[at : m.start()]), m[0]]
                at = m.end()
            split.append([*parts, self.pieces(text[at:] if at else text)])
        get = self.learn({p for parts in split for part in parts if isinstance(part, list) for p in part}).__getitem__
        return [b"".join(b"".join(map(get, part)) if isinstance(part, list) else int(self.specials[part]).to_bytes(4, "little") for part in parts) for parts in split]

    def decode(self, ids: bytes) -> str:
        """Tokens joined by spaces: this vocabulary has no decoder of its own."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def loaded(path: str) -> WordBpe:
    """One vocabulary per worker."""
    return WordBpe(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def texts_of(column: pa.Array, size: int = 1 << 18) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) in runs of about ``size`` characters; null as empty."""
    run, first, held = [], 0, 0
    for k, value in enumerate(column):
        text = value.as_py() or ""
        run.append(text)
        held += len(text)
        if held >= size:
            yield first, run
            run, first, held = [], k + 1, 0
    if run:
        yield first, run


def encode_documents(docs: DataFrame, vocabulary: str | None = None, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``token_ids`` (binary, little-endian unsigned 32-bit), ``n_tokens``, ``decoded``.

    A column of ``docs`` with one of these names is replaced.
    """
    from pyspark.sql import types as T

    path = vocabulary or default_vocabulary()
    small_batches(docs.sparkSession)
    own = ["token_ids", "n_tokens", "decoded"]
    docs = docs.drop(*own)
    schema = T.StructType([*docs.schema.fields, T.StructField("token_ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())])

    def run(batches):
        bpe = loaded(path)
        for batch in batches:
            for first, texts in texts_of(batch.column(text_col)):
                part = batch.slice(first, len(texts))
                ids = bpe.encode_batch(texts)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([bpe.decode(x) for x in ids], pa.string())],
                    names=[*part.schema.names, *own],
                )

    return docs.mapInArrow(run, schema)


def op9_bpe_segment_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the encoding and decoding of every whole document."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_documents(docs).select(
        "doc_id",
        "n_tokens",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
