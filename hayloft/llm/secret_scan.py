"""Secret scan: base patterns and a linear-chain conditional random field.

Base patterns find assignments, access keys and long hex runs.  The field tags
every token as begin, inside or outside of a secret from its shape, the words
and marks before and after it, and features of its file, and adds the spans
that the patterns don't cover.

It learns from a bounded draw of documents (``SAMPLE_DOCUMENTS`` distinct texts),
of which each gives a few short windows of tokens: at a random place, at a base
span, at a token that merely looks unusual, and where a made-up value is planted
into the text.  Planted values differ in alphabet, length, prefix, parts and
surroundings; half of them are harmless look-alikes (dates, addresses, paths,
numbers, names in code).  Windows are cut in Spark tasks, so whole texts never
reach the driver, which trains on at most four windows a document.

Viterbi decoding is exact and cheap: where a token's score for "outside" leads
by more than any change of transitions could make up, the best path must go
through "outside", so only the short runs between such tokens are decoded.

Defined results: a null text is empty and has no spans; offsets count code
points of the whole text; repeated rows get the same spans; other columns are
not inputs, and one named like the result is replaced.  With nothing to learn
from, only base spans are returned.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import LOWER, Block, blocks, range_hash, small_batches

KINDS = ("assign", "access", "hex", "field")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
# fixed values: the base patterns
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")

OUT, BEGIN, INSIDE = 0, 1, 2
WORD_BITS = 13
SAMPLE_DOCUMENTS = 2000

_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), 43, 47, 95, 46, 45]] = True
_TOKEN[128:] = True
_HEX = np.zeros(256, bool)
_HEX[[*range(48, 58), *range(97, 103)]] = True
_CLASS = np.zeros(256, np.int8)  # 0 mark, 1 small, 2 capital, 3 digit, 4 beyond ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4


def base_spans(text: bytes, hex_run: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in bytes, by start, then kind."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if hex_run:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out)


def rows_with_hex_runs(block: Block) -> np.ndarray:
    """Whether a row may hold 24 hex characters in a row."""
    inside = np.concatenate([[False], _HEX[block.data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start = edge[::2][edge[1::2] - edge[::2] >= 24]
    end = edge[1::2][edge[1::2] - edge[::2] >= 24]
    out = np.zeros(block.rows, bool)
    for a, b in zip(np.searchsorted(block.offsets, start, "right") - 1, np.searchsorted(block.offsets, end, "left"), strict=True):
        out[a:b] = True
    return out


@dataclass
class Tokens:
    """Tokens of a block: byte ranges, rows, and feature numbers (tokens x features)."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    features: np.ndarray


#: Numbers of the feature groups: shape, size, digits and changes, three neighbouring words, marks, three of the file.
_GROUPS = (256, 16, 64, 1 << WORD_BITS, 1 << WORD_BITS, 1 << WORD_BITS, 64, 64, 64, 64)
_FIRST = np.concatenate([[0], np.cumsum(_GROUPS)])
FEATURES = int(_FIRST[-1])
FILE_GROUPS = 3


def tokens(block: Block) -> Tokens:
    """Cuts rows into tokens and computes their features."""
    data, offsets = block.data, block.offsets
    inside = _TOKEN[data]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Tokens(none, none, none, np.zeros((0, len(_GROUPS)), np.int64))
    begin, finish = np.empty(n, bool), np.empty(n, bool)
    begin[0], begin[1:] = inside[0], inside[1:] & ~inside[:-1]
    finish[-1], finish[:-1] = inside[-1], inside[:-1] & ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    begin[edge] = inside[edge]
    finish[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    kind = _CLASS[data]

    def count(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(n + 1, np.int32)
        np.cumsum(flags, out=total[1:])
        return total

    def within(total: np.ndarray) -> np.ndarray:
        return total[end] - total[start]

    small, big, digit, beyond = (within(count(kind == c)) for c in (1, 2, 3, 4))
    size = end - start
    change = np.zeros(n, bool)
    # a capital before a small letter is ordinary writing, not a change
    change[1:] = (kind[1:] != kind[:-1]) & ~((kind[:-1] == 2) & (kind[1:] == 1))
    total = count(change)
    changes = total[end] - total[np.minimum(start + 1, end)]
    marks = size - small - big - digit - beyond
    capital_first = (kind[start] == 2) & (big == 1)
    shape = (small > 0) * 1 + (big > 0) * 2 + (digit > 0) * 4 + (marks > 0) * 8 + (beyond > 0) * 16 + (within(count(_HEX[data])) == size) * 32 + capital_first * 64 + (size > 24) * 128
    width = np.minimum(np.searchsorted([2, 3, 4, 6, 8, 10, 12, 16, 20, 24, 28, 32, 40, 64, 128], size, "right"), 15)
    mixed = np.minimum(digit * 8 // np.maximum(size, 1), 7) * 8 + np.minimum(changes * 16 // np.maximum(size, 1), 7)
    word = (range_hash(LOWER[data], start, end) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    nothing = (1 << WORD_BITS) - 1

    def shifted(by: int) -> np.ndarray:
        out = np.full(len(word), nothing)
        if by > 0:
            out[by:] = np.where(row[by:] == row[:-by], word[:-by], nothing)
        else:
            out[:by] = np.where(row[:by] == row[-by:], word[-by:], nothing)
        return out

    gap_start = np.maximum(np.concatenate([[0], end[:-1]]), offsets[row])
    sign, colon, quote, line = (count(np.isin(data, [ord(c) for c in s])) for s in ("=", ":", "\"'`", "\n"))
    gap = sum(((t[start] - t[gap_start]) > 0) * 2**k for k, t in enumerate((sign, colon, quote, line)))
    after = np.minimum(end, n - 1)
    gap = gap + 16 * np.isin(data[after], [34, 39, 96]) + 32 * (data[after] == 61)

    def per_file(total: np.ndarray) -> np.ndarray:
        return total[offsets[1:]] - total[offsets[:-1]]

    def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """A share as one of eight steps, each twice the one before: 1/256 and less to over half."""
        return np.clip(np.log2(np.maximum(part, 1e-9) / np.maximum(whole, 1)) + 8, 0, 7).astype(np.int64)

    length = np.diff(offsets)
    by_row = np.bincount(row, minlength=len(length)) if len(row) else np.zeros(len(length), np.int64)
    code = count(np.isin(data, [ord(c) for c in "{}[]()<>;:=_/\\\"'`#$&|"]))
    file = [
        np.minimum(np.log2(length + 1).astype(np.int64), 15) * 4 + np.minimum(per_file(sign), 3),
        share(per_file(code), length) * 8 + share(per_file(count(kind == 3)), length),
        np.clip(length // np.maximum(by_row, 1) - 2, 0, 7) * 8 + share(np.bincount(row, weights=size > 15, minlength=len(length)), by_row),
    ]
    features = np.stack([shape, width, mixed, shifted(1), shifted(2), shifted(-1), gap, *(f[row] for f in file)], axis=1) + _FIRST[:-1]
    return Tokens(start, end, row, features)


@dataclass
class Field:
    emission: np.ndarray  # features x 3
    transition: np.ndarray  # from x to

    def scores(self, t: Tokens) -> np.ndarray:
        out = np.zeros((len(t.start), 3))
        for k in range(t.features.shape[1]):
            out += self.emission[t.features[:, k]]
        return out

    def tag(self, t: Tokens) -> np.ndarray:
        """The best tags of all tokens, row by row."""
        out = np.zeros(len(t.start), np.int8)
        if not len(out):
            return out
        e, tr = self.scores(t), self.transition
        through = tr[:, :, None] + tr[None, :, :]
        slack = max(float((through - through[:, OUT : OUT + 1, :]).max()), float((tr - tr[:, OUT : OUT + 1]).max()), float((tr - tr[OUT : OUT + 1, :]).max()), 0.0)
        loud = np.flatnonzero(e[:, OUT] - e[:, 1:].max(axis=1) <= slack)
        if not len(loud):
            return out
        cut = np.flatnonzero((np.diff(loud) > 1) | (np.diff(t.row[loud]) > 0)) + 1
        for run in np.split(loud, cut):
            first, last = run[0], run[-1]
            quiet_before = first > 0 and t.row[first - 1] == t.row[first]
            quiet_after = last + 1 < len(out) and t.row[last + 1] == t.row[last]
            best = e[first] + (tr[OUT] if quiet_before else 0)
            back = np.zeros((len(run), 3), np.int8)
            for k in range(1, len(run)):
                step = best[:, None] + tr
                back[k] = step.argmax(axis=0)
                best = step.max(axis=0) + e[run[k]]
            y = int((best + (tr[:, OUT] if quiet_after else 0)).argmax())
            for k in range(len(run) - 1, -1, -1):
                out[run[k]] = y
                y = int(back[k][y])
        return out


def train(features: np.ndarray, tags: np.ndarray, mask: np.ndarray, epochs: int = 50, penalty: float = 2e-3, rate: float = 0.3) -> Field:
    """Maximum likelihood by forward-backward over padded sequences (sequences x steps), with Adagrad steps."""
    n, steps, _ = features.shape
    emission, transition = np.zeros((FEATURES, 3)), np.zeros((3, 3))
    seen_e, seen_t = np.full((FEATURES, 3), 1e-2), np.full((3, 3), 1e-2)
    gold = np.eye(3)[tags] * mask[:, :, None]
    pair_mask = (mask[:, 1:] & mask[:, :-1]).astype(float)
    gold_pairs = np.einsum("nta,ntb,nt->ab", gold[:, :-1], gold[:, 1:], pair_mask)
    flat = features.reshape(n * steps, -1)
    for _ in range(epochs):
        e = emission[features].sum(axis=2) * mask[:, :, None]
        forward = np.empty_like(e)
        forward[:, 0] = e[:, 0]
        top = lambda x, axis: x.max(axis=axis, keepdims=True)
        for t in range(1, steps):
            x = forward[:, t - 1][:, :, None] + transition
            m = top(x, 1)
            step = (m + np.log(np.exp(x - m).sum(axis=1, keepdims=True)))[:, 0] + e[:, t]
            forward[:, t] = np.where(mask[:, t, None], step, forward[:, t - 1])
        m = top(forward[:, -1], 1)
        norm = (m + np.log(np.exp(forward[:, -1] - m).sum(axis=1, keepdims=True)))[:, 0]
        backward = np.zeros_like(e)
        for t in range(steps - 2, -1, -1):
            x = transition + (e[:, t + 1] + backward[:, t + 1])[:, None, :]
            m = top(x, 2)
            step = (m + np.log(np.exp(x - m).sum(axis=2, keepdims=True)))[:, :, 0]
            backward[:, t] = np.where(mask[:, t + 1, None], step, 0)
        chance = np.exp(forward + backward - norm[:, None, None]) * mask[:, :, None]
        pairs = np.exp(forward[:, :-1, :, None] + transition + (e[:, 1:] + backward[:, 1:])[:, :, None, :] - norm[:, None, None, None])
        slope_t = gold_pairs - np.einsum("ntab,nt->ab", pairs, pair_mask) - penalty * n * transition
        diff = (gold - chance).reshape(n * steps, 3)
        slope_e = np.zeros_like(emission)
        for c in range(3):
            for k in range(flat.shape[1]):
                slope_e[:, c] += np.bincount(flat[:, k], weights=diff[:, c], minlength=FEATURES)
        slope_e -= penalty * np.sqrt(n) * emission
        seen_e += slope_e**2
        seen_t += slope_t**2
        emission += rate * slope_e / np.sqrt(seen_e)
        transition += rate * slope_t / np.sqrt(seen_t)
    return Field(emission, transition)


DIGITS, SMALL, BIG = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = (DIGITS + SMALL + BIG, DIGITS + SMALL + BIG, DIGITS + SMALL + BIG + "-_", DIGITS + SMALL + BIG + "+/", BIG + "234567", DIGITS + SMALL, DIGITS + "ABCDEF", DIGITS + BIG)
HINTS = ("key", "auth", "bearer", "credential", "private", "access", "signature", "session", "cookie", "login", "pass", "client")


def _draw(rng, alphabet: str, low: int, high: int | None = None) -> str:
    return "".join(alphabet[i] for i in rng.integers(0, len(alphabet), int(rng.integers(low, high)) if high else low))


def _pick(rng, options):
    return options[int(rng.integers(0, len(options)))]


def planted_secret(rng) -> tuple[str, str, str]:
    """(before, value, after): a random value, alone or with a random prefix or parts, in surroundings of many forms."""
    alphabet = _pick(rng, ALPHABETS)
    value = _draw(rng, alphabet, 18, 64)
    form = rng.random()
    if form < 0.3:
        value = _draw(rng, SMALL, 2, 6) + _pick(rng, "_-") + value
    elif form < 0.4:
        value = ".".join(_draw(rng, alphabet, 12, 40) for _ in range(3))
    hint = _pick(rng, HINTS)
    hint = _pick(rng, (hint, hint.upper(), hint.capitalize(), _draw(rng, SMALL, 3, 8) + "_" + hint))
    return _pick(rng, (("", value, ""), ("", value, "\n"), (hint + " ", value, ""), (hint + ": ", value, ""), (hint + " = ", value, ""), (hint + '="', value, '"'), ('"' + hint + '": "', value, '"'), ("'", value, "'"), ("--" + hint + "=", value, ""), ("(", value, ")")))


def planted_harmless(rng) -> tuple[str, str, str]:
    """(before, value, after): what looks unusual and isn't a secret."""
    name = lambda: _draw(rng, SMALL, 3, 9)
    number = lambda low, high=None: _draw(rng, DIGITS, low, high)
    forms = (
        lambda: f"{number(4)}-{number(2)}-{number(2)}",
        lambda: f"{number(4)}-{number(2)}-{number(2)}T{number(2)}:{number(2)}:{number(2)}",
        lambda: f"{name()}.{name()}{number(1, 4)}@{name()}{number(1)}.example.com",
        lambda: f"{name()}.{name()}/{name()}{number(2)}/{name()}-{name()}.html",
        lambda: f"{name()}/{name()}_{name()}/{name()}.{_draw(rng, SMALL, 2, 4)}",
        lambda: number(9, 20),
        lambda: _draw(rng, BIG, 3, 30),
        lambda: _draw(rng, SMALL, 12, 40),
        lambda: ".".join(number(1, 4) for _ in range(4)),
        lambda: "".join(name().capitalize() for _ in range(int(rng.integers(2, 6)))),
        lambda: "_".join(name() for _ in range(int(rng.integers(2, 6)))),
        lambda: "-".join(name() for _ in range(int(rng.integers(2, 6)))),
        lambda: "-".join(_draw(rng, DIGITS + "abcdef", n) for n in (8, 4, 4, 4, 12)),
        lambda: _draw(rng, DIGITS + "abcdef", 6, 11),
        lambda: f"v{number(1)}.{number(1, 3)}.{number(1, 3)}-{name()}{number(1)}",
        lambda: f"{_draw(rng, BIG, 2, 4)}{number(3, 9)}",
    )
    return _pick(rng, (("", _pick(rng, forms)(), ""), ("(", _pick(rng, forms)(), ")"), (_pick(rng, HINTS) + " ", _pick(rng, forms)(), ","), (name() + ": ", _pick(rng, forms)(), "")))


STEPS = 16


def _tags(t: Tokens, raw: bytes, spans: list[tuple[int, int]]) -> np.ndarray:
    y = np.zeros(len(t.start), np.int64)
    for a, b in sorted(spans):
        hit = np.flatnonzero((t.end > a) & (t.start < b))
        # the keyword of an assignment isn't part of the secret
        hit = hit[[raw[t.start[i] : t.end[i]].lower() not in KEYWORDS for i in hit]] if len(hit) else hit
        fresh = hit[y[hit] == 0]
        y[fresh] = INSIDE
        if len(fresh):
            y[fresh[0]] = BEGIN
    return y


def _whole(raw: bytes) -> Tokens:
    data = np.frombuffer(raw, np.uint8)
    return tokens(Block(0, 1, data, np.array([0, len(data)])))


def text_windows(text: str, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Up to four windows of ``STEPS`` tokens of one text: (features, tags)."""
    rng, raw = np.random.default_rng(seed & ((1 << 63) - 1)), text.encode()
    t, spans = _whole(raw), [(a, b) for a, _, b in base_spans(raw)]
    n = len(t.start)
    if not n:
        return []
    y = _tags(t, raw, spans)

    def window(t: Tokens, y: np.ndarray, centre: int) -> tuple[np.ndarray, np.ndarray]:
        a = max(0, min(centre - STEPS // 2, len(y) - STEPS))
        return t.features[a : a + STEPS], y[a : a + STEPS]

    # shape 4 and 8 (digits, marks), or long: what a look at the token alone might take for a secret
    shape = t.features[:, 0]
    unusual = np.flatnonzero((y == OUT) & (((shape & 7) > 4) | (shape >= 128)))
    out = [window(t, y, int(rng.integers(0, n)))]
    begins = np.flatnonzero(y == BEGIN)
    if len(begins):
        out.append(window(t, y, int(_pick(rng, begins))))
    if len(unusual):
        out.append(window(t, y, int(_pick(rng, unusual))))
    secret = rng.random() < 0.5
    before, value, after = (planted_secret if secret else planted_harmless)(rng)
    k = int(rng.integers(0, n))
    left, right = raw[t.start[max(0, k - STEPS)] : t.start[k]], raw[t.start[k] : t.end[min(n - 1, k + STEPS)]]
    head = left + before.encode()
    made = head + value.encode() + after.encode() + b" " + right
    u = _whole(made)
    own = [(a, b) for a, _, b in base_spans(made)] + ([(len(head), len(head) + len(value))] if secret else [])
    # the file is still the document, not the snippet
    u.features[:, -FILE_GROUPS:] = t.features[k, -FILE_GROUPS:]
    out.append(window(u, _tags(u, made, own), int(np.searchsorted(u.start, len(head)))))
    return out


def drawn_hashes(docs: DataFrame, sample: int = SAMPLE_DOCUMENTS, text_col: str = "text") -> tuple[DataFrame, int | None]:
    """Texts with their hashes, and the last of the ``sample`` least distinct hashes (None without texts).

    Copies count once, wherever they stand, so the draw depends on the set of texts alone.
    """
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.length("text") > 0).withColumn("hash", F.xxhash64("text", F.lit(5)))
    least = [r["hash"] for r in texts.select("hash").distinct().orderBy("hash").limit(sample).collect()]
    return texts, least[-1] if least else None


def training_windows(texts: DataFrame, last: int) -> DataFrame:
    """hash, number, features and tags (binary) of the windows of the drawn texts, each text once."""

    def run(batches):
        for batch in batches:
            rows = []
            for text, seed in dict(zip(batch.column("text").to_pylist(), batch.column("hash").to_pylist(), strict=True)).items():
                rows += [{"hash": seed, "number": k, "features": f.astype(np.int32).tobytes(), "tags": y.astype(np.int8).tobytes()} for k, (f, y) in enumerate(text_windows(text, seed))]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("hash", pa.int64()), ("number", pa.int32()), ("features", pa.binary()), ("tags", pa.binary())]))

    small_batches(texts.sparkSession)
    # whole texts travel only to the Python worker beside them; what is sent on is short
    return texts.where(F.col("hash") <= last).mapInArrow(run, "hash long, number int, features binary, tags binary").distinct()


def fit(docs: DataFrame, sample: int = SAMPLE_DOCUMENTS, text_col: str = "text") -> Field | None:
    """Trains on the windows of ``sample`` distinct texts (``drawn_hashes``), the documented bound; None without texts."""
    texts, last = drawn_hashes(docs, sample, text_col)
    if last is None:
        return None
    # at most four windows of under 700 bytes for each drawn text
    rows = training_windows(texts, last).orderBy("hash", "number", "features", "tags").collect()
    if not rows:
        return None
    features = np.zeros((len(rows), STEPS, len(_GROUPS)), np.int64)
    tags, mask = np.zeros((len(rows), STEPS), np.int64), np.zeros((len(rows), STEPS), bool)
    for k, r in enumerate(rows):
        y = np.frombuffer(r.tags, np.int8)
        features[k, : len(y)] = np.frombuffer(r.features, np.int32).reshape(len(y), -1)
        tags[k, : len(y)], mask[k, : len(y)] = y, True
    return train(features, tags, mask)


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("end", T.LongType())]))


def scan(docs: DataFrame, field: Field | None, text_col: str = "text") -> DataFrame:
    """Columns of ``docs`` and ``spans``: array of (start, kind, end) in code points, by start, then kind."""
    rest = docs.drop("spans")
    small_batches(docs.sparkSession)
    schema = T.StructType([*rest.schema.fields, T.StructField("spans", SPAN)])
    shared = docs.sparkSession.sparkContext.broadcast(field)  # a fixed number of weights
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))

    def run(batches):
        field = shared.value
        for batch in batches:
            out: list[list] = []
            for block in blocks(batch.column(text_col)):
                found: list[list] = []
                runs = rows_with_hex_runs(block)
                for r in range(block.rows):
                    found.append(base_spans(block.data[block.offsets[r] : block.offsets[r + 1]].tobytes(), bool(runs[r])))
                if field is not None:
                    t = tokens(block)
                    tag = field.tag(t)
                    marked = np.flatnonzero(tag)
                    k = 0
                    while k < len(marked):
                        i = j = int(marked[k])
                        while k + 1 < len(marked) and marked[k + 1] == j + 1 and tag[j + 1] == INSIDE and t.row[j + 1] == t.row[i]:
                            k += 1
                            j = int(marked[k])
                        k += 1
                        r = int(t.row[i])
                        a, b = int(t.start[i] - block.offsets[r]), int(t.end[j] - block.offsets[r])
                        if all(b <= s or a >= e for s, _, e in found[r]):
                            found[r].append((a, 3, b))
                starts = np.zeros(len(block.data) + 1, np.int64)
                np.cumsum((block.data & 0xC0) != 0x80, out=starts[1:])
                for r, spans in enumerate(found):
                    o = block.offsets[r]
                    out.append([{"start": int(starts[o + a] - starts[o]), "kind": KINDS[k], "end": int(starts[o + b] - starts[o])} for a, k, b in sorted(spans)])
            if out:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, arrow)], names=[*batch.schema.names, "spans"])

    return rest.mapInArrow(run, schema)


def redact(found: DataFrame, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """Replaces the spans of every text by ``mark``; overlapping spans become one mark.  ``spans`` goes."""
    rest = found.drop("spans")
    names = rest.columns

    def run(batches):
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            for r, spans in enumerate(batch.column("spans").to_pylist()):
                if spans:
                    text, at, parts = texts[r], 0, []
                    for s in spans:
                        if s["start"] >= at:
                            parts += [text[at : s["start"]], mark]
                        at = max(at, s["end"])
                    texts[r] = "".join([*parts, text[at:]])
            kept = [batch.column(c) if c != text_col else pa.array(texts, pa.string()) for c in names]
            yield pa.RecordBatch.from_arrays(kept, names=names)

    return found.select(*names, "spans").mapInArrow(run, rest.schema)


def op2_secrets_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, fit(docs)).drop("text")
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "field")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        count("field").alias("n_field"),
    )
