"""Brute-force counterparts and awkward rows shared by the tests."""

import re

CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = " ".join(f"wort{k % 977}é" for k in range(30_000))
#: doc_id, text, lang, source, n_chars: nulls, empty, wordless, very long, repeated, copies.
AWKWARD = [
    (1, None, "en", "s", 0),
    (2, "", None, "s", 0),
    (3, "... !! \n", "en", None, 8),
    (4, LONG, "de", "s", len(LONG)),
    (5, "One Two three four five six seven", "en", "s", None),
    (6, "one two  THREE four, five six seven", "en", "s", 0),
    (6, "one two  THREE four, five six seven", "en", "s", 0),
    (None, "no id at all here, only words", "en", "s", 0),
    (8, "short", "fr", "s", 5),
    (9, "short", "fr", "s", 5),
    (10, "😀 emoji 日本語 ÀÉ", "fr", "s", 5),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall((text or "").translate(CAPITALS))


def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
