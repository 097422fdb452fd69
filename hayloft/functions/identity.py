"""Deterministic identifiers."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNKER_VERSION = "chunker-v2"


def chunk_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def chunk_id(hash_hex: Column, kind: Column, version: str = CHUNKER_VERSION) -> Column:
    """Hash of the raw digest, the chunker version and the kind."""
    return F.sha2(F.concat(F.unhex(hash_hex), F.lit(version).cast("binary"), kind.cast("binary")), 256)


def little_endian_32(n: Column) -> Column:
    return F.unhex(F.concat(*(F.lpad(F.hex(F.shiftright(n, 8 * k).bitwiseAND(255).cast("long")), 2, "0") for k in range(4))))


def row_id(path: Column, chunk: Column, ordinal: Column) -> Column:
    return F.sha2(F.concat(path.cast("binary"), chunk.cast("binary"), little_endian_32(ordinal)), 256)


def head_hash(content: Column) -> Column:
    """Hash of the first 4096 bytes of a file."""
    return F.sha2(F.substring(content, 1, 4096), 256)


def short(hash_hex: Column, n: int = 12) -> Column:
    return F.left(hash_hex, F.lit(n))


def fingerprint(settings: dict) -> str:
    """Hash of settings in canonical JSON."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
