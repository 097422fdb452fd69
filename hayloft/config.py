"""Settings of an engine: defaults, overridden by TOML tables, then by HAYLOFT_* variables, then clamped."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields

from hayloft.functions.identity import fingerprint


@dataclass(frozen=True)
class Settings:
    mode: str = "balanced"
    limit: int = 10
    per_file: int = 1
    max_candidates: int = 2000
    max_snippet_bytes: int = 8192
    max_total_snippet_bytes: int = 200_000
    rerank: bool = True
    rerank_depth: int = 50
    vector_dim: int = 384
    max_file_bytes: int = 10 << 20
    doc_prefix: str = ""
    query_prefix: str = ""

    @classmethod
    def load(cls, *tables: str, env: Mapping[str, str] | None = None) -> Settings:
        """From TOML texts, later ones over earlier ones, and the environment."""
        values: dict = {}
        for text in tables:
            values |= tomllib.loads(text)
        known = {f.name: type(f.default) for f in fields(cls)}
        for name, kind in known.items():
            raw = (env if env is not None else os.environ).get(f"HAYLOFT_{name.upper()}")
            if raw is not None:
                values[name] = raw.lower() in ("1", "true", "yes") if kind is bool else kind(raw)
        unknown = sorted(set(values) - set(known))
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return cls(**values).clamped()

    def clamped(self) -> Settings:
        """Within the hard limits."""
        # fixed values: hard limits of a query
        inside = lambda x, low, high: max(low, min(high, x))
        out = asdict(self) | {"limit": inside(self.limit, 1, 200), "per_file": inside(self.per_file, 0, 50), "max_candidates": inside(self.max_candidates, 1, 10_000), "rerank_depth": inside(self.rerank_depth, 0, 1000)}
        return Settings(**out)

    def index_fingerprint(self) -> str:
        """Changes when stored rows would: another value means another store."""
        return fingerprint({k: getattr(self, k) for k in ("vector_dim", "max_file_bytes", "doc_prefix")})
