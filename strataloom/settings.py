"""Settings with defaults, from a mapping such as the process environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """What plans take when a caller names nothing else. Names in a mapping are those of the fields, in capitals, after
    `STRATALOOM_`; values are read as the field's kind, empty ones count as missing."""

    text_k: int = 50
    vector_k: int = 10
    fused_k: int = 10
    vector_weight: float = 0.6
    reranked: int = 5
    expanded: int = 3
    dimension: int = 1536
    relevant: float = 0.9
    window: int = 25_000
    chunk: int = 2500
    overlap: int = 300
    max_bytes: int = 1 << 20
    route: str = "reranked"

    @staticmethod
    def read(source: Mapping[str, str] | None = None) -> Settings:
        source = os.environ if source is None else source
        kinds = {"int": int, "float": float, "str": str}
        named = {f.name: source.get(f"STRATALOOM_{f.name.upper()}") for f in fields(Settings)}
        return Settings(**{f.name: kinds[f.type](named[f.name]) for f in fields(Settings) if named[f.name]})
