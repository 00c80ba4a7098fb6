"""Settings of the engine, checked as they are made."""

from __future__ import annotations

import dataclasses
import json
import math
from dataclasses import dataclass

from lodeline.functions.text import truth


@dataclass(frozen=True)
class Settings:
    """Sizes, limits and weights of ingestion, search and context. ValueError names what is wrong."""

    chunk_size: int = 500
    chunk_overlap: int = 60
    dimension: int = 1024
    candidates: int = 20
    pool: int = 80
    results: int = 5
    dense_weight: float = 0.75
    lexical_weight: float = 0.25
    rank_constant: int = 5
    memory_topics: int = 200
    memory_results: int = 5
    context_messages: int = 12
    context_chars: int = 8_000
    compact_messages: int = 24
    compact_keep: int = 11
    rerank: bool = False

    def __post_init__(self) -> None:
        for f in dataclasses.fields(self):
            value = getattr(self, f.name)
            if f.type == "int" and (isinstance(value, bool) or not isinstance(value, int) or value < (0 if f.name == "chunk_overlap" else 1)):
                raise ValueError(f"{f.name} must be a whole number above {-1 if f.name == 'chunk_overlap' else 0}")
            if f.type == "float" and (isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value) or value < 0):
                raise ValueError(f"{f.name} must be a finite number, not below 0")
            if f.type == "bool" and not isinstance(value, bool):
                raise ValueError(f"{f.name} must be a truth value")
        if self.chunk_overlap >= self.chunk_size:
            raise ValueError("chunk_overlap must be less than chunk_size")
        if self.dense_weight + self.lexical_weight <= 0:
            raise ValueError("one of the weights must be above 0")
        if self.results > self.candidates:
            raise ValueError("results must be at most candidates")
        if self.compact_keep >= self.compact_messages:
            raise ValueError("compact_keep must be less than compact_messages")


def settings(values: dict[str, object]) -> Settings:
    """Settings from names and values, as a JSON or YAML file gives them; truth values may be spelt out, unknown names are refused."""
    known = {f.name: f.type for f in dataclasses.fields(Settings)}
    unknown = sorted(set(values) - set(known))
    if unknown:
        raise ValueError("unknown settings: " + ", ".join(unknown))
    return Settings(**{k: truth(v) if known[k] == "bool" and isinstance(v, str) else v for k, v in values.items()})


def load(path: str) -> Settings:
    """Settings of a JSON file."""
    with open(path, encoding="utf-8") as f:
        return settings(json.load(f))
