"""Defaults that are part of the semantics."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    top_n: int = 20
    keep_k: int = 5
    rrf_k: int = 60
    dense_weight: float = 1.0
    bm25_weight: float = 1.0
    chunk_tokens: int = 400
    chunk_overlap: int = 50
    parent_tokens: int = 1500
    parent_chars: int = 6000
    max_retries: int = 2
    weak_count: int = 2
    weak_score: float = 0.3
    min_density: float = 0.4
    grounding: float = 0.30
    grounding_web: float = 0.25
    excluded_sections: tuple[str, ...] = ("references", "bibliography", "acknowledgements", "acknowledgments")


DEFAULTS = EngineConfig()
