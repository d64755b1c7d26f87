"""Limits and weights of segmentation and retrieval."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class BufferConfig:
    """When buffered turns become cells: a check at each multiple of ``soft`` tokens, a cut at ``hard``, a gap in minutes."""

    soft: int = 512
    hard: int = 2048
    gap_minutes: int = 30
    detector_chars: int = 8000


@dataclass(frozen=True)
class RetrievalConfig:
    rrf_k: int = 60
    top_k: int = 50
    wide_top_k: int = 100
    min_score: float = 0.015
    vector_min_score: float = 0.3
    keyword_scan: int = 100
    expand_top: int = 3
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    entity_bonus: float = 0.15
    entity_bonus_most: float = 0.3
    rewrite_below: int = 10


BUFFER, RETRIEVAL = BufferConfig(), RetrievalConfig()
