"""Tunables, passed to plan builders; there is no global state."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # recency (1 + beta * hours) ** -alpha; strength = w_recency * recency + w_frequency * frequency
    alpha: float = 0.3
    beta: float = 0.1
    w_recency: float = 0.4
    w_frequency: float = 0.6
    # feature blend
    w_semantic: float = 0.55
    w_lexical: float = 0.20
    w_strength: float = 0.15
    w_confidence: float = 0.10
    w_association: float = 0.10
    contradiction_penalty: float = 0.35
    # retrieval
    k: int = 10
    anchor_ratio: float = 0.5
    embed_threshold: float = 0.3
    raw_log_scale: float = 0.5
    neighbor_expansion: bool = True
    neighbor_decay: float = 0.6
    cold_start_sessions: int = 10
    include_history: bool = False
    # consolidation
    link_threshold: float = 0.85
    dedup_threshold: float = 0.92
    correction_window: int = 3
    mention_weight: float = 0.8
    # language-model stage
    stage2_max_messages: int = 60
    stage2_min_confidence: float = 0.5
    flush_seconds: int = 30
    embed_dim: int = 384
    # BM25
    k1: float = 1.5
    b: float = 0.75


DEFAULTS = Settings()
