"""Default parameters of the operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # Fixed values that results depend on.
    window_chars: int = 1000
    window_overlap: int = 150
    chunk_chars: int = 900
    chunk_overlap: int = 150
    min_chunk_chars: int = 80
    top_k: int = 3
    rerank_candidates: int = 20
    relevance_threshold: float = 0.25
    rerank_threshold: float = 0.5
    rrf_constant: int = 60
    judge_threshold: int = 70
    max_attempts: int = 2
    history_turns: int = 6
    source_chars: int = 6000
    snippet_chars: int = 280
    sparse_buckets: int = 1_000_000
    holdout_min_docs: int = 2
    holdout_min_units: int = 3
    accuracy_floor: float = 0.70
    groundedness_floor: float = 0.85
    hallucination_ceiling: float = 0.15
    f1_pass: float = 0.50
    fallback_slack: float = 0.05
    latency_ceiling_ms: float = 8000.0
    min_answer_chars: int = 40
    page_contents_leaders: int = 4
    chunk_contents_leaders: int = 3
    min_unit_chars: int = 120
    max_unit_chars: int = 3500
    merge_below_chars: int = 80
    min_page_chars: int = 200
    min_group_chars: int = 1200
    hopeless_margin: int = 25
    gated_modes: tuple[str, ...] = ("general",)


DEFAULTS = Settings()
