"""Parameters of the operators and jobs, with their default values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # preprocessing
    min_tokens: int = 15
    dedup_method: str = "jaccard"  # or "minhash"
    dedup_threshold: float = 0.92
    minhash_threshold: float = 0.8
    minhash_perms: int = 128
    # vectors and clusters
    embedding_batch: int = 64
    clustering: str = "dbscan"
    eps: float = 0.35
    min_samples: int = 3
    reduce_vectors: bool = False
    components: int = 50
    representatives: int = 5
    keywords: int = 10
    vocabulary: int = 300
    include_noise: bool = True
    # false-positive analysis
    samples_per_category: int = 8
    min_occurrences: int = 2
    context_window: int = 300
    snippet_limit: int = 1200
    pattern_prior: float = 0.6
    other_prior: float = 0.2
    # judging and scheduling
    judge_attempts: int = 3
    intent_token_budget: int = 2200
    fp_token_budget: int = 3500
    lookback_hours: int = 72

    def __post_init__(self):
        if self.dedup_method not in ("jaccard", "minhash"):
            raise ValueError(f"unknown dedup_method {self.dedup_method!r}")
        if self.clustering != "dbscan":
            raise ValueError(f"unknown clustering {self.clustering!r}")
