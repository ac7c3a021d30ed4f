"""Settings of retrieval and of the service."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

MODES = ("dense", "sparse", "hybrid")


@dataclass(frozen=True)
class RetrievalConfig:
    mode: str = "hybrid"
    candidate_k: int = 30
    rerank_k: int = 20
    final_k: int = 5
    rank_constant: int = 60
    max_context_tokens: int = 8000
    per_document: int = 2
    reranker_timeout: float = 5.0
    threshold: float = 0.05
    thresholds: Mapping[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"unsupported mode: {self.mode}")
        if min(self.candidate_k, self.rerank_k, self.final_k, self.rank_constant, self.max_context_tokens, self.per_document) <= 0 or self.reranker_timeout <= 0:
            raise ValueError("limits must be positive")
        if not self.final_k <= self.rerank_k <= self.candidate_k:
            raise ValueError("final_k <= rerank_k <= candidate_k must hold")

    def threshold_of(self, mode: str) -> float:
        return self.thresholds.get(mode, self.threshold)


def from_environment(env: Mapping[str, str] | None = None) -> RetrievalConfig:
    """Settings by environment variables."""
    env = os.environ if env is None else env
    whole = lambda name, default: int(env.get(name, default))
    real = lambda name, default: float(env.get(name, default))
    return RetrievalConfig(
        env.get("RETRIEVAL_MODE", "hybrid"),
        whole("RETRIEVAL_CANDIDATE_K", 30),
        whole("RETRIEVAL_RERANK_K", 20),
        whole("RETRIEVAL_FINAL_K", 5),
        whole("RRF_RANK_CONSTANT", 60),
        whole("MAX_CONTEXT_TOKENS", 8000),
        whole("MAX_CHUNKS_PER_DOCUMENT", 2),
        real("RERANKER_TIMEOUT_SECONDS", 5.0),
        real("RELEVANCE_THRESHOLD", 0.05),
        {"dense": real("DENSE_RELEVANCE_THRESHOLD", 0.498), "sparse": real("SPARSE_RELEVANCE_THRESHOLD", 0.5), "hybrid": real("HYBRID_RELEVANCE_THRESHOLD", 0.545)},
    )
