"""Parameters of the pipeline; passed to operators, never read from globals."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    top_k: int = 5
    candidate_multiplier: int = 4
    chunk_size: int = 5
    collection: str = "arxiv_collection"
    rerank_top_n: int | None = None
    fusion_variants: int = 4
    alpha: float = 0.5
    beta: float = 0.3
    gamma: float = 0.2
    confidence_threshold: float = 0.75
    embedding_batch: int = 100
    cache_ttl_seconds: int = 300
    page_size: int = 10
    rrf_constant: int = 60
    metric: str = "l2sq"
    model: str = "default"

    @property
    def budget(self) -> int:
        """Candidates fetched per variant when a reranker will cut them later."""
        return self.top_k * self.candidate_multiplier

    @property
    def rerank_cut(self) -> int:
        return self.rerank_top_n or self.top_k


DEFAULTS = Params()
