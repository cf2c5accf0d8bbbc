"""Engine settings with their checks."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """Defaults of ingest and search; ``check`` raises ValueError on settings that cannot work."""

    chunk_size: int = 1750
    chunk_overlap: int = 200
    min_chunk: int = 100
    top_k: int = 10
    candidate_factor: int = 5
    min_score: float = 0.02
    rrf_k: int = 60
    score_weight: float = 0.3
    duplicate_jaccard: float = 0.75
    diversity: float = 0.5
    ann_rows: int = 1000
    #: Results of a broad query and of any other.
    broad_k: int = 40
    narrow_k: int = 20
    #: Most rows that a side of a join may have to be broadcast without asking Spark's statistics.
    broadcast_rows: int = 200_000

    def check(self) -> "EngineConfig":
        if self.chunk_size <= 0 or self.top_k <= 0 or self.rrf_k <= 0 or self.candidate_factor <= 0:
            raise ValueError("sizes must be positive")
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("the overlap must be smaller than a chunk")
        if not 0 <= self.min_score <= 1 or not 0 <= self.score_weight:
            raise ValueError("scores out of range")
        return self
