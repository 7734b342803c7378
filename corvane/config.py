"""Settings of the retrieval and ingest plans, read from the environment with bounds."""

from __future__ import annotations

import dataclasses
import os


@dataclasses.dataclass(frozen=True)
class Settings:
    # fixed values: defaults that results depend on
    fetch_k: int = 30
    top_k: int = 8
    mmr_lambda: float = 0.30
    mmr_lambda_short: float = 0.25
    min_score: float = 0.25
    rrf_k: int = 60
    max_per_source: int = 2
    lexical_threshold: int = 90
    dept_bonus: float = 8.0
    mq_variants: int = 3
    confidence_min: float = 0.32
    max_sources: int = 5
    rerank_candidates: int = 40
    rerank_top_k: int = 8
    chunk_size: int = 300
    chunk_overlap: int = 60
    max_refine: int = 2
    confidence_min_agent: float = 0.55
    cache_ttl: int = 43200
    fuse_rrf: bool = True
    require_context: bool = True
    files_per_batch: int = 32

    def __post_init__(self):
        low = {"fetch_k": 1, "top_k": 1, "rrf_k": 1, "max_per_source": 1, "mq_variants": 1, "max_sources": 1, "rerank_top_k": 1, "chunk_size": 1, "chunk_overlap": 0, "max_refine": 0, "cache_ttl": 0}
        for name, bound in low.items():
            object.__setattr__(self, name, max(bound, getattr(self, name)))
        if self.chunk_overlap >= self.chunk_size:
            object.__setattr__(self, "chunk_overlap", max(0, self.chunk_size - 1))

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        """Fields by their upper-case names; values that can't be read leave the default."""
        env, given = os.environ if env is None else env, {}
        for f in dataclasses.fields(cls):
            raw = env.get(f.name.upper())
            if raw is None or not raw.strip():
                continue
            try:
                if isinstance(f.default, bool):
                    given[f.name] = raw.strip().lower() in ("1", "true", "yes", "on")
                else:
                    given[f.name] = type(f.default)(raw.strip())
            except ValueError:
                pass
        return cls(**given)
