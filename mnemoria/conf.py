"""Settings whose defaults are part of the engine's semantics."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, fields

from mnemoria.errors import ConfigurationError

PREFIX = "MNEMORIA_"
ALGORITHMS = ("label_propagation", "connected_components", "greedy_modularity")


@dataclass(frozen=True)
class EngineConfig:
    user_id: str = "default"
    memory_id: str = "default"
    store_path: str | None = None
    chunk_size: int = 2048
    chunk_overlap: int = 200
    max_triplets: int = 40
    top_k: int = 10
    min_similarity: float = 0.5
    context_tokens: int = 16000
    half_life_days: float = 30.0
    keep_importance: float = 1.0
    archive_strength: float = 0.2
    delete_strength: float = 0.05
    min_evolve_hours: float = 1.0
    max_cluster_size: int = 100
    min_cluster_size: int = 2
    community_algorithm: str = "label_propagation"
    consolidate_cosine: float = 0.75
    consolidate_last_name: float = 0.65
    consolidate_tokens: float = 0.60
    resolve_embedding: float = 0.85
    resolve_token: float = 0.7
    resolve_fuzzy: float = 0.92
    rehydrate_similarity: float = 0.75
    rehydrate_max: int = 100
    cache_ttl: int = 3600
    query_ttl: int = 300
    embedding_ttl: int = 86400
    max_retries: int = 3

    def validate(self) -> EngineConfig:
        wrong = [n for n in ("chunk_size", "top_k", "context_tokens", "max_cluster_size", "rehydrate_max") if getattr(self, n) < 1]
        wrong += [n for n in ("half_life_days",) if getattr(self, n) <= 0]
        wrong += ["chunk_overlap"] if not 0 <= self.chunk_overlap < self.chunk_size else []
        wrong += ["community_algorithm"] if self.community_algorithm not in ALGORITHMS else []
        if wrong:
            raise ConfigurationError("settings out of range: " + ", ".join(wrong), settings=wrong)
        return self

    @classmethod
    def from_dict(cls, values: dict) -> EngineConfig:
        """Known keys of values; the others are ignored."""
        return cls(**{f.name: values[f.name] for f in fields(cls) if f.name in values}).validate()

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> EngineConfig:
        env = dict(os.environ) if env is None else env
        kinds = {f.name: type(f.default) if f.default is not None else str for f in fields(cls)}
        return cls.from_dict({n: kind(env[PREFIX + n.upper()]) for n, kind in kinds.items() if PREFIX + n.upper() in env})

    def to_dict(self) -> dict:
        return asdict(self)


def chunk_size_for(memory_gb: float) -> int:
    """Chunk characters that suit a worker's memory."""
    return 1000 if memory_gb < 8 else 2000 if memory_gb < 32 else 4000
