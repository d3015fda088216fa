"""Settings, read from the environment when a ``Settings`` is made."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    search_backend: str = "lexical"
    lexical_engine: str = "bm25"
    lexical_index_path: str = "data/indexes/lexical_bm25"
    lexical_data_path: str = "data/chunks/corpus_chunks.json"
    lexical_build_limit: int = 1000
    semantic_index_path: str = "data/embeddings/vectors"
    semantic_metadata_path: str = "data/embeddings/metadata"
    semantic_config_path: str = "data/embeddings/embedding_config.json"
    semantic_candidate_multiplier: int = 5
    semantic_min_candidates: int = 50
    hybrid_rrf_k: int = 60
    hybrid_candidate_multiplier: int = 5
    hybrid_require_semantic: bool = True
    reranker_enabled: bool = False
    reranker_model: str = ""
    reranker_top_k: int = 50
    reranker_batch_size: int = 8
    reranker_max_length: int = 512

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> Settings:
        """Each field by its upper-case name; booleans are true for 1, true and yes."""
        found = {}
        for name, field in cls.__dataclass_fields__.items():
            raw = env.get(name.upper())
            if raw is not None:
                kind = type(field.default)
                found[name] = raw.strip().lower() in ("1", "true", "yes") if kind is bool else kind(raw)
        return cls(**found)
