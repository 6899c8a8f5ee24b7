"""Run settings and their defaults."""

from __future__ import annotations

import dataclasses
from typing import Any

# The defaults and the published result names.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
METRICS = ("faithfulness", "answer_relevancy", "context_precision", "context_recall")
SEARCH_TYPES = ("similarity", "mmr")
SPLITTERS = ("recursive", "windows")
SEARCH_BACKENDS = ("scan", "postings")
CHUNK_SIZES = (256, 512, 1024)
K_VALUES = (2, 4, 6, 8)
# Dotted setting names and the field each one sets.
DOTTED = {
    "chunking.chunk_size": "chunk_size",
    "chunking.chunk_overlap": "chunk_overlap",
    "chunking.separators": "separators",
    "embedding.provider": "embedding_provider",
    "embedding.model_name": "embedding_model",
    "retriever.k": "k",
    "retriever.search_type": "search_type",
    "retriever.fetch_k": "fetch_k",
    "retriever.lambda_mult": "lambda_mult",
    "retriever.backend": "search_backend",
    "llm.provider": "llm_provider",
    "llm.model_name": "llm_model",
    "llm.temperature": "temperature",
    "llm.max_tokens": "max_tokens",
    "eval.metrics": "metrics",
}


@dataclasses.dataclass(frozen=True)
class Settings:
    """One configuration of a run; validated when made."""

    chunk_size: int = 512
    chunk_overlap: int = 64
    separators: tuple[str, ...] = SEPARATORS
    splitter: str = "recursive"
    embedding_provider: str = "tfidf"
    embedding_model: str = "tfidf"
    k: int = 4
    search_type: str = "similarity"
    fetch_k: int = 20
    lambda_mult: float = 0.5
    search_backend: str = "scan"
    llm_provider: str = "extractive"
    llm_model: str = "extractive"
    temperature: float = 0.0
    max_tokens: int = 1024
    metrics: tuple[str, ...] = METRICS
    answer_threshold: float = 0.1
    support_threshold: float = 0.8

    def __post_init__(self):
        if self.chunk_size < 1:
            raise ValueError(f"chunk_size must be positive, got {self.chunk_size}")
        if not 0 <= self.chunk_overlap <= self.chunk_size:
            raise ValueError(
                f"chunk_overlap {self.chunk_overlap} must lie in 0..chunk_size {self.chunk_size}"
            )
        if self.k < 1:
            raise ValueError(f"k must be at least 1, got {self.k}")
        if self.search_type not in SEARCH_TYPES:
            raise ValueError(
                f"Unknown search_type: '{self.search_type}'; there are {', '.join(SEARCH_TYPES)}"
            )
        if self.search_backend not in SEARCH_BACKENDS:
            raise ValueError(f"Unknown search backend: '{self.search_backend}'. Known: {SEARCH_BACKENDS}")
        if self.splitter not in SPLITTERS:
            raise ValueError(f"Unknown splitter: '{self.splitter}'")

    def variant(self, overrides: dict[str, Any]) -> "Settings":
        """A copy with dotted overrides such as ``{"retriever.k": 2}``."""
        unknown = [name for name in overrides if name not in DOTTED]
        if unknown:
            raise KeyError(f"Unknown settings: {unknown}")
        return dataclasses.replace(self, **{DOTTED[n]: v for n, v in overrides.items()})


def sweep_overlap(chunk_size: int) -> int:
    """Overlap used with a chunk size in the size sweep."""
    return max(32, chunk_size // 8)
