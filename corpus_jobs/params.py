"""Parameters of the jobs, with their range checks."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Ranking:
    """How hits are ranked, fused and widened."""

    top_k: int = 6
    related_k: int = 2
    candidate_k: int = 24
    semantic_weight: float = 1.0
    lexical_weight: float = 0.7
    rrf_k: int = 60
    k1: float = 1.5
    b: float = 0.75

    def __post_init__(self):
        for name in ("top_k", "related_k", "candidate_k"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        if self.rrf_k < 1 or self.semantic_weight < 0 or self.lexical_weight < 0:
            raise ValueError("rrf_k must be at least 1, and no weight may be negative")

    @property
    def depth(self) -> int:
        return max(self.top_k, self.candidate_k)


@dataclass(frozen=True)
class Chunking:
    """Least size of a section and greatest size of a piece, in characters."""

    min_section: int = 200
    max_piece: int = 2500

    def __post_init__(self):
        if self.min_section < 0 or self.max_piece < 1:
            raise ValueError("min_section must not be negative, and max_piece at least 1")


@dataclass(frozen=True)
class Embedding:
    """Name and size of the embedding model, and how many texts go to it at once."""

    model: str = "test-embedder"
    dim: int = 384
    batch_size: int = 32

    def __post_init__(self):
        if self.dim < 1 or self.batch_size < 1:
            raise ValueError("dim and batch_size must be at least 1")


@dataclass(frozen=True)
class Dialogs:
    """Limits of a conversation, and what goes into its prompt."""

    max_messages: int = 20
    max_chars: int = 4000
    history: int = 8
    site: str = ""
    system: str = "Answer from the excerpts below only, briefly and in plain text. If they don't hold the answer, say so."
    excerpts_intro: str = "Excerpts:"
    related_intro: str = "Excerpts of related notes, which share tags with those above:"
