"""Policies with validated defaults."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import asdict, dataclass, field


def canonical_hash(value, ascii_only: bool = True) -> str:
    """SHA-256 of a value as JSON with sorted keys and no spaces. Callers differ in whether other than ASCII letters are
    escaped; numbers that JSON has no form for are an error."""
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only, allow_nan=False)
    return hashlib.sha256(text.encode()).hexdigest()


@dataclass(frozen=True)
class ChunkPolicy:
    """Token bounds of chunks. The defaults."""

    min_tokens: int = 100
    target_tokens: int = 450
    max_tokens: int = 800
    overlap_tokens: int = 64
    parent_max_tokens: int = 1800

    def __post_init__(self) -> None:
        if not 0 < self.min_tokens <= self.target_tokens <= self.max_tokens:
            raise ValueError("token bounds must satisfy 0 < min <= target <= max")
        if not 0 <= self.overlap_tokens < self.min_tokens:
            raise ValueError("overlap must be at least 0 and below min")
        if self.parent_max_tokens < self.max_tokens:
            raise ValueError("parents must hold a whole chunk")

    def config_hash(self) -> str:
        """SHA-256 of the policy as JSON with sorted keys."""
        return canonical_hash(asdict(self), ascii_only=False)


CHANNELS = ("qa_vector", "qa_text", "chunk_vector", "chunk_text")


@dataclass(frozen=True)
class RetrievalConfig:
    """Sizes and weights of a retrieval. The defaults."""

    qa_top_k: int = 20
    hybrid_top_k: int = 10
    final_top_k: int = 5
    rrf_k: int = 60
    confidence: float = 1.35
    snapshot_cap: int = 10
    context_tokens: int = 6000
    overlap_share: float = 0.8
    weights: dict[str, float] = field(default_factory=lambda: dict.fromkeys(CHANNELS, 1.0))

    def __post_init__(self) -> None:
        unknown = set(self.weights) - set(CHANNELS)
        if unknown:
            raise ValueError(f"unknown channels: {sorted(unknown)}")
        if any(not math.isfinite(w) or w < 0 for w in self.weights.values()):
            raise ValueError("channel weights must be finite and not negative")


@dataclass(frozen=True)
class Services:
    """What a deployment's settings choose: bounds, sizes and the token counter."""

    policy: ChunkPolicy
    retrieval: RetrievalConfig
    counter: object

    @classmethod
    def of(cls, settings: dict) -> Services:
        """From a mapping with chunking, retrieval and vocabulary, a file of a byte-pair tokenizer; all may be missing.
        Names that no setting has are an error."""
        from quern.operators.handlers import byte_pair_counter, word_counter

        if unknown := set(settings) - {"chunking", "retrieval", "vocabulary"}:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        counter = byte_pair_counter(settings["vocabulary"]) if settings.get("vocabulary") else word_counter()
        return cls(ChunkPolicy(**settings.get("chunking", {})), RetrievalConfig(**settings.get("retrieval", {})), counter)
