"""Defaults of the analyses (fixed values)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

LANGUAGES = ("en", "ro")


@dataclass(frozen=True)
class Config:
    seed: int = 42
    snapshot: str = "2025-10-01"
    ngram_order: int = 5
    ppm_depth: int = 8
    test_split: float = 0.2
    block_size: int = 2000
    resamples: int = 1000
    confidence: float = 0.95
    corpora: str = "data/corpora"
    results: str = "results"
    output: str = "output"
    figures: str = "paper/figs"


@lru_cache(1)
def get_config() -> Config:
    return Config()
