"""Smoothed symbol frequencies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surprisal.functions.text import entropy_of_counts
from surprisal.models.base import Model, require_text
from surprisal.operators.counts import char_counts


def smoothed_costs(train: DataFrame, test: DataFrame, size: int, smoothing: float, by: list[str] | None = None, fit_by: list[str] | None = None) -> DataFrame:
    """by, events, bits of test counts (by, ch, cnt) under train counts; with fit_by, each group has a model of its own."""
    by, fit_by = by or [], fit_by or []
    total = train.groupBy(*fit_by).agg(F.sum("cnt").alias("total"))
    known = train.select(*fit_by, "ch", F.col("cnt").alias("seen"))
    joined = test.join(F.broadcast(known) if not fit_by else known, [*fit_by, "ch"], "left")
    joined = joined.join(total, fit_by, "left") if fit_by else joined.crossJoin(F.broadcast(total))
    cost = -F.log2((F.coalesce("seen", F.lit(0)) + smoothing) / (F.coalesce("total", F.lit(0)) + smoothing * size))
    return joined.groupBy(*by).agg(F.sum("cnt").alias("events"), F.sum(F.col("cnt") * cost).alias("bits"))


@dataclass
class Unigram(Model):
    """p(c) = (count + smoothing) / (total + smoothing * M)."""

    smoothing: float = 1.0
    kind = "unigram"

    def __post_init__(self) -> None:
        self.smoothing = self.values.get("smoothing", self.smoothing)
        if self.smoothing <= 0:
            raise ValueError("smoothing must be above 0")
        self.values = {"smoothing": self.smoothing}

    def fit(self, segments: DataFrame) -> Unigram:
        require_text(segments)
        return Unigram(self.alphabet, 1, {"counts": char_counts(segments)}, dict(self.values))

    def merge(self, other: Unigram) -> Unigram:
        """Counts of both."""
        both = self.tables["counts"].union(other.tables["counts"]).groupBy("ch").agg(F.sum("cnt").alias("cnt"))
        return Unigram(self.alphabet, 1, {"counts": both}, dict(self.values))

    def entropy(self) -> float:
        """Entropy of the training counts, without smoothing."""
        self.need()
        return self.tables["counts"].agg(entropy_of_counts().alias("h")).first()["h"]

    def costs(self, segments: DataFrame, by: list[str] | None = None) -> DataFrame:
        self.need()
        return smoothed_costs(self.tables["counts"], char_counts(segments, by), self.alphabet.size, self.smoothing, by)
