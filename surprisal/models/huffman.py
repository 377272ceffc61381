"""Optimal prefix codes. Counting is distributed; the tree is built from the counted symbols, as many as the alphabet has."""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surprisal.models.base import Model
from surprisal.operators.counts import char_counts, counts_and_places


def code_table(ranked: list[tuple[str, int]]) -> dict[str, str]:
    """Codes of (symbol, count) in order of first occurrence, which breaks ties; a single symbol gets 0."""
    if len(ranked) == 1:
        return {ranked[0][0]: "0"}
    heap: list[tuple[int, int, list[str]]] = [(n, i, [s]) for i, (s, n) in enumerate(ranked)]
    heapq.heapify(heap)
    codes = {s: "" for s, _ in ranked}
    tie = len(ranked)
    while len(heap) > 1:
        pair = heapq.heappop(heap), heapq.heappop(heap)
        for bit, (_, _, symbols) in zip("01", pair, strict=True):
            for s in symbols:
                codes[s] = bit + codes[s]
        heapq.heappush(heap, (pair[0][0] + pair[1][0], tie, pair[0][2] + pair[1][2]))
        tie += 1
    return codes


@dataclass
class Huffman(Model):
    kind = "huffman"

    def fit(self, segments: DataFrame, seg_id: str = "seg_id") -> Huffman:
        counts = counts_and_places(segments, seg_id)
        if not counts:
            raise ValueError("there is no text")
        codes = code_table(counts)
        rows = [(ch, cnt, codes[ch], len(codes[ch])) for ch, cnt in counts]
        table = segments.sparkSession.createDataFrame(rows, "ch string, cnt bigint, code string, code_len int")
        total = sum(r[1] for r in rows)
        values = {"avg_code_length": sum(r[1] * r[3] for r in rows) / total, "max_code_length": max(r[3] for r in rows), "unique_chars": len(rows)}
        return Huffman(self.alphabet, 1, {"codes": table}, values)

    def codes(self) -> list[dict[str, Any]]:
        """Symbols with their codes, by length and symbol."""
        self.need()
        return [r.asDict() for r in self.tables["codes"].orderBy("code_len", "ch").collect()]

    def costs(self, segments: DataFrame, by: list[str] | None = None) -> DataFrame:
        """Symbols without a code cost log2 M."""
        self.need()
        by = by or []
        coded = char_counts(segments, by).join(F.broadcast(self.tables["codes"].select("ch", "code_len")), "ch", "left")
        bits = F.coalesce(F.col("code_len").cast("double"), F.lit(self.alphabet.log2_size if self.alphabet.size > 1 else 0.0))
        return coded.groupBy(*by).agg(F.sum("cnt").alias("events"), F.sum(F.col("cnt") * bits).alias("bits"))
