"""What all models share: tables, alphabet, saving and loading.

A model's `fit` is pure: it returns a model made of DataFrames and plain values. `costs` gives for any
segments the characters (or events) and bits of each group of rows; `evaluate` is their ratio. Models
are saved as Parquet tables beside a row of JSON with their plain values.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surprisal.alphabet import NAMED, Alphabet


@dataclass
class Model:
    alphabet: Alphabet
    order: int = 1
    tables: dict[str, DataFrame] = field(default_factory=dict)
    values: dict[str, Any] = field(default_factory=dict)

    kind = "model"

    def fit(self, segments: DataFrame) -> Model:
        raise NotImplementedError

    def costs(self, segments: DataFrame, by: list[str] | None = None) -> DataFrame:
        """by, events, bits."""
        raise NotImplementedError

    def need(self) -> None:
        if not self.tables:
            raise RuntimeError(f"this {self.kind} model is not fit")

    def cached(self) -> Model:
        """Keep the tables in memory while several scores are taken."""
        for t in self.tables.values():
            t.persist()
        return self

    def released(self) -> Model:
        """Take back cached()."""
        for t in self.tables.values():
            t.unpersist()
        return self

    def evaluate(self, segments: DataFrame) -> float:
        """Mean bits of an event; raises where there is none."""
        self.need()
        row = self.costs(segments).first()
        if not row or not row["events"]:
            raise ValueError("there is no text")
        return row["bits"] / row["events"]

    def to_dict(self) -> dict[str, Any]:
        return {"model_type": self.kind, "order": self.order, "alphabet_name": self.alphabet.name, "alphabet_size": self.alphabet.size} | self.values

    def save(self, path: str) -> None:
        self.need()
        spark = next(iter(self.tables.values())).sparkSession
        for name, t in self.tables.items():
            t.write.mode("overwrite").parquet(f"{path}/{name}")
        meta = {"kind": self.kind, "order": self.order, "alphabet": self.alphabet.name, "symbols": "".join(self.alphabet.symbols), "flags": [self.alphabet.include_space, self.alphabet.include_punctuation, self.alphabet.include_diacritics], "values": self.values, "tables": sorted(self.tables)}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        if meta["kind"] != cls.kind:
            raise ValueError(f"{path} holds a {meta['kind']} model")
        alphabet = NAMED.get(meta["alphabet"]) or Alphabet(meta["alphabet"], tuple(meta["symbols"]), *meta["flags"])
        return cls(alphabet, meta["order"], {t: spark.read.parquet(f"{path}/{t}") for t in meta["tables"]}, meta["values"])


def require_text(segments: DataFrame, text: str = "text") -> None:
    if segments.where(F.length(text) > 0).isEmpty():
        raise ValueError("there is no text")
