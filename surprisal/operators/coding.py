"""Code lengths under a model, checked along two unlike paths."""

from __future__ import annotations

import math
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surprisal.models.base import Model
from surprisal.models.ppm import PPM
from surprisal.operators.segments import carried


#: Contexts of a model that is broadcast for replaying.
REPLAYED_MOST = 300_000


def codelength(segments: DataFrame, model: Model) -> float:
    """Bits of all segments: summed over symbols for models that give symbols a probability, else H times the length."""
    if isinstance(model, PPM):
        row = model.costs(segments).first()
        if not row or not row["events"]:
            raise ValueError("there is no text")
        return row["bits"]
    h = model.evaluate(segments)
    return h * (segments.agg(F.sum(F.length("text"))).first()[0] or 0)


def replayed_codelength(segments: DataFrame, model: PPM) -> tuple[int, float]:
    """Characters and bits by walking the contexts symbol by symbol, in Arrow batches, over the model's broadcast tables.

    This is the check's second path, for models of REPLAYED_MOST contexts at most, some 100 MB in a worker.
    """
    if model.boundary != "segment":
        segments = carried(segments, model.order)
    symbols = {(r["ctx"], r["sym"]): r["cnt"] for r in model.symbols().toLocalIterator()}
    contexts = {r["ctx"]: (r["n"], r["u"]) for r in model.tables["contexts"].toLocalIterator()}
    held = segments.sparkSession.sparkContext.broadcast((symbols, contexts, model.order, model.alphabet.size))

    @F.pandas_udf("double")
    def cost(texts: pd.Series, lefts: pd.Series) -> pd.Series:
        known, seen, depth, size = held.value

        def one(text: str | None, left: str) -> float:
            bits, text = 0.0, left + (text or "")
            for i in range(len(left), len(text)):
                c = text[i]
                for k in range(min(i, depth), -1, -1):
                    if (nu := seen.get(ctx := text[i - k : i])) is None:
                        continue
                    if cnt := known.get((ctx, c)):
                        bits -= math.log2(cnt / sum(nu))
                        break
                    bits -= math.log2(nu[1] / sum(nu))
                else:
                    bits += math.log2(size)
            return bits

        return pd.Series([one(t, x) for t, x in zip(texts, lefts, strict=True)], dtype=float)

    left = F.col("left") if model.boundary != "segment" else F.lit("")
    row = segments.agg(F.sum(F.length("text")).alias("n")).first()
    return row["n"], segments.select(cost("text", left).alias("b")).agg(F.sum("b")).first()[0]


def verify_codelength(segments: DataFrame, model: Model, tolerance: float = 1e-3) -> dict[str, Any]:
    """The cross-entropy from joins beside the code length from replaying; a model too large to replay is summed again by segments."""
    h = model.evaluate(segments)
    if isinstance(model, PPM) and model.boundary == "segment" and model.context_tree_size() > REPLAYED_MOST:
        row = model.costs(segments, ["seg_id"]).agg(F.sum("bits"), F.sum("events")).first()
        per = row[0] / row[1]
    elif isinstance(model, PPM) and not model.update_exclusion and model.context_tree_size() <= REPLAYED_MOST:
        n, bits = replayed_codelength(segments, model)
        per = bits / n
    else:
        per = codelength(segments, model) / segments.agg(F.sum(F.length("text"))).first()[0]
    return {"cross_entropy_bpc": h, "codelength_bpc": per, "delta_bpc": abs(h - per), "matches": abs(h - per) < tolerance}


class ArithmeticCoder:
    """Sizes of ideal arithmetic codes: the payload has the right length and no content."""

    def __init__(self, precision: int = 32) -> None:
        if precision <= 0:
            raise ValueError("the precision must be above 0")
        self.precision = precision

    def encode(self, segments: DataFrame, model: Model) -> bytes:
        return self.encode_with_model(segments, model)[0]

    def encode_with_model(self, segments: DataFrame, model: Model) -> tuple[bytes, float]:
        bits = codelength(segments, model)
        return bytes(max(1, (math.ceil(bits) + 7) // 8)), bits
