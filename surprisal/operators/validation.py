"""Block bootstrap and alphabet ablations."""

from __future__ import annotations

import hashlib
import warnings
from collections.abc import Callable, Iterator
from functools import partial
from itertools import groupby
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from surprisal.alphabet import Alphabet
from surprisal.functions.text import redundancy_of
from surprisal.models.base import Model
from surprisal.operators.segments import blocks

try:
    from _md5 import md5  # a third of the time, where Python has it
except ImportError:
    md5 = partial(hashlib.md5, usedforsecurity=False)
#: Draws that are held at once: a resample's draws come from the stream in pieces of this many.
DRAWS_AT_ONCE = 1 << 20
#: Blocks whose costs reach the driver, two numbers each, so that the draws follow numpy's stream (32 MB);
#: more blocks stay where they are and are resampled by poisson_bootstrap.
BLOCKS_MOST = 2_000_000


def block_costs(segments: DataFrame, model: Model, size: int = 2000, by: list[str] | None = None) -> DataFrame:
    """by, block (numbered from 0 in order of segment and place), events, bits."""
    by = by or []
    cut = blocks(segments, size).where("text <> ''")
    costs = model.costs(cut, [*by, "seg_id", "block_id"] if "seg_id" not in by else [*by, "block_id"])
    return costs


def numbered(costs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Events and bits of the blocks in order."""
    found = costs.orderBy("seg_id", "block_id").select(F.col("events").cast("double").alias("events"), "bits").toArrow()
    return found.column("events").to_numpy(), found.column("bits").to_numpy()


def draws(blocks_count: int, resamples: int, seed: int) -> np.ndarray:
    """Which blocks each resample draws, as one array."""
    r = np.random.default_rng(seed)
    return np.stack([r.integers(0, blocks_count, size=blocks_count) for _ in range(resamples)])


def resampled(events: np.ndarray, bits: np.ndarray, resamples: int, seed: int) -> np.ndarray:
    """Bits per event of each resample, with the draws of draws() in pieces of DRAWS_AT_ONCE."""
    r, n = np.random.default_rng(seed), len(events)
    out = np.zeros(resamples)
    for k in range(resamples):
        sums = np.zeros(2)
        for at in range(0, n, DRAWS_AT_ONCE):
            drawn = r.integers(0, n, size=min(DRAWS_AT_ONCE, n - at))
            sums += bits[drawn].sum(), events[drawn].sum()
        out[k] = sums[0] / sums[1]
    return out


def summary(values: np.ndarray, confidence: float) -> dict[str, float]:
    low, high = np.percentile(values, [50 * (1 - confidence), 100 - 50 * (1 - confidence)])
    return {"mean_bpc": float(values.mean()), "std_bpc": float(values.std(ddof=1)) if len(values) > 1 else 0.0, "ci_lower_bpc": float(low), "ci_upper_bpc": float(high)}


def _check(size: int, resamples: int, confidence: float) -> None:
    if not 0 < confidence < 1:
        raise ValueError("the confidence level must lie between 0 and 1")
    if resamples <= 0:
        raise ValueError("resamples must be above 0")
    if size <= 0:
        raise ValueError("blocks need a size above 0")


def block_bootstrap(segments: DataFrame, model: Model, block_size: int = 2000, n_resamples: int = 1000, confidence_level: float = 0.95, seed: int = 42) -> dict[str, Any]:
    """Mean, deviation and percentile interval of bits per event over resampled blocks.

    Blocks are scored once. Contexts begin anew with each block, which is exact for models without
    context and costs context models the context of a block's first characters.
    Up to BLOCKS_MOST blocks the draws follow numpy's stream; more are resampled by poisson_bootstrap.
    """
    _check(block_size, n_resamples, confidence_level)
    costs = block_costs(segments, model, block_size).persist()
    try:
        n = costs.count()
        if not n:
            raise ValueError("there is no text")
        if n > BLOCKS_MOST:
            found = poisson_bootstrap(costs, n_resamples, confidence_level, seed).first().asDict()
        else:
            found = summary(resampled(*numbered(costs), n_resamples, seed), confidence_level)
    finally:
        costs.unpersist()
    return found | {"n_resamples": n_resamples, "block_size": block_size, "confidence_level": confidence_level, "n_blocks": n}


def _poisson_sums(batches: Iterator[pa.RecordBatch], groups: int, resamples: int, seed: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """by, r, and the bits and events of a task's blocks (by, lead, events, bits) in each resample, each block as often as it is drawn there.

    A digest of 128 bits has the draws of four resamples; in SQL it is the same function."""
    bounds = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1)) for k in range(12)])
    # A draw of 32 bits is at or above a bound where it is so as a whole number.
    limits = [np.uint32(x) for x in map(int, np.ceil(bounds * (1 << 32))) if x < 1 << 32]
    tails = [f"{g}:{seed}".encode() for g in range((resamples - 1) // 4 + 1)]
    at_once = max(1, DRAWS_AT_ONCE // (4 * len(tails)))
    held: dict[tuple, np.ndarray] = {}

    def told() -> pa.RecordBatch:
        by = [pa.array([k[i] for k in held for _ in range(resamples)], kinds[i]) for i in range(groups)]
        out = pa.RecordBatch.from_arrays([*by, pa.array(np.tile(np.arange(resamples, dtype=np.int32), len(held))), *(pa.array(np.concatenate([v[j] for v in held.values()])) for j in (0, 1))], names=names)
        held.clear()
        return out

    for each in batches:
        kinds = each.schema.types[:groups]
        keys = list(zip(*(each.column(i).to_pylist() for i in range(groups)), strict=True)) if groups else [()] * each.num_rows
        leads = each.column(groups).to_pylist()
        costs = np.stack([each.column(groups + 2).to_numpy(zero_copy_only=False), each.column(groups + 1).to_numpy(zero_copy_only=False)])
        for a in range(0, len(leads), at_once):
            some = leads[a : a + at_once]
            digests = b"".join([md5(lead + tail).digest() for lead in map(str.encode, some) for tail in tails])
            drawn = np.frombuffer(digests, ">u4").astype(np.uint32).reshape(len(some), -1)[:, :resamples]
            times = np.zeros(drawn.shape, np.uint8)
            for x in limits:
                times += drawn >= x
            times = times.astype(float)
            places: dict[tuple, list[int]] = {}
            for i in range(len(some)):
                places.setdefault(keys[a + i], []).append(i)
            for key, rows in places.items():
                add = costs[:, a + rows[0] : a + rows[-1] + 1] @ times[rows[0] : rows[-1] + 1] if len(rows) == rows[-1] - rows[0] + 1 else costs[:, np.array(rows) + a] @ times[rows]
                held[key] = held[key] + add if key in held else add
            if len(held) * resamples > DRAWS_AT_ONCE:
                yield told()
    if held:
        yield told()


def poisson_bootstrap(costs: DataFrame, n_resamples: int = 1000, confidence_level: float = 0.95, seed: int = 42, by: list[str] | None = None) -> DataFrame:
    """The same for any number of blocks: each block counts Poisson(1) times in each resample, by a hash, in one pass.

    by, mean_bpc, std_bpc, ci_lower_bpc, ci_upper_bpc.
    """
    by = by or []
    keys = [c for c in costs.columns if c not in ("events", "bits")]
    lead = F.concat_ws(":", *(F.col(k).cast("string") for k in keys), F.lit(""))
    rows = costs.select(*(F.col(k).alias(f"by_{i}") for i, k in enumerate(by)), lead.alias("lead"), F.col("events").cast("double").alias("events"), F.col("bits").cast("double").alias("bits"))
    kind = StructType([*rows.schema.fields[: len(by)], StructField("r", IntegerType()), StructField("bits", DoubleType()), StructField("events", DoubleType())])
    sums = rows.mapInArrow(lambda batches: _poisson_sums(batches, len(by), n_resamples, seed, kind.names), kind)
    # A resample of no block has no figure.
    whole = sums.groupBy(*(F.col(f"by_{i}").alias(k) for i, k in enumerate(by)), "r").agg(F.sum("bits").alias("b"), F.sum("events").alias("e"))
    each = whole.where("e > 0").select(*by, "r", (F.col("b") / F.col("e")).alias("h"))
    low = (1 - confidence_level) / 2
    return each.groupBy(*by).agg(F.avg("h").alias("mean_bpc"), F.coalesce(F.stddev_samp("h"), F.lit(0.0)).alias("std_bpc"), F.percentile("h", F.lit(low)).alias("ci_lower_bpc"), F.percentile("h", F.lit(1 - low)).alias("ci_upper_bpc"))


def segment_bootstrap(segments: DataFrame, model: Model, **options: Any) -> dict[int, dict[str, Any]]:
    """block_bootstrap of each segment; a segment without text is left out."""
    size, n, level, seed = (options.get(k, v) for k, v in (("block_size", 2000), ("n_resamples", 1000), ("confidence_level", 0.95), ("seed", 42)))
    _check(size, n, level)
    done = {}
    ordered = block_costs(segments, model, size).orderBy("seg_id", "block_id").toLocalIterator()
    for seg, rows in groupby(ordered, lambda r: r["seg_id"]):
        events, bits = np.array([(r["events"], r["bits"]) for r in rows], float).T
        done[seg] = summary(resampled(events, bits, n, seed), level) | {"n_resamples": n, "block_size": size, "confidence_level": level, "n_blocks": len(events)}
    return done


def bootstrap_redundancy(*, bits_per_char: float, log2_alphabet_size: float, bootstrap_results: dict[str, Any]) -> dict[str, float]:
    """Redundancy and its interval: a high entropy bound is a low redundancy bound."""
    r = lambda h: redundancy_of(h, log2_alphabet_size) if h <= log2_alphabet_size else 0.0
    return {"redundancy": r(bits_per_char), "ci_lower_redundancy": r(bootstrap_results["ci_upper_bpc"]), "ci_upper_redundancy": r(bootstrap_results["ci_lower_bpc"])}


def sensitivity(*, model: Callable[[Alphabet], Model], base: Alphabet, train: DataFrame, test: DataFrame, variants: dict[str, Alphabet]) -> dict[str, Any]:
    """Entropy and redundancy of raw texts on the base alphabet and on each variant, each with a model of its own."""

    def run(alphabet: Alphabet) -> dict[str, Any]:
        on = lambda df: df.withColumn("text", alphabet.column(F.col("text")))
        h = model(alphabet).fit(on(train)).evaluate(on(test))
        return {"alphabet_name": alphabet.name, "alphabet_size": alphabet.size, "log2_alphabet_size": alphabet.log2_size, "bits_per_char": h, "redundancy": redundancy_of(h, alphabet.log2_size)}

    first = run(base)
    out = []
    for name, alphabet in variants.items():
        r = run(alphabet)
        rise = r["bits_per_char"] - first["bits_per_char"]
        out.append({"name": name, **r, "delta_bpc": rise, "delta_redundancy": r["redundancy"] - first["redundancy"], "relative_change": 100 * rise / first["bits_per_char"] if first["bits_per_char"] > 0 else 0.0})
    return {"baseline": first, "variants": out}


ABLATIONS = {"no_space": {"include_space": False}, "no_diacritics": {"include_diacritics": False}, "with_punctuation": {"include_punctuation": True}}
DEFAULT_ABLATIONS = {"ro": ["no_diacritics", "no_space"], "en": ["no_space"]}


def ablation_study(*, model: Callable[[Alphabet], Model], base: Alphabet, train: DataFrame, test: DataFrame, ablations: list[str]) -> dict[str, Any]:
    """sensitivity() for named ablations; unknown names are passed over with a warning."""
    for name in ablations:
        if name not in ABLATIONS:
            warnings.warn(f"no ablation is named {name}", stacklevel=2)
    return sensitivity(model=model, base=base, train=train, test=test, variants={n: base.variant(**ABLATIONS[n]) for n in ablations if n in ABLATIONS})
