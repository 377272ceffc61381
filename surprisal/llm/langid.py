"""Language identification by rank-order profiles of character n-grams.

A profile lists the most frequent 1- to 5-grams of lower-cased words padded with a blank on either
side, in order of frequency; grams of equal frequency go by their hash. A document's list is compared
with each language's by the out-of-place distance: the sum of differences in rank, a gram that a
profile lacks counting as the profile's length. The nearest profile wins, the smaller name among
equals. The score is the winner's share of all likenesses.

Profiles are learned from all grams of a bounded sample: about SAMPLE documents of each language
(every one where there are fewer), chosen by a hash of doc_id, among rows that are not held out. The
driver and each worker hold PROFILE numbers a language, whatever the number of documents.

Defined results: a null text and one without letters are `und` with score 0; so is everything where
no language could be learned; repeated rows each get their result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surprisal.llm.common import crc_mod, hash_order, map_batches, prepare
from surprisal.llm.flatwords import LETTER, _tables

SAMPLE, LONGEST, PROFILE, DOCUMENT = 4000, 5, 500, 300
BLANK = 0
MULTIPLY = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Whether a code point is a letter, and its random number."""
    kinds, numbers = _tables()
    return kinds == LETTER, numbers


def gram_keys(text: str | None) -> np.ndarray:
    """The hashes of all grams of a text, in no order, with repeats."""
    raw = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
    is_letter, numbers = _letters()
    letter = is_letter[raw]
    if not letter.any():
        return np.zeros(0, np.uint64)
    # Each run of other characters becomes one blank, and blanks stand at both ends.
    points = np.r_[np.uint32(BLANK), np.where(letter, raw, BLANK).astype(np.uint32), np.uint32(BLANK)]
    points = points[np.r_[True, (points[1:] != BLANK) | (points[:-1] != BLANK)]]
    blank, values = points == BLANK, numbers[points]
    out, rolled = [values[~blank]], values
    inner = np.zeros(len(points), bool)
    for n in range(2, LONGEST + 1):
        if len(points) < n:
            break
        rolled = rolled[:-1] * MULTIPLY + values[n - 1 :]
        if n > 2:  # a blank within a gram would join two words
            inner = inner[: len(points) - n + 1] | blank[n - 2 : len(points) - 1]
        out.append(rolled[~inner[: len(rolled)]])
    return np.concatenate(out)


def ranked(keys: np.ndarray, most: int) -> np.ndarray:
    """The most frequent keys, by frequency and then by value."""
    ordered = np.sort(keys)
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    count, distinct = np.diff(np.r_[first, len(ordered)]), ordered[first]
    if len(count) > most:
        least = np.partition(count, -most)[-most]
        over, ties = np.flatnonzero(count > least), np.flatnonzero(count == least)
        picked = np.sort(np.r_[over, ties[: most - len(over)]])
        count, distinct = count[picked], distinct[picked]
    return distinct[np.argsort(-count, kind="stable")]


class Profiles:
    """The profiles of all languages as one table of ranks."""

    def __init__(self, by_language: dict[str, list[int]]) -> None:
        self.names = sorted(by_language)
        self.keys = np.unique(np.array([k for v in by_language.values() for k in v], np.int64).view(np.uint64))
        self.ranks = np.full((len(self.keys), len(self.names)), -1, np.int64)
        for j, name in enumerate(self.names):
            mine = np.array(by_language[name], np.int64).view(np.uint64)
            self.ranks[np.searchsorted(self.keys, mine), j] = np.arange(len(mine))

    def predict(self, text: str | None) -> tuple[str, float]:
        keys = gram_keys(text)
        if not len(keys) or not self.names:
            return "und", 0.0
        mine = ranked(keys, DOCUMENT)
        at = np.searchsorted(self.keys, mine)
        at[at == len(self.keys)] = 0
        theirs = np.where((self.keys[at] == mine)[:, None], self.ranks[at], -1)
        apart = np.where(theirs < 0, PROFILE, np.abs(theirs - np.arange(len(mine))[:, None])).sum(axis=0)
        alike = 1 - apart / (PROFILE * len(mine))
        best, total = int(np.argmin(apart)), float(alike.sum())
        return self.names[best], float(alike[best]) / total if total > 0 else 1 / len(self.names)


def is_held_out(doc_id: str = "doc_id") -> Column:
    return crc_mod(F.col(doc_id), 4) == 2


def sample(docs: DataFrame, size: int = SAMPLE) -> DataFrame:
    """text, lang of about size documents of each language."""
    known = docs.where(F.col("lang").isNotNull() & ~is_held_out())
    share = known.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(size)) / F.count("*")).alias("__share"))
    return known.join(F.broadcast(share), "lang").where(F.pmod(hash_order(F.col("doc_id")), F.lit(1 << 20)) < F.col("__share") * (1 << 20)).select("text", "lang")


def learn(docs: DataFrame, size: int = SAMPLE) -> Profiles:
    """Count the sample's grams on the executors and keep the first PROFILE of each language."""
    prepare(docs.sparkSession)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, keys, counts = [], [], []
        rows = list(zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True))
        for lang in sorted({x for _, x in rows}):
            mine = [gram_keys(t) for t, x in rows if x == lang]
            k, n = np.unique(np.concatenate(mine), return_counts=True)
            langs += [lang] * len(k)
            keys.append(k.view(np.int64))
            counts.append(n)
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(keys)), pa.array(np.concatenate(counts).astype(np.int64))], ["lang", "gram", "n"])

    counted = map_batches(sample(docs, size), "lang string, gram bigint, n bigint", step).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Unsigned order of the hash breaks ties, as ranked() does.
    unsigned = F.col("gram").bitwiseXOR(F.lit(-(2**63)))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), unsigned))
    rows = counted.withColumn("rank", first).where(F.col("rank") <= PROFILE).collect()
    by: dict[str, list[int]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        by.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(by)


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred, score of every row, from its text alone."""
    spark = prepare(docs.sparkSession)
    held = spark.sparkContext.broadcast(profiles)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [held.value.predict(x) for x in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())], ["doc_id", "lang_pred", "score"])

    return map_batches(docs.select("doc_id", "text"), "doc_id bigint, lang_pred string, score double", step)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    return predict(docs, learn(docs)).select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")
