"""Quality classifier: naive Bayes support vectors over byte n-gram indicators.

A text's features are the distinct byte 1-, 2- and 3-grams of its UTF-8 form, and indicators of word
n-grams that are one word repeated. Each indicator is scaled by the log ratio of its smoothed class
counts. A constant joins them, the vector is brought to unit length, and a linear hinge-loss model is
fit by dual coordinate descent. The constant is as large as the median text's other features
together, so a text of few features leans towards what such texts are, not towards the noise of a few
grams. Scores are the margins through a sigmoid that is fit on a fifth of the sample which the weights
have not seen.

The classifier is fit on a bounded sample of labelled rows: SAMPLE of each class, taken in a
reproducible pseudo-random order of doc_id, less those of over TEXT_BYTES, so that the driver holds at
most 0.8 MB for each of 2 * SAMPLE rows (ordinary texts take some 10 KB). Scoring covers every row and
whole texts.

Defined results: a null text is the empty text; without labelled rows every score is 0.5, and with
a single class about 1 or about 0 as that class says; repeated labels of a document count once, with
the higher quality; repeated documents each get their score.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surprisal.llm.common import crc_mod, hash_order, map_batches, prepare

SAMPLE, TEXT_BYTES = 2000, 1 << 16
SMOOTHING, COST, ROUNDS = 1.0, 1.0, 12
#: How many times in a row a word stands, of the word n-grams that count.
REPEATS = range(2, 7)


def grams(text: str | None) -> np.ndarray:
    """The distinct byte 1-, 2- and 3-grams and the word repeats, numbered so that no two kinds share a number; sorted."""
    raw = np.frombuffer((text or "").encode(), np.uint8).astype(np.int32)
    seen = np.zeros(1 << 16, bool)
    out = [np.flatnonzero(np.bincount(raw, minlength=256)).astype(np.int32)] if len(raw) else []
    if len(raw) > 1:
        two = raw[:-1] << 8 | raw[1:]
        seen[two] = True
        out.append((np.flatnonzero(seen) + (1 << 8)).astype(np.int32))
    if len(raw) > 2:
        three = np.sort(two[:-1] << 8 | raw[2:])
        out.append(three[np.r_[True, three[1:] != three[:-1]]] + np.int32((1 << 16) + (1 << 8)))
    words = (text or "").split()
    same = np.fromiter(map(eq, words[1:], words), bool, max(len(words) - 1, 0))
    for n in REPEATS:
        if not same.any():
            break
        out.append(np.array([(1 << 25) + n], np.int32))
        same = same[1:] & same[:-1] if len(same) > 1 else same[:0]
    return np.concatenate(out) if out else np.zeros(0, np.int32)


@dataclass
class Model:
    """keys: known grams, sorted; ratio: their log-count ratios; weight: of the scaled indicators; constant, bias: the constant feature and its weight; slope, shift: of the sigmoid."""

    keys: np.ndarray
    ratio: np.ndarray
    weight: np.ndarray
    constant: float = 0.0
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, features: np.ndarray) -> float:
        if not len(self.keys):
            return 0.0
        at = np.searchsorted(self.keys, features)
        at[at == len(self.keys)] = 0
        at = at[self.keys[at] == features]
        scaled = self.ratio[at]
        return (float(scaled @ self.weight[at]) + self.constant * self.bias) / max(float(np.sqrt(scaled @ scaled + self.constant**2)), 1e-12)

    def score(self, text: str | None) -> float:
        z = np.clip(self.slope * self.margin(grams(text)) + self.shift, -30, 30)
        return float(1 / (1 + np.exp(-z)))


def dual_descent(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, size: int, cost: float = COST, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of a linear hinge-loss model of unit-length sparse rows (places, values)."""
    weight, alpha = np.zeros(size), np.zeros(len(rows))
    order = np.random.default_rng(7)
    # Classes of unlike size weigh the same.
    limit = np.where(signs > 0, cost * len(signs) / (2 * max((signs > 0).sum(), 1)), cost * len(signs) / (2 * max((signs < 0).sum(), 1)))
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            slope = signs[i] * (weight[at] @ x) - 1
            new = min(max(alpha[i] - slope, 0.0), limit[i])
            if step := new - alpha[i]:
                alpha[i] = new
                weight[at] += step * signs[i] * x
                moved += abs(step)
        if moved < 1e-3 * len(rows):
            break
    return weight


def train(features: list[np.ndarray], labels: np.ndarray) -> Model:
    """Fit on feature arrays and 0/1 labels."""
    none = Model(np.zeros(0, np.int32), np.zeros(0), np.zeros(0))
    if not len(labels) or labels.min() == labels.max():
        none.shift = 0.0 if not len(labels) else 100.0 if labels[0] else -100.0
        return none
    fit = np.arange(len(labels)) % 5 != 0
    if len(set(labels[fit].tolist())) < 2 or len(set(labels[~fit].tolist())) < 2:
        fit = np.ones(len(labels), bool)
    keys, code = np.unique(np.concatenate([f for f, k in zip(features, fit, strict=True) if k]), return_inverse=True)
    owner = np.repeat(labels[fit], [len(f) for f, k in zip(features, fit, strict=True) if k])
    p, q = (SMOOTHING + np.bincount(code[owner == c], minlength=len(keys)) for c in (1, 0))
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    used = np.flatnonzero(fit)
    places = [np.searchsorted(keys, features[i]) for i in used]
    constant = float(np.sqrt(np.median([ratio[at] @ ratio[at] for at in places])))
    rows = []
    for at in places:
        scaled = np.append(ratio[at], constant)
        rows.append((np.append(at, len(keys)), scaled / max(np.sqrt(scaled @ scaled), 1e-12)))
    weight = dual_descent(rows, np.where(labels[used] == 1, 1.0, -1.0), len(keys) + 1)
    weight, bias = weight[:-1], float(weight[-1])
    model = Model(keys, ratio, weight, constant, bias)
    held = np.flatnonzero(~fit) if not fit.all() else used
    model.slope, model.shift = sigmoid(np.array([model.margin(features[i]) for i in held]), labels[held])
    return model


def sigmoid(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the likeliest sigmoid with smoothed targets, classes weighing the same; by Newton steps."""
    n1, n0 = (labels == 1).sum(), (labels == 0).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    mass = np.where(labels == 1, 0.5 / max(n1, 1), 0.5 / max(n0, 1)) * len(labels)
    scale = max(float(np.abs(margins).mean()), 1e-9)
    x = np.stack([margins / scale, np.ones(len(margins))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        s = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (mass * (s - target)) + 1e-3 * w
        curve = (x * (mass * s * (1 - s))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        w -= np.clip(step, -5, 5)
    return float(w[0]) / scale, float(w[1])


def is_held_out(doc_id: str = "doc_id") -> Column:
    return crc_mod(F.col(doc_id), 3) == 1


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """text, quality of a bounded sample of labelled rows outside the held-out third: at most size documents of each class."""
    known = labels.where("quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality")).where(~is_held_out())
    some = [known.where(F.col("quality") == c).orderBy(hash_order(F.col("doc_id")), "doc_id").limit(size) for c in (0, 1)]
    chosen = some[0].union(some[1]).select(F.col("doc_id").alias("__id"), "quality")
    found = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= TEXT_BYTES).join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    return found.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("text", "quality")


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    """Features are taken on the executors; the driver gets their numbers, of 2 * size rows at most."""
    prepare(docs.sparkSession)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [grams(x).tobytes() for x in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), batch.column("quality")], ["grams", "quality"])

    found = map_batches(sample(docs, labels, size), "grams binary, quality int", step).toLocalIterator()
    rows = sorted((bytes(r[0]), r[1]) for r in found)
    np.random.default_rng(11).shuffle(order := np.arange(len(rows)))
    rows = [rows[i] for i in order]
    return train([np.frombuffer(g, np.int32) for g, _ in rows], np.array([q for _, q in rows], np.int64))


def score(docs: DataFrame, model: Model, extra: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns extra and the score (0 to 1), under name, of every row."""
    spark, extra = prepare(docs.sparkSession), extra or ["doc_id"]
    held = spark.sparkContext.broadcast(model)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [held.value.score(x) for x in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in extra), pa.array(made, pa.float64())], [*extra, name])

    kinds = dict(docs.dtypes)
    return map_batches(docs.select(*dict.fromkeys([*extra, "text"])), ", ".join(f"`{c}` {kinds[c]}" for c in extra) + f", `{name}` double", step)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return score(docs, fit(docs, labels)).select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not rejected."""
    name = "__quality_score"
    return score(docs, fit(docs, labels), docs.columns, name).where(F.col(name) >= 0.5).drop(name)
