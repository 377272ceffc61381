"""Document fingerprints by winnowing.

All GRAM-character hashes of a text, the minimum of each WINDOW of successive hashes (the rightmost
of equal ones), and the positions of the chosen ones. Two texts that share GRAM + WINDOW - 1
characters in a row are sure to share a fingerprint. Texts shorter than GRAM count as one gram, texts
with fewer than WINDOW grams as one window.

The likeness of two fingerprints is the share of common hashes among all of either. Two empty texts
are alike (1), an empty and another text are not (0).

For the next document, rows are dealt by ranges of doc_id into buckets, and a copy of the first row
of each bucket goes to the bucket before (that of the first to the last), so that one shuffle does.

Defined results: a null text is the empty text; rows with equal doc_id follow each other by text; a
null doc_id comes first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surprisal.llm.common import prepare, range_bounds, with_range
from surprisal.llm.flatwords import _tables

GRAM, WINDOW = 16, 32
MULTIPLY = np.uint64(0xD6E8FEB86659FD93)
NULL_ID = -(2**63)


def winnow(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The chosen hashes and their positions (first character of the gram), in order."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if not len(points):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = min(gram, len(points))
    # A power of MULTIPLY for each place; sums double in length, so few steps reach n characters.
    values, out, done = _tables()[1][points], np.zeros(len(points) - n + 1, np.uint64), 0
    block, size, rest = values, 1, n
    while rest:
        if rest & 1:
            out = out * np.uint64(pow(int(MULTIPLY), size, 2**64)) + block[done : done + len(out)]
            done += size
        rest >>= 1
        if rest:
            block = block[:-size] * np.uint64(pow(int(MULTIPLY), size, 2**64)) + block[size:]
            size *= 2
    w = min(window, len(out))
    at = _sliding_argmin(out, w)
    at = at[np.r_[True, at[1:] != at[:-1]]]
    return out[at], at


def _sliding_argmin(x: np.ndarray, w: int) -> np.ndarray:
    """Where the minimum of each window lies, the rightmost of equal ones."""
    at, size = np.arange(len(x)), 1
    better = lambda a, b: np.where(x[b] <= x[a], b, a)
    while 2 * size <= w:
        at = better(at[:-size], at[size:])
        size *= 2
    return better(at[: len(x) - w + 1], at[w - size : w - size + len(x) - w + 1]) if size < w else at


def written(hashes: np.ndarray, places: np.ndarray) -> str:
    """hash:position pairs, hashes hexadecimal."""
    return " ".join([f"{h:016x}:{p}" for h, p in zip(hashes.tolist(), places.tolist(), strict=True)])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    a, b = np.unique(a), np.unique(b)
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def edited(text: str, following: str) -> str:
    """The text with its second half replaced by the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, hashes, positions of every row."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [winnow(x or "", gram, window) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([h.view(np.int64) for h, _ in made], pa.list_(pa.int64())), pa.array([p for _, p in made], pa.list_(pa.int64()))], ["doc_id", "hashes", "positions"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, hashes array<bigint>, positions array<bigint>")


def with_followers(docs: DataFrame) -> DataFrame:
    """bucket, id, text and tail of docs, dealt and sorted so that each row's follower is the next row of its bucket.

    Rows with tail are copies of another bucket's first row and only follow.
    """
    rows = docs.select(F.col("doc_id"), F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = range_bounds(rows, "id", "text")
    placed = with_range(rows, "id", bounds, "bucket")
    firsts = sorted(map(tuple, with_range(rows.select("id"), "id", bounds, "bucket").groupBy("bucket").agg(F.min("id")).collect()))
    # By bucket: its first id, and the bucket before it that has rows; 16 bytes for each 24 MB of text, looked up without a join.
    first, before = [None] * (len(bounds) + 1), [None] * (len(bounds) + 1)
    for i, (b, low) in enumerate(firsts):
        first[b], before[b] = low, firsts[i - 1][0]
    held = docs.sparkSession.createDataFrame(pa.table({"first": [first], "before": [before]}, pa.schema([("first", pa.list_(pa.int64())), ("before", pa.list_(pa.int32()))])))
    placed = placed.withColumns({c: F.element_at(held.select(c).scalar(), F.col("bucket") + 1) for c in ("first", "before")})
    own = F.struct(F.col("bucket").cast("int").alias("bucket"), F.lit(False).alias("tail"))
    copy = F.struct(F.col("before").alias("bucket"), F.lit(True).alias("tail"))
    spread = placed.withColumn("to", F.explode(F.when(F.col("id") == F.col("first"), F.array(own, copy)).otherwise(F.array(own))))
    dealt = spread.select("to.bucket", "to.tail", "doc_id", "id", "text")
    return dealt.repartitionById(len(bounds) + 1, "bucket").sortWithinPartitions("bucket", "tail", "id", "text")


def report(docs: DataFrame) -> DataFrame:
    """Each document, its edited text, both fingerprints, and how alike its fingerprint is to the edited text's and the next document's."""
    prepare(docs.sparkSession)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def row(doc_id: int | None, text: str, mine: tuple, following: str, theirs: tuple) -> tuple:
        changed = edited(text, following)
        new = winnow(changed)
        return doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), written(*mine), written(*new), likeness(mine[0], new[0]), likeness(mine[0], theirs[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            out = []
            for bucket, tail, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "tail", "doc_id", "text")), strict=True):
                now = winnow(text)
                if last and last[0] == bucket and not last[1]:
                    out.append(row(*last[2:], text, now))
                last = bucket, tail, doc_id, text, now
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)

    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_followers(docs).mapInArrow(run, schema)
