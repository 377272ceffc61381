"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint is eight positional bytes. Two fingerprints that differ in 3 bits at most differ in 3
bytes at most, so they share at least five of eight positional bytes: the guaranteed minimum. The
index is keyed by three positions at once, all within one half of the fingerprint. Of five shared
positions three always lie in one half, so eight such keys (four triples in each half) miss no pair,
and a key is 24 bits wide, which keeps its postings short. Within a posting list the shared
positional bytes of each pair are tallied, pairs with fewer than MIN_SHARED are dropped, and the rest
verified by their differing bits.

A posting list longer than LIST_MOST is never handled as it is. Its members are indexed again by two
more of the five other positions (ten ways, again without loss). Lists that are still too long
consist of distinct fingerprints that agree in five bytes, so at most 2**24 of them; there, two
fingerprints link exactly if they agree after three of the 24 free bits are blanked, which finds
links by sorting, without pairs.

Only distinct fingerprints are linked; lists yield a star for each connected part, not its links. So
copies, and near copies by the thousand, cost no pairs.

Defined results: a text without words, empty or null has fingerprint zero and links as any other; a
null doc_id never names a component unless there is no other; repeated rows share a component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surprisal.llm.common import map_batches, materialize, prepare
from surprisal.llm.components import components, lowest

SHINGLE, SEED, MAX_BITS = 3, 42, 3
MIN_SHARED = 8 - MAX_BITS
LIST_MOST = 4096
#: Shingles whose bits are counted at once.
PIECE = 1 << 16
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
TRIPLES = [c for half in (range(4), range(4, 8)) for c in combinations(half, 3)]
MASK_PARTS = 8


def majority(hashes: np.ndarray) -> int:
    """The 64-bit fingerprint of some hashes: a bit is 1 if set in over half of them."""
    ones = sum(np.unpackbits(hashes[i : i + PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for i in range(0, len(hashes), PIECE))
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0]) if len(hashes) else 0


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return 0
    grams = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))) if len(words) >= shingle else [b" ".join(words)]
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, len(grams)))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (as a signed long) and th, a hash of the text, of every row."""
    prepare(docs.sparkSession)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(x or "", shingle) for x in batch.column("text").to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps), batch.column("th")], ["doc_id", "fp", "th"])

    return map_batches(docs.select("doc_id", "text", text_hash().alias("th")), "doc_id bigint, fp bigint, th bigint", step)


def text_hash(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _byte(position: int) -> Column:
    return F.shiftrightunsigned("fp", 8 * position).bitwiseAND(F.lit(0xFF))


def _key(number: int, positions: tuple[int, ...]) -> Column:
    out = F.lit(number).cast("long")
    for p in positions:
        out = F.shiftleft(out, 8).bitwiseOR(_byte(p))
    return out


def _listed(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of posting lists with two members or more: the bounded ones, and the long ones."""
    size = keyed.groupBy("key").count().where("count > 1")
    both = keyed.join(size, "key")
    return both.where(F.col("count") <= LIST_MOST).select("key", "fp"), both.where(F.col("count") > LIST_MOST).select("key", "fp")


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """The tally of shared positional bytes, given the exclusive or of two fingerprints."""
    return (np.ascontiguousarray(x).view(np.uint8).reshape(*x.shape, 8) == 0).sum(axis=-1)


def forest(members: np.ndarray) -> list[tuple[int, int]]:
    """For each part connected by links of MAX_BITS differing bits, its first member with each other one; members are distinct."""
    left, links = members, []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        start = int(front[0])
        while len(front) and len(left):
            taken = np.zeros(len(left), bool)
            for x in front.tolist():
                free = np.flatnonzero(~taken)
                apart = left[free] ^ np.uint64(x)
                some = shared_bytes(apart) >= MIN_SHARED
                free, apart = free[some], apart[some]
                near = free[_bits(apart) <= MAX_BITS]
                links += [(start, y) for y in left[near].tolist()]
                taken[near] = True
            front, left = left[taken], left[~taken]
    return links


def _pairs(key: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Links of whole posting lists, which lie one after another."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    two = first[size == 2]
    apart = fp[two] ^ fp[two + 1]
    two = two[(shared_bytes(apart) >= MIN_SHARED) & (_bits(apart) <= MAX_BITS)]
    out = [np.stack([fp[two], fp[two + 1]], axis=1)]
    for a, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        if links := forest(fp[a : a + n]):
            out.append(np.array(links, np.uint64))
    return np.concatenate(out)


def _list_links(lists: DataFrame) -> DataFrame:
    """Links of bounded posting lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(links: np.ndarray) -> pa.RecordBatch:
            signed = links.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(signed[:, 0].copy()), pa.array(signed[:, 1].copy())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.concatenate([held_key, batch.column("key").to_numpy()])
            fp = np.concatenate([held_fp, batch.column("fp").to_numpy().view(np.uint64)])
            cut = int(np.searchsorted(key, key[-1]))
            held_key, held_fp = key[cut:], fp[cut:]
            if cut:
                yield out(_pairs(key[:cut], fp[:cut]))
        if len(held_key):
            yield out(_pairs(held_key, held_fp))

    return lists.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint")


def blank_links(free: int, fps: np.ndarray, part: int, parts: int = MASK_PARTS) -> np.ndarray:
    """(member, root) links of distinct fingerprints that agree but for the bits of free, over one part of the masks."""
    bits = [i for i in range(64) if free >> i & 1]
    masks = [sum(1 << b for b in c) for c in list(combinations(bits, MAX_BITS))[part::parts]]
    label = np.arange(len(fps))
    while True:
        before = label.copy()
        for m in masks:
            blanked = fps & np.uint64(~m & (2**64 - 1))
            order = np.argsort(blanked, kind="stable")
            start = np.flatnonzero(np.r_[True, np.diff(blanked[order]) != 0])
            if len(start) == len(fps):
                continue
            low = np.repeat(np.minimum.reduceat(label[order], start), np.diff(np.r_[start, len(fps)]))
            label[order] = low
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return np.stack([fps[moved], fps[label[moved]]], axis=1)


def _long_links(long: DataFrame) -> DataFrame:
    """Links of posting lists that agree in five bytes and are still long."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fps = np.sort(pdf["fp"].to_numpy().view(np.uint64))
        free = int(np.bitwise_or.reduce(fps ^ fps[0]))
        links = blank_links(free, fps, int(pdf["part"].iloc[0])).view(np.int64)
        return pd.DataFrame({"a": links[:, 0], "b": links[:, 1]})

    spread = long.withColumn("part", F.explode(F.array(*map(F.lit, range(MASK_PARTS)))))
    return spread.groupBy("key", "part").applyInPandas(run, "a bigint, b bigint")


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links that connect whatever fingerprints of distinct (fp, no repeats) link."""
    keys = F.array(*(_key(i, t) for i, t in enumerate(TRIPLES)))
    short, long = _listed(distinct.select("fp", F.explode(keys).alias("key")))
    long = materialize(long, "long-lists")
    again = [(i, p) for i, t in enumerate(TRIPLES) for p in combinations([x for x in range(8) if x not in t], 2)]
    narrower = F.array(*(F.when(F.shiftrightunsigned("key", 24) == i, _key(n, TRIPLES[i] + p)) for n, (i, p) in enumerate(again)))
    finer = long.select("fp", F.explode(F.filter(narrower, lambda x: x.isNotNull())).alias("key"))
    short_again, still_long = _listed(finer)
    return _list_links(short).union(_list_links(short_again)).union(_long_links(still_long)).distinct()


def label(fps: DataFrame) -> DataFrame:
    """doc_id, fp, th, component_id of every row of fingerprints()."""
    fps = materialize(fps, "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "distinct")
    roots = components(links(distinct))
    rooted = materialize(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_doc", F.coalesce("root", "fp").alias("root")), "rooted")
    return fps.join(lowest(rooted, "root", "first_doc", "component_id").select("fp", "component_id", "root"), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hexadecimal), component_id of every row."""
    return label(fingerprints(docs)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: of each component the one with the smallest doc_id, then text hash; one row of repeated rows."""
    key, last = ["__simhash_id", "__simhash_th"], F.coalesce("doc_id", F.lit(2**63 - 1))
    own = docs.withColumns(dict(zip(key, (last, text_hash()), strict=True)))
    rows = label(fingerprints(docs)).select(last.alias(key[0]), F.col("th").alias(key[1]), "root")
    stays = rows.groupBy("root").agg(F.min(F.struct(*key)).alias("r")).select("r.*")
    first = F.row_number().over(Window.partitionBy(*key).orderBy(key[0]))
    return own.join(stays, key).withColumn("__simhash_n", first).where("__simhash_n = 1").select(*docs.columns)
