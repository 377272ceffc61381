"""Benchmark decontamination: a broadcast hash set of normalised windows of test items.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, lower-cased in A-Z. A
window is WINDOW words of an item; an item with fewer is one window of its own length. Document words
become numbers of the items' vocabulary, windows get a polynomial hash, hits in the sorted hash set
are verified word by word.

The broadcast is bounded: repeated items count once, items are cut into overlapping pieces, and pieces
dealt into shards of SHARD_BYTES of words at most, whatever the length of an item. One index is held at
a time. A shard that is full takes some 330 MB at its peak where it is built, 75 MB broadcast (measured). Usually there is one shard. Of several, each is a scan of its own, whose hits are written and
joined per text before documents are judged.

Defined results: a null text has no words and is clean; an item without words matches nothing; items
with equal windows all count; repeated rows each get their result, repeated items count once; a null
item_id is counted but not listed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surprisal.llm.common import map_batches, materialize, prepare

WINDOW, SHARE = 13, 20
SHARD_BYTES, PIECE_WORDS = 16 << 20, 4096
#: ASCII letters to lower case, all other ASCII but digits to blanks; bytes beyond ASCII stay.
WORD_BYTES = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


def window_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n numbers."""
    out = np.zeros(len(ids) - n + 1, np.uint64)
    for j in range(n):
        out = out * BASE + ids[j : len(ids) - n + 1 + j].astype(np.uint64)
    return out


@dataclass
class Layer:
    """Distinct windows of one length, of which no two have the same hash."""

    hashes: np.ndarray
    at: np.ndarray  # where a window's words lie in Index.flat
    start: np.ndarray  # by window, where its items lie in items; one more at the end
    items: np.ndarray


@dataclass
class Index:
    """Windows of some items: words by number, and layers by window length. Some 24 bytes a word, besides its vocabulary."""

    names: list[int | None]
    vocab: dict[bytes, int] = field(default_factory=dict)
    flat: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    layers: list[tuple[int, Layer]] = field(default_factory=list)

    @classmethod
    def build(cls, items: Iterable[tuple[int | None, int, list[bytes]]]) -> Index:
        """From pieces: item_id, window length, words."""
        vocab, number, ids, sizes, lengths, owner = {}, {}, [], [], [], []
        for item, n, ws in items:
            owner.append(number.setdefault(item, len(number)))
            ids.append(np.fromiter((vocab.setdefault(w, len(vocab)) for w in ws), np.int32, len(ws)))
            sizes.append(len(ws))
            lengths.append(n)
        index = cls(list(number), vocab, np.concatenate([np.zeros(0, np.int32), *ids]))
        sizes, lengths, owner = (np.array(x, np.int64) for x in (sizes, lengths, owner))
        begin = np.cumsum(sizes) - sizes
        for n in sorted(set(lengths.tolist())):
            of = np.flatnonzero(lengths == n)
            many = sizes[of] - n + 1
            first = np.repeat(begin[of] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            index.layers += [(n, x) for x in layered(index.flat, first, np.repeat(owner[of], many), n)]
        return index

    def hits(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[int | None]]:
        """Word ranges (end exclusive) inside occurring windows, merged, and the items they belong to."""
        ids = np.fromiter(map(self.vocab.get, ws, (-1 for _ in ws)), np.int64, len(ws))
        spans, items = [], set()
        known = np.r_[0, np.cumsum(ids >= 0)]
        for n, layer in self.layers:
            if len(ids) < n or not (full := known[n:] - known[:-n] == n).any():
                continue
            at = np.flatnonzero(full)
            found = window_hashes(ids, n)[at]
            k = np.minimum(np.searchsorted(layer.hashes, found), len(layer.hashes) - 1)
            same = layer.hashes[k] == found
            at, k = at[same], k[same]
            if len(at):
                verified = equal(self.flat, layer.at[k], ids, at, n)
                at, k = at[verified], np.unique(k[verified])
                spans += [(i, i + n) for i in at.tolist()]
                items.update(self.names[i] for x in k.tolist() for i in layer.items[layer.start[x] : layer.start[x + 1]].tolist())
        return merge(spans), items


def equal(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Whether n numbers of a from each of i are those of b from each of j."""
    out = np.ones(len(i), bool)
    for k in range(n):
        out &= a[i + k] == b[j + k]
    return out


def layered(flat: np.ndarray, at: np.ndarray, owner: np.ndarray, n: int) -> Iterator[Layer]:
    """Layers of the windows that begin at some places, with their items; a second one only if different windows share a hash."""
    while len(at):
        hashes = window_hashes_at(flat, at, n)
        order = np.lexsort((owner, hashes))
        hashes, at, owner = hashes[order], at[order], owner[order]
        first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
        lead = np.repeat(at[first], np.diff(np.r_[first, len(at)]))
        same = equal(flat, at, flat, lead, n)
        # An item's repeats of a window count once.
        keep = same & np.r_[True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])]
        keep[first] = True
        group = np.cumsum(np.r_[False, hashes[1:] != hashes[:-1]])[keep]
        yield Layer(hashes[first], at[first], np.searchsorted(group, np.arange(len(first) + 1)), owner[keep])
        at, owner = at[~same], owner[~same]


def window_hashes_at(ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    for j in range(n):
        out = out * BASE + ids[at + j].astype(np.uint64)
    return out


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges joined where they touch or overlap."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def pieces(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, n (the window length) and words of the items: distinct runs of PIECE_WORDS windows at most, so that every window is in one.

    Items are cut before repeats are looked for, so that no aggregation holds a long text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item_id"), batch.column("text").to_pylist(), strict=True):
                ws = words(text)
                n = min(window, len(ws))
                for i in range(0, len(ws) - n + 1, PIECE_WORDS) if n else ():
                    made = b" ".join(ws[i : i + PIECE_WORDS + n - 1])
                    yield pa.RecordBatch.from_arrays([pa.array([item.as_py()], pa.int64()), pa.array([n], pa.int32()), pa.array([made], pa.binary())], ["item_id", "n", "words"])

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id bigint, n int, words binary").distinct()


def shards(made: DataFrame) -> int:
    """How many shards keep the pieces of each within SHARD_BYTES: pieces are small, so dealing them by hash fills shards alike."""
    total = made.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    return max(1, -(-total * 5 // (4 * SHARD_BYTES)))


def index_of(made: DataFrame, n: int, k: int) -> Index:
    """The index of one shard of n."""
    rows = made.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(n)) == k) if n > 1 else made
    return Index.build((r[0], r[1], bytes(r[2]).split(b" ")) for r in rows.select("item_id", "n", "words").toLocalIterator())


def _scan(docs: DataFrame, benchmark: DataFrame, schema: str, finish: Callable[[pa.RecordBatch, list], pa.RecordBatch]) -> DataFrame:
    """finish() gets each batch of docs and, for every row, its words, hit ranges and items."""
    spark = prepare(docs.sparkSession)
    made = materialize(pieces(benchmark), "benchmark")
    n = shards(made)
    if n > 1:
        return _scan_shards(docs, made, n, schema, finish)
    held = spark.sparkContext.broadcast(index_of(made, 1, 0))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        split = [words(t) for t in batch.column("text").to_pylist()]
        return finish(batch, [(ws, *held.value.hits(ws)) for ws in split])

    return map_batches(docs, schema, step)


def _scan_shards(docs: DataFrame, made: DataFrame, n: int, schema: str, finish: Callable[[pa.RecordBatch, list], pa.RecordBatch]) -> DataFrame:
    """Several shards: one scan each, one index at a time; their hits per distinct text are written, then joined to the documents."""
    spark, parts = docs.sparkSession, None
    for k in range(n):
        held = spark.sparkContext.broadcast(index_of(made, n, k))

        def step(batch: pa.RecordBatch, held=held) -> pa.RecordBatch:  # noqa: ANN001
            out = []
            for th, text in zip(batch.column("th").to_pylist(), batch.column("text").to_pylist(), strict=True):
                spans, items = held.value.hits(words(text))
                if spans:
                    out.append((th, np.array(spans, "<i8").tobytes(), "\x00".join(map(str, items))))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.binary(), pa.string()))], ["th", "spans", "items"])

        one = materialize(map_batches(docs.select(F.sha2("text", 256).alias("th"), "text"), "th string, spans binary, items string", step).dropDuplicates(["th"]), "hits")
        held.destroy()
        parts = one if parts is None else parts.union(one)
    joined = parts.groupBy("th").agg(F.collect_list("spans").alias("__spans"), F.collect_list("items").alias("__items")).withColumnRenamed("th", "__text_sha")
    full = docs.withColumn("__text_sha", F.sha2("text", 256)).join(joined, "__text_sha", "left").select(*docs.columns, "__spans", "__items")

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        hits = []
        for text, spans, items in zip(*(batch.column(c).to_pylist() for c in ("text", "__spans", "__items")), strict=True):
            pairs = [tuple(p) for s in spans or [] for p in np.frombuffer(s, "<i8").reshape(-1, 2).tolist()]
            ids = {None if x == "None" else int(x) for s in items or [] for x in s.split("\x00")}
            hits.append((words(text), merge(pairs), ids))
        return finish(batch.select(docs_columns), hits)

    docs_columns = docs.columns
    return map_batches(full, schema, whole)


def is_contaminated(n_hit: int, n_words: int) -> bool:
    return n_hit > 0 and SHARE * n_hit >= n_words


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: words, words hit, items that occur, and whether it is contaminated."""

    def finish(batch: pa.RecordBatch, hits: list) -> pa.RecordBatch:
        sizes = [len(ws) for ws, _, _ in hits]
        hit = [sum(b - a for a, b in spans) for _, spans, _ in hits]
        listed = [",".join(sorted(str(i) for i in items if i is not None)) for _, _, items in hits]
        arrays = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(items) for _, _, items in hits], pa.int64())]
        arrays += [pa.array([hashlib.sha256(x.encode()).hexdigest() for x in listed], pa.string()), pa.array(list(map(is_contaminated, hit, sizes)), pa.bool_())]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return _scan(docs.select("doc_id", "text"), benchmark, "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean", finish)


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given word ranges."""
    at, out = 0, []
    places = [m.span() for m in WORD.finditer(text)]
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*out, text[at:]])


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without contaminated rows; in the others, passages of benchmark items are removed and n_chars follows."""

    def finish(batch: pa.RecordBatch, hits: list) -> pa.RecordBatch:
        stays = [not is_contaminated(sum(b - a for a, b in spans), len(ws)) for ws, spans, _ in hits]
        out = {c: batch.column(c) for c in batch.schema.names}
        if any(spans and s for (_, spans, _), s in zip(hits, stays, strict=True)):
            made = [cut(t, spans) if spans and s else t for t, (_, spans, _), s in zip(batch.column("text").to_pylist(), hits, stays, strict=True)]
            out["text"] = pa.array(made, batch.schema.field("text").type)
            if "n_chars" in out:
                out["n_chars"] = pa.array([len(t) if spans and t is not None else n for t, (_, spans, _), n in zip(made, hits, out["n_chars"].to_pylist(), strict=True)], out["n_chars"].type)
        return pa.RecordBatch.from_pydict(out).filter(pa.array(stays))

    return _scan(docs, benchmark, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes), finish)
