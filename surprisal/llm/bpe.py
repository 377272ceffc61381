"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

Words come from the vectorised pre-tokenizer in flatwords. Those that a worker has not met are
merged together: the symbols of all of them lie in one flat array, each round finds the ranks of
changed pairs by binary search over the sorted pair keys, takes the lowest rank of every word and
merges its occurrences from the left. A bounded cache keeps the ids of known words. Words longer than LONG_WORD symbols go one by one through a heap, which is
exact too and stays near-linear where merge rounds would be quadratic.

Defined results: a null text is the empty text and has no ids; the special token's own string in a
text becomes its id, as the tokenizer file says; repeated rows give repeated results; a text of any
length is encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from surprisal.llm.common import map_batches, prepare, texts
from surprisal.llm.flatwords import FlatEncoder

LONG_WORD = 256
NONE = np.int64(2**62)


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Bpe:
    """One vocabulary with its merges, as a worker holds it."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        back = {s: b for b, s in byte_symbols().items()}
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(back[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            self.token_bytes[i] = content.encode()
        self.size = np.int64(size)
        self.byte_ids = np.array([vocab[s] for _, s in sorted(byte_symbols().items())], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self.rank_of = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.flat = FlatEncoder(self.words, self.special)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, NONE where there is no merge."""
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge_words(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each of many words (none empty), by batched merge rounds."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.full(len(symbols), NONE)
        if len(symbols) > 1:
            rank[:-1] = np.where(word[1:] == word[:-1], self.pair_ranks(symbols[:-1], symbols[1:]), NONE)
        while len(symbols):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.minimum.reduceat(rank, first)
            counts = np.diff(np.r_[first, len(word)])
            lowest = np.repeat(low, counts)
            if (low == NONE).any():
                over = lowest == NONE
                done.append((word[over], symbols[over]))
                keep = ~over
                symbols, word, rank, lowest = symbols[keep], word[keep], rank[keep], lowest[keep]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == lowest)
            # Of adjacent hits (a pair such as "aa" in "aaa") every second one of a run merges.
            if len(hit) > 1 and (np.diff(hit) == 1).any():
                run = np.r_[True, np.diff(hit) != 1]
                start = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - start) % 2 == 0]
            symbols[hit] = self.made[rank[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            moved = np.cumsum(keep) - 1
            at = moved[hit]
            symbols, word, rank = symbols[keep], word[keep], rank[keep]
            # Only pairs that touch a merged symbol change their rank.
            for i in (at, at[at > 0] - 1):
                right = np.minimum(i + 1, len(symbols) - 1)
                rank[i] = np.where((right > i) & (word[right] == word[i]), self.pair_ranks(symbols[i], symbols[right]), NONE)
        all_words, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(all_words, kind="stable")
        ends = np.cumsum(np.bincount(all_words, minlength=len(words)))
        return np.split(ids[order].astype("<u4"), ends[:-1])

    def merge_long(self, word: bytes) -> np.ndarray:
        """The ids of one word of any length: lowest rank first, leftmost among equals, by a heap."""
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n, size = len(ids), int(self.size)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.rank_of.get(ids[i] * size + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.made[r]), -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for p, q in ((left[i], i), (i, right[i])):
                if p >= 0 and q >= 0 and (s := self.rank_of.get(ids[p] * size + ids[q])) is not None:
                    heapq.heappush(heap, (s, p, ids[p], ids[q]))
        return np.array([x for x in ids if x >= 0], "<u4")

    def words(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word."""
        short = [w.encode() for w in words if len(w) <= LONG_WORD]
        merged = iter(self.merge_words(short) if short else [])
        return [next(merged) if len(w) <= LONG_WORD else self.merge_long(w.encode()) for w in words]

    def encode(self, many: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        return self.flat.encode(many)

    def decode(self, ids: np.ndarray) -> str:
        """The text of an id sequence; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(4)
def load(path: str) -> Bpe:
    """A worker's copy of a vocabulary."""
    return Bpe(path)


def encode(df: DataFrame, vocab_path: str, key: str = "doc_id", text: str = "text", dtype: str = "bigint") -> DataFrame:
    """key and ids (array<int>) of every text."""
    prepare(df.sparkSession)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [x.astype(np.int32) for x in load(vocab_path).encode(texts(batch))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["key", "ids"])

    out = map_batches(df.selectExpr(f"`{key}` AS key", f"`{text}` AS text"), f"key {dtype}, ids array<int>", step)
    return out.withColumnRenamed("key", key)


def decode(df: DataFrame, vocab_path: str, key: str = "doc_id", ids: str = "ids", dtype: str = "bigint") -> DataFrame:
    """key and text of every id sequence; a null sequence is empty."""
    prepare(df.sparkSession)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(vocab_path)
        out = [bpe.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["key", "text"])

    return map_batches(df.selectExpr(f"`{key}` AS key", f"`{ids}` AS ids"), f"key {dtype}, text string", step).withColumnRenamed("key", key)


def round_trip(docs: DataFrame, vocab_path: str, keep_ids: bool = False) -> DataFrame:
    """Encode and decode every document: doc_id, n_tokens, ids_sha256, decoded_sha256; with keep_ids also the ids."""
    prepare(docs.sparkSession)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(vocab_path)
        ids = bpe.encode(texts(batch))
        decoded = [bpe.decode(x) for x in ids]
        arrays = [
            batch.column("doc_id"),
            pa.array([len(x) for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]),
        ]
        if keep_ids:
            arrays.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(arrays)])

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return map_batches(docs.select("doc_id", "text"), schema, step)
