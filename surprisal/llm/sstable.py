"""Token ids in sorted-string-table shards.

A shard holds documents of one range of keys in ascending order:

    data blocks | block index | Bloom filter | footer

A key is a null flag, the doc_id as 8 big-endian bytes in unsigned order, and a 4-byte number that
tells repeated doc_ids apart. In a block, an entry is: length of the prefix shared with the key
before, length of the rest of the key, length of the value (varints), the rest, and the value: the
ids as 2- or 4-byte little-endian integers. Blocks are deflated one by one; a block ends when its
entries reach BLOCK_BYTES. The index has the first key, place and size of each block; lookups search
it by bisection after asking the Bloom filter.

Each range of doc_id is written by one task, first under a name of the attempt and then renamed, so
that a repeated attempt leaves the same files; a file that has SHARD_BYTES of ids is followed by
another. Ranges are dealt by bytes of text and are as many as it takes. Files go to the folder given,
which all executors must share, through the file system of its URI, and a manifest of them beside them:
any session can read the folder, whole or by doc_id. A file is read by pieces: its footer, then index,
filter or blocks.

Defined results: a null text is empty and holds only the end id; repeated doc_ids follow each other
by text; a null doc_id comes first.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cached_property, lru_cache
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surprisal.llm.bpe import byte_symbols
from surprisal.llm.common import prepare, range_bounds, with_range, scratch

if TYPE_CHECKING:
    from tokenizers import Tokenizer

#: A block's entries, and a shard's ids, before they are deflated; a longer document is a block or shard of its own.
BLOCK_BYTES, SHARD_BYTES = 1 << 16, 32 << 20
BLOOM_BITS, BLOOM_HASHES = 10, 7
NULL_ID = -(2**63)
MAGIC = b"SURPSST1"
FOOTER = struct.Struct("<QQQQQQB7x8s")
MANIFEST = "manifest.parquet"
NAMES = ["shard", "part", "docs", "tokens", "first_key", "last_key"]
KINDS = [pa.int64()] * 4 + [pa.binary()] * 2


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = raw[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def key_of(doc_id: int | None, number: int = 0) -> bytes:
    return b"\x00" * 9 + struct.pack(">I", number) if doc_id is None else b"\x01" + struct.pack(">QI", doc_id + 2**63, number)


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:9])[0] - 2**63 if key[0] else None


def bloom_places(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h >> 64, h & (2**64 - 1) | 1
    return [(a + i * b) % 2**64 % bits for i in range(BLOOM_HASHES)]


class Writer:
    """One shard in memory; finish() gives its bytes."""

    def __init__(self, width: int) -> None:
        self.width, self.kind = width, "<u2" if width == 2 else "<u4"
        self.blocks: list[bytes] = []
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.block, self.size, self.last, self.place, self.tokens = [], 0, b"", 0, 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        """Keys must ascend."""
        if self.keys and key <= self.keys[-1]:
            raise ValueError("keys must ascend")
        if not self.block:
            self.first, self.last = key, b""
        shared = 0
        while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
            shared += 1
        value = ids.astype(self.kind).tobytes()
        entry = varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.block.append(entry)
        self.keys.append(key)
        self.size += len(entry)
        self.tokens += len(ids)
        self.last = key
        if self.size >= BLOCK_BYTES:
            self.close()

    def close(self) -> None:
        if self.block:
            raw = zlib.compress(b"".join(self.block), 1)
            self.index.append((self.first, self.place, len(raw)))
            self.blocks.append(raw)
            self.place += len(raw)
            self.block, self.size = [], 0

    def finish(self) -> bytes:
        self.close()
        index = b"".join(varint(len(k)) + k + varint(p) + varint(n) for k, p, n in self.index)
        bits = max(64, len(self.keys) * BLOOM_BITS)
        bloom = np.zeros(bits, bool)
        bloom[[p for k in self.keys for p in bloom_places(k[:9], bits)]] = True
        packed = np.packbits(bloom).tobytes()
        footer = FOOTER.pack(self.place, len(index), len(packed), bits, len(self.keys), self.tokens, self.width, MAGIC)
        return b"".join([*self.blocks, index, packed, footer])


class Shard:
    """A shard, read piece by piece. read(at, size) gives bytes of it."""

    def __init__(self, read: Callable[[int, int], bytes], size: int) -> None:
        self.read = read
        self.place, self.n_index, self.n_bloom, self.bits, self.n_docs, self.n_tokens, width, magic = FOOTER.unpack(read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.kind = "<u2" if width == 2 else "<u4"

    @classmethod
    def of(cls, raw: bytes) -> Shard:
        return cls(lambda at, size: raw[at : at + size], len(raw))

    @cached_property
    def bloom(self) -> bytes:
        return self.read(self.place + self.n_index, self.n_bloom)

    @cached_property
    def index(self) -> list[tuple[bytes, int, int]]:
        """The first key, place and size of each block."""
        raw, at, out = self.read(self.place, self.n_index), 0, []
        while at < len(raw):
            n, at = read_varint(raw, at)
            key, at = raw[at : at + n], at + n
            place, at = read_varint(raw, at)
            size, at = read_varint(raw, at)
            out.append((key, place, size))
        return out

    def entries(self, number: int) -> Iterator[tuple[bytes, np.ndarray]]:
        """Keys and ids of one block."""
        _, place, size = self.index[number]
        raw, at, key = zlib.decompress(self.read(place, size)), 0, b""
        while at < len(raw):
            shared, at = read_varint(raw, at)
            rest, at = read_varint(raw, at)
            n, at = read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, np.frombuffer(raw, self.kind, n // int(self.kind[2]), at)
            at += n

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.index)):
            yield from self.entries(i)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document with this doc_id."""
        wanted = key_of(doc_id)[:9]
        if not all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in bloom_places(wanted, self.bits)):
            return []
        out = []
        first = max(0, bisect_right(self.index, (wanted,)) - 1)
        for i in range(first, len(self.index)):
            if self.index[i][0][:9] > wanted:
                break
            out += [ids for key, ids in self.entries(i) if key[:9] == wanted]
        return out


@contextmanager
def opened(path: str) -> Iterator[Shard]:
    """A shard of a file, of which only the pieces asked for are read."""
    system, place = fs.FileSystem.from_uri(path)
    with system.open_input_file(place) as f:
        yield Shard(lambda at, size: f.read_at(size, at), f.size())


#: One word as byte-level vocabularies split texts, and the words a piece may hold beyond its first.
WORD = r"(?> ?\p{L}+|'(?:[stmd]|re|ve|ll)| ?[^\s\p{L}\p{N}]+| ?\p{N}+|\s+(?!\S)|\s+)"
PIECE_WORDS = 32
ASCII = "".join(map(chr, range(128)))
ALNUM = "".join(c for c in ASCII if c.isalnum())
OTHER = "".join(c for c in ASCII if not c.isalnum())


def piece_pattern(spec: dict) -> str | None:
    """Pieces of several words, which the merges of a byte-level BPE encode as they do the words one by one; None if that is not sure.

    The first merge to cross a bound between two words joins a token's last byte and another's first byte there. A piece goes on
    over a bound only where no merge joins these two, so that none crosses it; within each word merges come in the same order."""
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    symbols = byte_symbols()
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"] and model["type"] == "BPE"
    if not plain or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")) or not model["vocab"].keys() >= set(symbols.values()):
        return None
    joints = {(a[-1], b[0]) for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])}
    rules = []
    for before, after in ((ASCII, " "), (ALNUM, OTHER), (OTHER, ALNUM), (ASCII, "\n")):
        before = [b for b in before if not any((symbols[ord(b)], symbols[ord(a)]) in joints for a in after)]
        if before:
            rules.append("(?<=[{}])(?=[{}])".format(*("".join(f"\\x{ord(c):02x}" for c in cs) for cs in (before, after))))
    return f"{WORD}(?>(?:(?:{'|'.join(rules)}){WORD}){{0,{PIECE_WORDS}}})" if rules else None


def library(vocab_path: str) -> Tokenizer:
    """The tokenizers library with a vocabulary. Splitting texts into words is most of its work, so it splits them into pieces where that gives the same ids."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Regex, Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel, Sequence, Split

    tokenizer = Tokenizer.from_file(vocab_path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    with open(vocab_path, encoding="utf-8") as f:
        pattern = piece_pattern(json.load(f))
    if pattern:
        tokenizer.pre_tokenizer = Sequence([Split(Regex(pattern), "isolated"), ByteLevel(add_prefix_space=False, use_regex=False)])
    return tokenizer


@lru_cache(4)
def library_encoder(vocab_path: str) -> tuple[Callable[[list[str]], list[np.ndarray]], int]:
    """Whole texts to ids by the tokenizers library, equal texts of a batch once. Also the largest id."""
    tokenizer = library(vocab_path)

    def encode(texts: list[str]) -> list[np.ndarray]:
        distinct = list(dict.fromkeys(texts))
        ids = dict(zip(distinct, (np.array(array("I", e.ids)) for e in tokenizer.encode_batch_fast(distinct, add_special_tokens=False)), strict=True))
        return [ids[t] for t in texts]

    return encode, tokenizer.get_vocab_size(with_added_tokens=True) - 1


def put(path: str, raw: bytes) -> None:
    """Write a file whole or not at all, through the file system of its URI."""
    system, place = fs.FileSystem.from_uri(path)
    system.create_dir(place.rpartition("/")[0], recursive=True)
    own = f"{place}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(own) as f:
        f.write(raw)
    system.move(own, place)


def write(docs: DataFrame, vocab_path: str, folder: str, end_id: int = 0) -> None:
    """Encode docs (doc_id, text) into shards below folder, and a manifest of them in order of doc_id: MANIFEST."""
    prepare(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = range_bounds(rows, "id", "text")
    dealt = with_range(rows, "id", bounds, "bucket").repartitionById(len(bounds) + 1, "bucket").sortWithinPartitions("bucket", F.col("doc_id").isNotNull(), "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, largest = library_encoder(vocab_path)
        bucket = writer = None
        before, number, part = object(), 0, 0

        def done() -> pa.RecordBatch:
            put(f"{folder}/{name(bucket, part)}", writer.finish())
            made = (bucket, part, len(writer.keys), writer.tokens, writer.keys[0], writer.keys[-1])
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(made, KINDS, strict=True)], NAMES)

        for batch in batches:
            encoded = encode(batch.column("text").to_pylist())
            for b, doc_id, ids in zip(batch.column("bucket").to_pylist(), batch.column("doc_id").to_pylist(), encoded, strict=True):
                full = writer and writer.tokens and (writer.tokens + len(ids)) * writer.width > SHARD_BYTES
                if b != bucket or full:
                    if writer:
                        yield done()
                    part = part + 1 if b == bucket else 0
                    before = before if b == bucket else object()
                    bucket, writer = b, Writer(2 if largest < 1 << 16 else 4)
                number = number + 1 if doc_id == before else 0
                before = doc_id
                writer.add(key_of(doc_id, number), np.append(ids, np.uint32(end_id)))
        if writer:
            yield done()

    dealt.select("bucket", "doc_id", "text").mapInArrow(run, ", ".join(f"{n} {'binary' if t == pa.binary() else 'bigint'}" for n, t in zip(NAMES, KINDS, strict=True))).write.parquet(f"{folder}/{MANIFEST}")


def manifest(spark: SparkSession, folder: str) -> pa.Table:
    """The shards in order: NAMES, and start, the ids of all shards before. Some 60 bytes for each shard."""
    found = spark.read.parquet(f"{folder}/{MANIFEST}").toArrow().sort_by([("shard", "ascending"), ("part", "ascending")])
    tokens = found.column("tokens").to_numpy()
    return found.append_column("start", pa.array(np.cumsum(tokens) - tokens, pa.int64()))


def name(shard: int, part: int) -> str:
    return f"{shard:08d}-{part:06d}.sst"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files, a block at a time."""
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, part, at in zip(*(batch.column(c).to_pylist() for c in ("shard", "part", "start")), strict=True):
                with opened(f"{folder}/{name(number, part)}") as shard:
                    for i in range(len(shard.index)):
                        out = []
                        for key, ids in shard.entries(i):
                            out.append((id_of(key), at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                            at += len(ids)
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    found = manifest(spark, folder).select(["shard", "part", "start"])
    return spark.createDataFrame(found).repartition(max(1, len(found))).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def lookup(spark: SparkSession, folder: str, doc_ids: list[int | None]) -> DataFrame:
    """doc_id, ids of the documents with some doc_ids: the manifest names the shards, of which Bloom filter, block index and one block are read."""
    prepare(spark)
    found = manifest(spark, folder)
    firsts, lasts = (found.column(c).to_pylist() for c in ("first_key", "last_key"))
    files = [name(*x) for x in zip(found.column("shard").to_pylist(), found.column("part").to_pylist(), strict=True)]
    asked = []
    for d in dict.fromkeys(doc_ids):
        k = key_of(d)[:9]
        for i in range(bisect_left(lasts, k), len(files)):
            if firsts[i][:9] > k:
                break
            asked.append((files[i], d))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted: dict[str, list[int | None]] = {}
            for file, d in zip(batch.column("file").to_pylist(), batch.column("doc_id").to_pylist(), strict=True):
                wanted.setdefault(file, []).append(d)
            for file, ids in wanted.items():
                with opened(f"{folder}/{file}") as shard:
                    got = [(d, x.astype(np.int32)) for d in ids for x in shard.get(d)]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in got], pa.int64()), pa.array([i for _, i in got], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return spark.createDataFrame(asked, "file string, doc_id bigint").repartition("file").mapInArrow(run, "doc_id bigint, ids array<int>")


def round_trip(docs: DataFrame, vocab_path: str, end_id: int = 0) -> DataFrame:
    """Write docs as shards into the shared folder and read them back."""
    folder = scratch(docs.sparkSession, "sstable")
    write(docs, vocab_path, folder, end_id)
    return read(docs.sparkSession, folder)
