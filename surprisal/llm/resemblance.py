"""Near-duplicates by likeness: SimHash's byte-position inverted index, completed for what its bits cannot tell.

Two texts are near copies if they share at least 4/5 of all their distinct five-word shingles (64-bit
hashes; words as in simhash). Two steps find their links:

1. SimHash (`settle`). A set's fingerprint is the majority of its hashes, eight positional bytes. Two
   fingerprints that differ in MAX_BITS bits at most share MIN_SHARED positional bytes at least, the
   guaranteed minimum, of which two lie in one half: two positions of a half at once are a key (PAIRS),
   which misses no pair. Within a posting list the shared positional bytes of pairs are tallied, pairs
   under MIN_SHARED dropped and the rest verified by their differing bits, then on whole sets. What
   this step links is settled.
2. The rest (`complete`). Texts of likeness 0.8 differ in 10 of 64 bits on average, more than any
   bound under which positional bytes bear an index. So settled groups are linked to each other by
   BYTES positional bytes more, each a low byte of the smallest shingle hash under one of BYTES
   multiplicative permutations, which two texts share with their likeness as probability. ROWS
   neighbours at once are a key (BANDS keys): a pair of likeness J has none in common with probability
   (1 - J**ROWS)**BANDS, 3e-5 at J = 0.8 and less above. Pairs that share under SHARED_LEAST bytes are
   dropped (a pair of likeness 0.8 or more is with probability 1e-7), the rest verified on whole sets.
   Links inside a settled group are not looked for again.

No pair below 4/5 links. Texts of the same set are one node. Pairs are never written as rows: a posting
list's task walks its members breadth first and writes a star for each connected part, whose components
are the groups to verify; each group's sets meet in one task, which walks them likewise, by tally first
and whole sets then. A posting list of over LIST_MOST members, and a group of over PART_BYTES of sets, is
dealt into parts of that size at most, and each two parts meet in a task of their own: exact, and bounded
in memory.

Texts are shuffled only where they have to be: a bitmap of the hashes of the keys looked for, broadcast,
tells most other rows (`marked`), and only what it marks is joined. In the end rows that surely stay pass
as they are. Beyond MARK_MOST bits more rows are marked in vain, and joined, but none is lost.

Defined results: texts without words, empty or null, are copies of each other; a text of under five
words is one shingle; a null doc_id stays only where a component has no other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surprisal.llm.common import map_batches, materialize, prepare
from surprisal.llm.components import components
from surprisal.llm.simhash import LOWER, SEED, majority, shared_bytes, text_hash

#: Differing bits that SimHash's index is sure to find, and positional bytes of eight that such pairs share.
SHINGLE, MAX_BITS = 5, 5
MIN_SHARED = 8 - MAX_BITS
PAIRS = [c for half in (range(4), range(4, 8)) for c in combinations(half, 2)]
BANDS, ROWS = 20, 4
BYTES, SHARED_LEAST = BANDS * ROWS, 44
#: Near copies share LEAST[0] / LEAST[1] of their shingles at least.
LEAST = (4, 5)
#: Shingles whose minima are taken at once; members and bytes of sets that one part holds.
PIECE, LIST_MOST, PART_BYTES = 1 << 12, 4096, 8 << 20
#: Bits of the bitmap for each key, and at most (32 MB).
MARK_BITS, MARK_MOST = 32, 1 << 28
FACTORS = np.random.default_rng(SEED).integers(0, 2**64, (BYTES, 1), np.uint64) | np.uint64(1)


def shingles(text: str) -> np.ndarray:
    """The hashes of a text's distinct shingles, ascending."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = set(map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))) if len(words) >= SHINGLE else {b" ".join(words)}
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, len(grams)))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The smallest hash of a set under each permutation."""
    low = np.full(BYTES, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), PIECE):
        np.minimum(low, (FACTORS * hashes[i : i + PIECE]).min(axis=1), out=low)
    return low


def sketch(hashes: np.ndarray) -> tuple[bytes, list[int], int]:
    """The positional bytes of a set, their keys, signed, and its SimHash, signed; an empty set has no keys."""
    low = minima(hashes)
    # Minima are small numbers, so their first bytes tell little apart.
    fp = (low >> np.uint64(8)).astype(np.uint8).tobytes()
    keys = [xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(low.reshape(BANDS, ROWS))] if len(hashes) else []
    return fp, np.array(keys, np.uint64).view(np.int64).tolist(), int(np.uint64(majority(hashes)).view(np.int64))


def alike(shared: np.ndarray, n: np.ndarray, m: int) -> np.ndarray:
    """Whether sets of these sizes that share so many share enough, in whole numbers."""
    return LEAST[1] * shared >= LEAST[0] * (n + m - shared)


def sketches(docs: DataFrame) -> DataFrame:
    """id, th, set_id (a hash of the set), n (its size), fp, keys and simhash of every row of (id, th, text)."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(x or "") for x in batch.column("text").to_pylist()]
        ids = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
        made = [sketch(s) for s in sets]
        arrays = [batch.column("id"), batch.column("th"), pa.array(ids), pa.array([len(s) for s in sets], pa.int64())]
        arrays += [pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.list_(pa.int64())), pa.array([m[2] for m in made], pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, ["id", "th", "set_id", "n", "fp", "keys", "simhash"])

    return map_batches(docs.select("id", "th", "text"), "id bigint, th bigint, set_id bigint, n bigint, fp binary, keys array<bigint>, simhash bigint", step)


def marked(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """rows with __near_mark: true wherever (id, th) is among chosen's, and for about one in MARK_BITS of the others."""
    bits = 1 << min(MARK_MOST.bit_length() - 1, (MARK_BITS * chosen.count()).bit_length())
    place = lambda i, th: F.xxhash64(i, th).bitwiseAND(F.lit(bits - 1))
    # A bitmap of Spark's has 2**15 bits.
    at = chosen.select(place("id", "th").alias("at")).select(F.shiftright("at", 15).alias("__near_part"), F.col("at").bitwiseAND(F.lit(2**15 - 1)).alias("at"))
    maps = materialize(at.repartition("__near_part").groupBy("__near_part").agg(F.bitmap_construct_agg("at").alias("__near_bits")), "marks")
    own = F.col("__near_at").bitwiseAND(F.lit(2**15 - 1)).cast("int")
    byte = F.conv(F.hex(F.substring("__near_bits", F.shiftright(own, 3) + 1, F.lit(1))), 16, 10).cast("int")
    told = rows.withColumn("__near_at", place("__near_id", "__near_th")).withColumn("__near_part", F.shiftright("__near_at", 15)).join(F.broadcast(maps), "__near_part", "left")
    mark = F.coalesce(F.expr("shiftright(__near_byte, cast(__near_at & 7 AS int)) & 1") == 1, F.lit(False))
    return told.withColumn("__near_byte", byte).withColumn("__near_mark", mark).drop("__near_part", "__near_bits", "__near_at", "__near_byte")


def one_row(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows whose (id, th) is chosen, with chosen's other columns; one of repeated rows."""
    first = F.row_number().over(Window.partitionBy("__near_id", "__near_th").orderBy("__near_id"))
    found = rows.join(chosen.withColumnsRenamed({"id": "__near_id", "th": "__near_th"}), ["__near_id", "__near_th"])
    return found.withColumn("__near_n", first).where("__near_n = 1").drop("__near_n")


def walk(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """The number of the first member of each member's connected part. near(x, left): which of left link to x."""
    root, left = np.arange(n), np.arange(n)
    while len(left) > 1:
        start, left = int(left[0]), left[1:]
        front = [start]
        while front and len(left):
            hit = near(front.pop(), left)
            found, left = left[hit], left[~hit]
            root[found] = start
            front += found.tolist()
    return root


#: Which of left pass a tally with member x.
Tally = Callable[[int, np.ndarray], np.ndarray]


def simhash_tally(column: pa.ChunkedArray) -> Tally:
    """Pairs that share MIN_SHARED positional bytes of SimHash and differ in MAX_BITS bits at most."""
    fps = column.to_numpy().view(np.uint64)

    def near(x: int, left: np.ndarray) -> np.ndarray:
        apart = fps[left] ^ fps[x]
        hit = shared_bytes(apart) >= MIN_SHARED
        hit[hit] = np.bitwise_count(apart[hit]) <= MAX_BITS
        return hit

    return near


def minima_tally(column: pa.ChunkedArray) -> Tally:
    """Pairs that share SHARED_LEAST positional bytes of the minima."""
    fps = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BYTES)
    return lambda x, left: (fps[left] == fps[x]).sum(axis=1) >= SHARED_LEAST


def list_roots(own: np.ndarray, tally: Tally) -> np.ndarray:
    """walk() over a posting list by the tally alone; members of one settled group, own, are linked."""
    return walk(len(own), lambda x, left: (own[left] == own[x]) | tally(x, left))


def set_roots(own: np.ndarray, tally: Tally, sets: list[np.ndarray]) -> np.ndarray:
    """walk() over a group by the tally, then by whole sets; members of one settled group, own, are linked."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    code = np.unique(np.concatenate(sets), return_inverse=True)[1] if n.sum() else np.zeros(0, np.int64)
    start, mark = np.cumsum(n) - n, np.zeros(len(code), bool)

    def near(x: int, left: np.ndarray) -> np.ndarray:
        known = own[left] == own[x]
        hit = tally(x, left) & ~known
        some = left[hit]
        if len(some):
            members = code[start[x] : start[x] + n[x]]
            mark[members] = True
            begin = np.cumsum(n[some]) - n[some]
            at = np.repeat(start[some] - begin, n[some]) + np.arange(n[some].sum())
            shared = np.add.reduceat(mark[code[at]].astype(np.int64), begin)
            mark[members] = False
            hit[hit] = alike(shared, n[some], int(n[x]))
        return hit | known

    return walk(len(sets), near)


def dealt(rows: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """rows with columns i and j: every two parts of a key's rows meet under one (key, i, j). sizes: key and its number of parts."""
    own = F.expr("pmod(xxhash64(set_id), parts)")
    meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda q: F.struct(F.least(q, own).alias("i"), F.greatest(q, own).alias("j")))
    return rows.join(sizes, key).withColumn("__meet", F.explode(meets)).selectExpr("*", "__meet.i", "__meet.j").drop("__meet", "parts")


def stars(rows: DataFrame, key: str, roots: Callable[..., np.ndarray], columns: list[str]) -> DataFrame:
    """(a, b): for each (key, i, j) of rows the own of a connected part's first member with each other one of it.

    roots gets own and the columns of one such group, in order of set_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def out(table: pa.Table) -> pa.RecordBatch:
            at = np.stack([table.column(c).to_numpy() for c in ("key", "i", "j")])
            own, found = table.column("own").to_numpy(), []
            cuts = [*np.flatnonzero(np.r_[True, (at[:, 1:] != at[:, :-1]).any(axis=0)]).tolist(), len(own)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b - a > 1:
                    root = own[a:b][roots(own[a:b], *(table.column(c).slice(a, b - a) for c in columns))]
                    moved = np.flatnonzero(root != own[a:b])
                    found.append(np.stack([root[moved], own[a:b][moved]]))
            both = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            last = [held.column(c)[-1].as_py() for c in ("key", "i", "j")]
            same = np.logical_and.reduce([held.column(c).to_numpy() == v for c, v in zip(("key", "i", "j"), last, strict=True)])
            cut = len(same) - int(same.sum())
            if cut:
                yield out(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None:
            yield out(held)

    named = rows.withColumnRenamed(key, "key").select("key", "i", "j", "set_id", "own", *columns)
    return named.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "set_id").mapInArrow(run, "a bigint, b bigint")


def listed(keyed: DataFrame) -> DataFrame:
    """The posting lists of (key, set_id, own) that more than one settled group is in, dealt into parts."""
    sizes = keyed.groupBy("key").agg(F.count("*").alias("parts"), F.min("own").alias("low"), F.max("own").alias("high")).where("low < high")
    return dealt(keyed, sizes.select("key", F.ceil(F.col("parts") / LIST_MOST).alias("parts")), "key")


def verified(rows: DataFrame, nodes: DataFrame, column: str, tally: Callable[[pa.ChunkedArray], Tally]) -> DataFrame:
    """node, root of the settled groups that a link of whole sets connects; nodes has root (a group to look in), set_id, own, id, th, n and the tally's column."""
    grouped = materialize(nodes.select("root", "set_id", "own", "id", "th", "n", column), "groups")
    sizes = grouped.groupBy("root").agg(F.ceil(F.sum(F.col("n") * 8 + BYTES) / PART_BYTES).alias("parts"))
    kept = ["root", "set_id", "own", column]

    def members(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [shingles(x or "").tobytes() for x in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(made, pa.binary())], [*kept, "members"])

    some = marked(rows.select("__near_id", "__near_th", "text"), grouped).where("__near_mark").drop("__near_mark")
    chosen = one_row(some, grouped.drop("n"))
    sets = map_batches(chosen.select(*kept, "text"), f"root bigint, set_id bigint, own bigint, {column} {nodes.schema[column].dataType.simpleString()}, members binary", members)
    exact = lambda own, c, whole: set_roots(own, tally(c), [np.frombuffer(x, np.uint64) for x in whole.to_pylist()])
    return components(stars(dealt(sets, sizes, "root"), "root", exact, [column, "members"]))


def settle(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """set_id, own of the near copies that SimHash finds: those whose fingerprints differ in MAX_BITS bits at most, and what they connect."""
    byte = lambda p: F.shiftrightunsigned("simhash", 8 * p).bitwiseAND(F.lit(0xFF))
    keys = F.array(*(F.lit(i << 16) + F.shiftleft(byte(p), 8) + byte(q) for i, (p, q) in enumerate(PAIRS)))
    keyed = firsts.where("n > 0").select("set_id", F.col("set_id").alias("own"), "simhash", F.explode(keys).alias("key"))
    near = components(stars(listed(keyed), "key", lambda own, c: list_roots(own, simhash_tally(c)), ["simhash"]))
    nodes = near.join(firsts.withColumns({"node": F.col("set_id"), "own": F.col("set_id")}), "node")
    return verified(rows, nodes, "simhash", simhash_tally).selectExpr("node AS set_id", "root AS own")


def complete(rows: DataFrame, owned: DataFrame) -> DataFrame:
    """own, root of the settled groups that links beyond MAX_BITS connect; owned has firsts' columns and own."""
    keyed = materialize(owned.select("set_id", "own", F.explode("keys").alias("key")), "keyed")
    lists = listed(keyed).join(owned.select("set_id", "fp"), "set_id")
    near = components(stars(lists, "key", lambda own, c: list_roots(own, minima_tally(c)), ["fp"]))
    nodes = near.withColumnRenamed("node", "own").join(owned, "own")
    return verified(rows, nodes, "fp", minima_tally).withColumnRenamed("node", "own")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: of each component the one with the smallest doc_id, then text hash; one row of repeated rows."""
    prepare(docs.sparkSession)
    rows = docs.withColumns({"__near_id": F.coalesce("doc_id", F.lit(2**63 - 1)), "__near_th": text_hash()})
    sketched = sketches(rows.select(F.col("__near_id").alias("id"), F.col("__near_th").alias("th"), "text"))
    least = F.min(F.struct("id", "th", "n", "fp", "keys", "simhash")).alias("r")
    firsts = materialize(sketched.groupBy("set_id").agg(least).select("set_id", "r.*"), "sets")
    owned = firsts.join(settle(rows, firsts), "set_id", "left").withColumn("own", F.coalesce("own", "set_id"))
    found = owned.select("own", "id", "th").join(complete(rows, owned), "own", "left")
    stays = materialize(found.groupBy(F.coalesce("root", "own").alias("root")).agg(F.min(F.struct("id", "th")).alias("r")).select("r.*"), "stays")
    times = rows.groupBy(F.col("__near_id").alias("id"), F.col("__near_th").alias("th")).agg(F.count("*").alias("times"))
    unsure = times.join(stays.withColumn("stays", F.lit(True)), ["id", "th"], "left").where("stays IS NULL OR times > 1")
    told = marked(rows, materialize(unsure.select("id", "th"), "unsure"))
    joined = one_row(told.where("__near_mark").drop("__near_mark"), stays)
    return told.where("NOT __near_mark").select(*docs.columns).union(joined.select(*docs.columns))
