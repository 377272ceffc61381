import random
from collections import Counter
from itertools import combinations

import numpy as np
import xxhash
from conftest import DATA, ODD
from test_simhash import roots

import corpus_pipeline
from surprisal.llm import resemblance


def brute_shingles(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(texts):
    """The ids that stay of {id: text}."""
    sets = {i: brute_shingles(t) for i, t in texts.items()}
    near = [(a, b) for a, b in combinations(sorted(sets), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    return {i for i, r in roots(sorted(sets), near).items() if i == r}


def changed(words, r, times):
    out = list(words)
    for _ in range(times):
        out[r.randrange(len(out))] = f"new{r.randrange(10**6)}"
    return " ".join(out)


def test_stage_keeps_one_of_near_copies(spark):
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text for r in table.select("doc_id", "text").collect()}
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, table, DATA).collect()}
    assert got == brute(texts)
    assert not got & {145, 177}  # likeness 0.83 with 6 and 1, over three bits apart


def test_chains_and_odd_texts(spark, docs):
    r = random.Random(5)
    texts = list(ODD)
    for _ in range(6):
        words = [f"w{r.randrange(400)}" for _ in range(150)]
        for times in (0, 1, 2, 3, 3, 4, 5):
            texts.append(changed(words, r, times))
        # A chain: each link alike to the next, its ends not.
        for _ in range(6):
            words = changed(words, r, 3).split()
            texts.append(" ".join(words))
    ids = list(range(len(texts)))
    r.shuffle(ids)
    got = resemblance.keep_one(docs(texts, ids))
    assert "key" in got.columns and {x.doc_id for x in got.collect()} == brute(dict(zip(ids, texts, strict=True)))
    again = resemblance.keep_one(docs(["a b", "a b", None, "", "c"], [7, 7, None, 9, None]))
    assert Counter(x.doc_id for x in again.collect()) == {7: 1, 9: 1, None: 1}


def test_bounds(monkeypatch):
    a, b = np.arange(10, dtype=np.uint64), np.arange(8, dtype=np.uint64)
    assert resemblance.alike(np.array([8, 7]), np.array([8, 7]), len(a)).tolist() == [True, False] and len(b) == 8
    s = resemblance.shingles(" ".join(map(str, range(9000))))
    made = resemblance.sketch(s)
    monkeypatch.setattr(resemblance, "PIECE", 7)
    assert made == resemblance.sketch(s) and len(set(made[1])) == resemblance.BANDS and len(made[0]) == resemblance.BYTES


def spread_group(seed, size, words=120):
    """Near copies of one text at very different distances: few pairs of the group are alike, and many members to none."""
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(words)]
    return [changed(base, r, r.randint(0, 14)) for _ in range(size)]


def test_large_group_in_parts(spark, docs, monkeypatch):
    """A group beyond one part gives the same rows, and no pair is written."""
    texts = spread_group(9, 160) + [f"other text of its own number {i} here" for i in range(20)]
    want = brute(dict(enumerate(texts)))
    assert {x.doc_id for x in resemblance.keep_one(docs(texts)).collect()} == want and 40 < len(want) < 170
    monkeypatch.setattr(resemblance, "LIST_MOST", 40)
    monkeypatch.setattr(resemblance, "PART_BYTES", 40_000)
    assert {x.doc_id for x in resemblance.keep_one(docs(texts)).collect()} == want


def test_tally_loses_no_pair():
    r = random.Random(3)
    for _ in range(300):
        words = [f"w{r.randrange(10**6)}" for _ in range(r.choice([5, 9, 20, 60, 300]))]
        a, b = resemblance.shingles(" ".join(words)), resemblance.shingles(changed(words, r, r.randint(1, 6)))
        shared = len(np.intersect1d(a, b))
        if resemblance.alike(np.array(shared), np.array(len(a)), len(b)):
            fps = np.frombuffer(resemblance.sketch(a)[0] + resemblance.sketch(b)[0], np.uint8).reshape(2, -1)
            assert (fps[0] == fps[1]).sum() >= resemblance.SHARED_LEAST


def brute_simhash(text):
    """Majority of each bit over the distinct five-word shingles."""
    hashes = [xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in brute_shingles(text)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_step_of_the_stage(spark, docs, monkeypatch):
    """Near copies of few differing bits are found by SimHash's index, all of them and without the other one."""
    r = random.Random(11)
    texts = list(ODD)
    for _ in range(30):
        words = [f"w{r.randrange(10**6)}" for _ in range(r.choice([20, 80, 300]))]
        texts += [changed(words, r, times) for times in (0, 1, 1, 2, 3)]
    sets, fps = [brute_shingles(t) for t in texts], [brute_simhash(t) for t in texts]
    assert [resemblance.sketch(resemblance.shingles(t or ""))[2] % 2**64 for t in texts] == fps
    alike = [(a, b) for a, b in combinations(range(len(texts)), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    near = [(a, b) for a, b in alike if (fps[a] ^ fps[b]).bit_count() <= 5]
    want = [{i for i, x in roots(range(len(texts)), some).items() if i == x} for some in (near, alike)]
    assert len(want[1]) + 10 < len(want[0]) < len(texts) - 30
    assert {x.doc_id for x in resemblance.keep_one(docs(texts)).collect()} == want[1]
    monkeypatch.setattr(resemblance, "LIST_MOST", 3)
    monkeypatch.setattr(resemblance, "complete", lambda rows, owned: spark.createDataFrame([], "own bigint, root bigint"))
    assert {x.doc_id for x in resemblance.keep_one(docs(texts)).collect()} == want[0]


def shuffled(spark, since=-1):
    """Bytes that stages after number since wrote to shuffles, and the last stage's number."""
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    sc.listenerBus().waitUntilEmpty(30_000)
    found = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    stages = [found.apply(i) for i in range(found.size())]
    return sum(s.shuffleWriteBytes() for s in stages if s.stageId() > since), max((s.stageId() for s in stages), default=-1)


def test_texts_are_not_shuffled_whole(spark, docs, tmp_path):
    """Only texts of near copies, and rows that go or repeat, are shuffled, even if no table is small enough to be broadcast unasked."""
    r = random.Random(17)
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(5000)) for _ in range(100)]
    texts += [changed(texts[i].split(), r, 20) for i in range(5)] + [texts[7]]
    docs(texts).write.parquet(f"{tmp_path}/docs")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        last = shuffled(spark)[1]
        got = {x.doc_id for x in resemblance.keep_one(spark.read.parquet(f"{tmp_path}/docs")).collect()}
        written = shuffled(spark, last)[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == set(range(100))
    assert 0 < written < sum(map(len, texts)) / 2


def test_rows_marked_in_vain(docs, monkeypatch):
    """The bitmap loses no row, however few bits it has; rows, repeated ones too, are the same ones."""
    texts = [*spread_group(4, 30), *ODD, *ODD, *(f"other text of its own number {i} here" for i in range(50))]
    ids = [i % 70 for i in range(len(texts))]
    table = docs(texts, ids)
    want = Counter(map(str, resemblance.keep_one(table).select("doc_id", "text").collect()))
    assert 60 < len(want) < len(texts)
    for most in (1, 8, 64):
        monkeypatch.setattr(resemblance, "MARK_MOST", most)
        assert Counter(map(str, resemblance.keep_one(table).select("doc_id", "text").collect())) == want
