import random
from collections import Counter, defaultdict

import numpy as np
import xxhash
from conftest import DATA, ODD

from surprisal.llm import components as parts
from surprisal.llm import simhash
from surprisal.llm.components import components


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, linked):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def brute(texts):
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    ids = sorted(fps)
    near = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if bin(fps[a] ^ fps[b]).count("1") <= 3]
    return {i: (f"{fps[i]:016x}", r) for i, r in roots(ids, near).items()}


def test_whole_table(spark):
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text for r in table.select("doc_id", "text").collect()}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(table).collect()} == brute(texts)


def test_odd(spark, docs):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs(ODD)).collect()}
    assert got == brute(dict(enumerate(ODD)))
    assert simhash.near_duplicates(docs([])).collect() == []
    assert Counter(r.component_id for r in simhash.near_duplicates(docs(["a b c", "a b c", None], [None, 4, None])).collect()) == {4: 2, None: 1}


def linked_like_brute(spark, fps):
    frame = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp bigint")
    links = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(frame).collect()]
    near = [(a, b) for k, a in enumerate(fps) for b in fps[k + 1 :] if bin(a ^ b).count("1") <= 3]
    assert all(bin(a ^ b).count("1") <= 3 for a, b in links) or len(links) < len(fps) * 8 * 90
    assert roots(fps, links) == roots(fps, near)


def clustered(seed, groups, each):
    r = random.Random(seed)
    out = set()
    for _ in range(groups):
        base = r.getrandbits(64)
        for _ in range(each):
            out.add(base ^ sum(1 << b for b in set(r.choices(range(64), k=r.randint(0, 5)))))
    return sorted(out)


def test_links_miss_nothing(spark):
    linked_like_brute(spark, clustered(1, 40, 12))


def test_long_lists(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LIST_MOST", 5)
    linked_like_brute(spark, clustered(2, 4, 60))


def test_still_long_lists(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LIST_MOST", 5)
    r = random.Random(3)
    linked_like_brute(spark, sorted({0xABCDEF0123 << 24 | sum(1 << b for b in r.choices(range(24), k=6)) for _ in range(120)}))


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(1, 60)] + [(100 + r.randrange(80), 100 + r.randrange(80)) for _ in range(60)] + [(500, 500 + i) for i in range(1, 40)] + [(7, 7)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = roots({n for e in edges for n in e}, edges)
    assert got == {n: want[n] for n in got} and set(got) == {n for a, b in edges if a != b for n in (a, b)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_components_of_light_and_heavy_nodes(spark, monkeypatch):
    monkeypatch.setattr(parts, "HEAVY_MOST", 8)
    test_components(spark)
    rows = [(1, 5), (1, 3), (1, 4), (1, 9), (2, 7), (3, None), (4, 2), (4, 2), (5, 1)]
    got = parts.lowest(spark.createDataFrame(rows, "k bigint, v bigint"), "k", "v", "low")
    assert got.columns == ["k", "v", "low"]
    assert Counter(map(tuple, got.collect())) == Counter((k, v, {1: 3, 2: 7, 3: None, 4: 2, 5: 1}[k]) for k, v in rows)


def test_keep_one(spark, docs):
    texts = [*ODD, "the quick brown fox jumps over it", "the quick brown fox jumps over it", None]
    ids = [*range(len(ODD)), 50, 50, 60]
    kept = simhash.keep_one(docs(texts, ids))
    assert "fp" in kept.columns
    rows = Counter(r.doc_id for r in kept.collect())
    want = brute(dict(zip(ids, texts, strict=True)))
    groups = defaultdict(list)
    for i, (_, root) in want.items():
        groups[root].append(i)
    assert rows == Counter(min(g) for g in groups.values())
