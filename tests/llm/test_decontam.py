import hashlib
import random
import re

import duckdb
import numpy as np
from conftest import DATA, ODD

from surprisal.llm import decontam
from surprisal.llm.queries import DECONTAMINATION_SQL

ITEMS = "item_id bigint, text string"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(texts, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = []
    for i, t in items:
        ws = word.findall(lower(t))
        n = min(13, len(ws))
        windows += [(i, tuple(ws[k : k + n])) for k in range(len(ws) - n + 1)] if n else []
    out = {}
    for d, t in texts.items():
        ws, hit, who = word.findall(lower(t)), set(), set()
        for i, w in windows:
            for k in range(len(ws) - len(w) + 1):
                if tuple(ws[k : k + len(w)]) == w:
                    hit.update(range(k, k + len(w)))
                    who.add(i)
        out[d] = (len(ws), len(hit), len(who), hashlib.sha256(",".join(sorted(map(str, who))).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(ws))
    return out


def case():
    r = random.Random(5)
    vocab = ["a", "B", "c1", "é", "x", "Y", "字"]
    items = [(k, r.choice([" ", "-", "\n"]).join(r.choices(vocab, k=n))) for k, n in enumerate([14, 20, 13, 3, 3, 1, 0, 15])] + [(90, None), (91, "?!"), (14, "a B")]
    texts = dict(enumerate(ODD))
    for i in range(40, 90):
        texts[i] = " ".join(r.choices(vocab[:4], k=r.randint(0, 60)) + (r.choice(items)[1] or "").split(" ") + r.choices(["q", "w"], k=r.randint(0, 90)))
    return texts, items


def test_brute(spark, docs):
    texts, items = case()
    frame = docs(list(texts.values()), list(texts))
    got = {r[0]: tuple(r)[1:] for r in decontam.report(frame, spark.createDataFrame(items, ITEMS)).collect()}
    assert got == brute(texts, items)
    assert len(decontam.report(frame, spark.createDataFrame([], ITEMS)).collect()) == len(texts)
    assert decontam.report(docs([]), spark.createDataFrame(items, ITEMS)).collect() == []


def test_shards(spark, docs, monkeypatch):
    texts, items = case()
    monkeypatch.setattr(decontam, "SHARD_BYTES", 64)
    frame, bench = docs(list(texts.values()), list(texts)), spark.createDataFrame(items, ITEMS)
    monkeypatch.setattr(decontam, "PIECE_WORDS", 3)
    assert decontam.shards(decontam.pieces(bench)) > 1
    got = {r[0]: tuple(r)[1:] for r in decontam.report(frame, bench).collect()}
    assert got == brute(texts, items)


def test_repeated_items_and_one_beyond_the_bound(spark, docs, monkeypatch):
    """Repeated rows of more text than a shard holds, and an item of 40 MB."""
    passage = " ".join(f"p{i}" for i in range(30))
    huge = " ".join(f"h{i * 7919 % 500_000:x}" for i in range(6_300_000))
    assert len(huge) > 40 << 20
    cut = " ".join(huge.split(" ")[3_000_000:3_000_020])
    texts = [passage + " x" * 40, "y " * 60 + cut, "z " * 500 + "p3 p4 p5", None]
    monkeypatch.setattr(decontam, "SHARD_BYTES", 4000)
    repeated = spark.range(3000).selectExpr("5 AS item_id", f"'{passage}' AS text")
    assert decontam.shards(decontam.pieces(repeated)) == 1
    got = {r[0]: tuple(r)[1:] for r in decontam.report(docs(texts), repeated).collect()}
    assert got == brute(dict(enumerate(texts)), [(5, passage)])
    monkeypatch.undo()
    items = spark.createDataFrame([(5, passage), (6, huge)], ITEMS)
    assert decontam.shards(decontam.pieces(items)) > 2
    got = {r[0]: tuple(r)[1:] for r in decontam.report(docs(texts), items).collect()}
    assert got == brute(dict(enumerate(texts)), [(5, passage), (6, cut)])


def test_windows_of_one_hash(monkeypatch):
    """Different windows that share a hash are told apart, as are a window's items."""
    monkeypatch.setattr(decontam, "BASE", np.uint64(0))
    texts, items = case()
    index = decontam.Index.build((i, min(13, len(ws)), ws) for i, t in items if (ws := decontam.words(t)))
    assert len(index.layers) > len({n for n, _ in index.layers})
    want = brute(texts, items)
    for d, t in texts.items():
        spans, who = index.hits(decontam.words(t))
        assert (sum(b - a for a, b in spans), len(who)) == want[d][1:3]


def test_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = sorted(con.sql(DECONTAMINATION_SQL).fetchall())
    mine = decontam.report(*(spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark")))
    assert sorted(map(tuple, mine.collect())) == want
    assert any(r[-1] for r in want)


def test_clean(spark, docs):
    passage = " ".join(f"w{i}" for i in range(14))
    texts = [passage + " and more", "k " * 500 + passage.upper() + ", tail " + "z " * 100, "clean text", None]
    out = {r.doc_id: r for r in decontam.clean(docs(texts), spark.createDataFrame([(1, passage)], ITEMS)).collect()}
    assert set(out) == {1, 2, 3}
    assert out[1].text == "k " * 500 + ", tail " + "z " * 100
    assert out[1].n_chars == len(out[1].text)
    assert out[2].text == "clean text" and out[3].text is None
