"""Vectorised counts beside plain ones."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from surprisal.operators import codes

TEXTS = ["", "abracadabra", None, "ăâîș 😀x\0y", "a", "zz" * 50, "the quick brown fox"]


def _counted(found):
    out = Counter()
    for b in found:
        for g, n in zip(b.column("gram").to_pylist(), b.column("cnt").to_pylist(), strict=True):
            out[g] += n
    return out


@pytest.mark.parametrize("window", [7, 1 << 20])
@pytest.mark.parametrize("depth", [0, 1, 3, 5, 12])
def test_grams(monkeypatch, window, depth):
    monkeypatch.setattr(codes, "WINDOW", window)
    monkeypatch.setattr(codes, "HELD", 20)
    off = [0, 2, 0, 1, 0, 3, 0]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(TEXTS), "off": pa.array(off, pa.int32())})
    more = pa.RecordBatch.from_pydict({"text": pa.array(["".join(map(chr, range(0x400, 0x460)))]), "off": pa.array([0], pa.int32())})
    rows = [*zip(TEXTS, off, strict=True), (more.column("text")[0].as_py(), 0)]
    want = Counter(t[max(0, i - depth) : i + 1] for t, o in rows if t for i in range(o, len(t)))
    assert _counted(codes.gram_batches(iter([batch, more, batch.slice(1, 2)]), depth)) == want + Counter(t[max(0, i - depth) : i + 1] for t, o in rows[1:3] if t for i in range(o, len(t)))


def test_padded_chunks():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(TEXTS), "off": pa.array([0] * 7, pa.int32())})
    padded = ["\x01\x01" + t[i : i + 4] + "\x01\x01" for t in TEXTS if t for i in range(0, len(t), 4)]
    assert _counted(codes.gram_batches(iter([batch]), 2, 4, 2)) == Counter(p[max(0, i - 2) : i + 1] for p in padded for i in range(len(p)))


def test_row_counts():
    found = Counter()
    for row, char, n in codes.row_counts(pa.array(TEXTS)):
        for r, c, k in zip(row.tolist(), char.tolist(), n.tolist(), strict=True):
            found[r, chr(c)] += k
    assert found == Counter((r, c) for r, t in enumerate(TEXTS) for c in t or "")


def test_lookup():
    grams = sorted({t[max(0, i - 3) : i + 1] for t in TEXTS if t for i in range(len(t))})
    n, sums = codes.Lookup(grams, np.arange(len(grams)), 3).sums(pa.array(TEXTS))
    assert n.tolist() == [len(t or "") for t in TEXTS]
    assert sums.tolist() == [sum(grams.index(t[max(0, i - 3) : i + 1]) for i in range(len(t or ""))) for t in TEXTS]


def test_plain_text_is_made_once(spark):
    from surprisal.alphabet import ENGLISH
    from surprisal.models import Unigram
    from surprisal.operators.metrics import segment_entropies
    from surprisal.operators.segments import train_test
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(0, "Ab c"), (1, ""), (2, None), (3, "çà")], "seg_id bigint, text string")
    split = train_test(rows.select("seg_id", ENGLISH.column(F.col("text")).alias("text")), 0.5)
    train, test = (split.select("seg_id", F.col(c).alias("text")) for c in ("train", "test"))
    found = segment_entropies(test, Unigram(ENGLISH).fit(train))
    assert "Filter NOT" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.seg_id for r in found.collect()) == [0, 3]


def test_costs_by_groups_look_up_or_join(spark, segs, monkeypatch):
    from surprisal.alphabet import ENGLISH
    from surprisal.models import PPM, ppm

    model = PPM(ENGLISH, 3).fit(segs("abracadabra", "the quick fox"))
    test = segs("abra cad", "", "zz fox", None, "the ă")
    looked = sorted(map(tuple, model.costs(test, ["seg_id"]).collect()))
    monkeypatch.setattr(ppm, "LOOKED_UP_MOST", 0)
    joined = sorted(map(tuple, model.costs(test, ["seg_id"]).collect()))
    assert [r[:2] for r in looked] == [r[:2] for r in joined] == [(0, 8), (2, 6), (4, 5)]
    assert [r[2] for r in looked] == pytest.approx([r[2] for r in joined])
