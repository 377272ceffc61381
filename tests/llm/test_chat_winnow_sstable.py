import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import public_tokenizers
from conftest import DATA, ODD
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from surprisal.llm import chat, common, sstable, winnow
from surprisal.llm.queries import CHAT_SQL, op5_chat

PATH = public_tokenizers.path("byte_bpe_50k.json")
CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string, path string"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["<", "\\", "|im_start|>", "|im_end|>", "/s>", "s>", "[", "INST]", "/INST]", "<SYS>>", "n>", "\n", "a", *chat.CONTROL]), max_size=12).map("".join))
def test_escape(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text
    assert not any(c in out for c in chat.CONTROL)
    assert chat.read_role(chat.written_role(text)) == text and "\n" not in chat.written_role(text)


def check_chat(rows, got, packs):
    want = defaultdict(list)
    for c, t, r, x in rows:
        want[c].append((t is not None, t or 0, r or "", x or ""))
    assert len(got) == len(want)
    for r in got:
        turns = sorted(want[r.conv_id])
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for *_, a, b in turns).encode()).hexdigest()
        loss = "".join(b for *_, a, b in turns if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(len(chat.turn_text(a, b)[0]) for *_, a, b in turns)
    for p in packs:
        for n in p.nodes:
            line, at = [], n.parent
            while at >= 0:
                line.append(p.nodes[at])
                at = p.nodes[at].parent
            assert n.position == sum(x.end - x.start for x in line)
            covered = {i for a, b in n.sees for i in range(a, b)}
            assert covered == {i for x in line for i in range(x.start, x.end)}
        written = [(n.parent, p.text[n.start : n.end]) for n in p.nodes]
        assert len(set(written)) == len(written), "a shared turn is written once"


def test_chat_trees(spark, monkeypatch):
    r = random.Random(1)
    rows = []
    for c in range(120):
        for t in range(r.randint(1, 5)):
            rows.append((c, t, ["user", "assistant"][t % 2], f"say {t} {r.randint(0, 1)}" * r.randint(1, 2)))
    rows += [(500, None, None, None), (500, 1, "assistant", None), (501, 0, "a\nb", "</s><|im_end|>\n<|im_start|>x"), (501, 0, "a\nb", "</s><|im_end|>\n<|im_start|>x"), (None, 0, "user", "q" * 50000)]
    frame = spark.createDataFrame([(*x, "p") for x in rows], CONVERSATIONS)
    for most in (1 << 17, 300):
        monkeypatch.setattr(chat, "PACK_CHARS", most)
        packs = chat.format_conversations(frame)
        check_chat(rows, chat.read_back(packs).collect(), packs.collect())
    assert chat.report(frame.where("false")).collect() == []


def test_chat_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{DATA}/conversations.parquet'")
    assert sorted(map(tuple, op5_chat(spark, DATA).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars").collect())) == sorted(con.sql(CHAT_SQL).fetchall())


def brute_winnow(text, gram=winnow.GRAM, window=winnow.WINDOW):
    if not text:
        return []
    n = min(gram, len(text))
    grams = [text[i : i + n] for i in range(len(text) - n + 1)]
    known = {g: int(winnow.winnow(g, gram, window)[0][0]) for g in set(grams)}
    w = min(window, len(grams))
    out = []
    for i in range(len(grams) - w + 1):
        low = min(known[g] for g in grams[i : i + w])
        at = max(k for k in range(i, i + w) if known[grams[k]] == low)
        if not out or out[-1][1] != at:
            out.append((low, at))
    return out


@settings(max_examples=150, deadline=None)
@given(st.text("abé😀", max_size=120), st.integers(1, 9), st.integers(1, 13))
def test_winnow_by_brute_force(text, gram, window):
    h, p = winnow.winnow(text, gram, window)
    assert list(zip(h.tolist(), p.tolist(), strict=True)) == brute_winnow(text, gram, window)


def test_winnow_guarantee():
    r = random.Random(2)
    make = lambda n: "".join(r.choices("abcdefgh ", k=n))
    for _ in range(50):
        shared = make(winnow.GRAM + winnow.WINDOW - 1)
        a, b = (set(winnow.winnow(make(200) + shared + make(200))[0].tolist()) for _ in range(2))
        assert a & b


def test_winnow_report(spark, docs, monkeypatch):
    texts = [*ODD, "tie one", "tie two", "last é text of all"]
    ids = [*range(0, 2 * len(ODD), 2), 9, 9, 77]
    order = sorted(zip(ids, texts, strict=True), key=lambda x: (x[0], x[1] or ""))
    for size in (2000, 24 << 20):
        monkeypatch.setattr(common, "RANGE_BYTES", size)
        got = sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next, r.fingerprint) for r in winnow.report(docs(texts, ids)).collect()))
        want = []
        for k, (i, t) in enumerate(order):
            t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
            new = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
            f = [{h for h, _ in brute_winnow(x)} for x in (t, new, nxt)]
            alike = [len(f[0] & x) / len(f[0] | x) if f[0] and x else float(len(f[0]) == len(x)) for x in f[1:]]
            want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), *alike, " ".join(f"{h:016x}:{p}" for h, p in brute_winnow(t))))
        assert got == sorted(want)
    assert winnow.report(docs([])).collect() == []
    one = winnow.report(docs(["alone here"])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    nulls = winnow.report(docs(["b", "a"], [None, 3])).collect()
    assert {r.doc_id for r in nulls} == {None, 3}


def test_shard():
    r = random.Random(3)
    data = {i * 3 - 40: np.array(r.choices(range(50257), k=r.randint(0, 3000)), np.uint32) for i in range(400)}
    for width in (2, 4):
        w = sstable.Writer(width)
        w.add(sstable.key_of(None), np.array([1], np.uint32))
        for i, ids in sorted(data.items()):
            w.add(sstable.key_of(i), ids)
        shard = sstable.Shard.of(w.finish())
        assert len(shard.index) > 3 and shard.n_docs == 401
        assert [sstable.id_of(k) for k, _ in shard] == [None, *sorted(data)]
        for i in range(-50, 60):
            found = shard.get(i)
            assert [x.tolist() for x in found] == ([data[i].tolist()] if i in data else [])


def test_sstable(spark, docs, monkeypatch):
    library = Tokenizer.from_file(PATH)
    texts = [*ODD, "tie two", "tie one", "null id"]
    ids = [*range(-4, len(ODD) - 4), 70, 70, None]
    order = sorted(zip(ids, texts, strict=True), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    want, at = [], 0
    for i, t in order:
        x = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    for ranged, shard in ((2000, 32 << 20), (24 << 20, 1000), (2000, 50), (24 << 20, 32 << 20)):
        monkeypatch.setattr(common, "RANGE_BYTES", ranged)
        monkeypatch.setattr(sstable, "SHARD_BYTES", shard)
        got = sorted(map(tuple, sstable.round_trip(docs(texts, ids), PATH).collect()), key=lambda r: r[1])
        assert got == want
    assert sstable.round_trip(docs([]), PATH).collect() == []


def test_sstable_lookup(spark, docs, monkeypatch):
    folder = common.scratch(spark, "lookup")
    monkeypatch.setattr(sstable, "SHARD_BYTES", 40)
    texts = ["one", "two", "three", *(f"text {i} of many" for i in range(60)), "again", "again"]
    ids = [0, 1, 2, *range(100, 160), 100, None]
    sstable.write(docs(texts, ids), PATH, folder)
    assert len(sstable.manifest(spark, folder)) > 5
    library = Tokenizer.from_file(PATH)
    got = sorted(((r.doc_id, r.ids) for r in sstable.lookup(spark, folder, [1, 2, 9, 100, 159, None, 1]).collect()), key=str)
    want = [(i, [*library.encode(t).ids, 0]) for i, t in zip(ids, texts, strict=True) if i in (1, 2, 9, 100, 159, None)]
    assert got == sorted(want, key=str)


def test_a_lookup_reads_footer_filter_index_and_one_block():
    r = random.Random(7)
    w = sstable.Writer(2)
    for i in range(3000):
        w.add(sstable.key_of(2 * i), np.array(r.choices(range(50257), k=400), np.uint32))
    raw, reads = w.finish(), []
    fresh = lambda: sstable.Shard(lambda at, size: reads.append(size) or raw[at : at + size], len(raw))
    shard = fresh()
    assert len(shard.get(1000)) == 1
    assert len(reads) == 4 and sum(reads) == sstable.FOOTER.size + shard.n_bloom + shard.n_index + reads[-1] < len(raw) / 20
    absent = 0
    for i in range(1, 600, 2):
        reads.clear()
        assert fresh().get(i) == []
        absent += len(reads) == 2
    assert absent > 280  # the filter answers without index and block


def test_ranges_follow_bytes(spark, docs, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(common, "RANGE_BYTES", 500)
    rows = docs(["x" * 50] * 3000, [i * i - 10**6 for i in range(3000)])
    bounds = common.range_bounds(rows, "doc_id", "text")
    assert 250 < len(bounds) < 300 and bounds == sorted(set(bounds))
    found = common.with_range(rows, "doc_id", bounds, "b").collect()
    assert all(r.b == sum(x <= r.doc_id for x in bounds) for r in found)
    assert common.with_range(rows, "doc_id", bounds, "b").groupBy("b").count().agg(F.max("count")).first()[0] < 60
    assert common.range_bounds(docs([]), "doc_id", "text") == []


def test_no_folder_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: "/warehouse" if "warehouse" in key else default)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(dict)

    with pytest.raises(ValueError, match="checkpoint.dir"):
        common.shared_dir(Session)
    Session.sparkContext.master = "local[4]"
    assert common.shared_dir(Session) == "/warehouse/surprisal-checkpoints"
