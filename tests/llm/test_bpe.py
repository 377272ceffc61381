import hashlib
import json

import numpy as np
import public_tokenizers
import pytest
from conftest import ODD
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from surprisal.llm import bpe, sstable

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
PIECES = st.sampled_from(["'", "s", "t", "re", "ll", " ", "  ", "\n", "a", "é", "1", "²", "!", "\x1c", "\x85", "\xa0", "<|endoftext|>", "_", "　", "aaaa", "Ω", "字", "😀", "́"])


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=14).map("".join) | st.text(max_size=30))
def test_like_the_library(text):
    mine = bpe.load(PATH)
    ids = mine.encode([text])[0]
    assert ids.tolist() == ids_of(text)
    assert mine.decode(ids) == LIBRARY.decode(ids.tolist(), skip_special_tokens=False)
    assert sstable.library_encoder(PATH)[0]([text, text])[1].tolist() == ids_of(text)


@pytest.mark.parametrize("word", ["ab" * 3000, "x" * 5000, "abcabd" * 50, "a" * 257])
def test_long_words(word):
    assert bpe.load(PATH).words([word])[0].tolist() == ids_of(word)
    assert bpe.load(PATH).merge_words([word[:100].encode()])[0].tolist() == ids_of(word[:100])


def thue_morse(n, letters="ab"):
    """A word and its complement, which polynomial hashes modulo a power of two do not tell apart."""
    bits = [i.bit_count() & 1 for i in range(n)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096])
def test_words_of_one_hash(n):
    a, b = thue_morse(n)
    for texts in ([a, b], [b, a, b], [f"{a} {b}", f"x {b} {a}", a]):
        mine = bpe.Bpe(PATH)
        got = mine.encode(texts)
        assert [x.tolist() for x in got] == [ids_of(t) for t in texts]
        assert [mine.decode(x) for x in got] == texts
        assert [x.tolist() for x in mine.encode([b])] == [ids_of(b)]


def test_words_of_one_hash_and_other_lengths(monkeypatch):
    mine = bpe.Bpe(PATH)
    monkeypatch.setattr("surprisal.llm.flatwords.powers", lambda n: (np.zeros(n, np.uint64), np.zeros(n, np.uint64)))
    for texts in (["one three five", "seven one"], ["three é😀 one", "", "one"], ["five" * 90]):
        assert [x.tolist() for x in mine.encode(texts)] == [ids_of(t) for t in texts]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "ab", "ba", "thé", "字", "12", "!?"]), st.integers(1, 2500)), max_size=4))
def test_long_words_like_the_library(parts):
    text = " ".join((p * n)[:5000] for p, n in parts)
    assert bpe.load(PATH).encode([text])[0].tolist() == ids_of(text)


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr("surprisal.llm.flatwords.CACHE_WORDS", 3)
    mine = bpe.Bpe(PATH)
    for text in ["one two three four", "five six", "one two seven", ""] * 3:
        assert mine.encode([text])[0].tolist() == ids_of(text)


def test_round_trip(spark, docs):
    got = {r.doc_id: r for r in bpe.round_trip(docs(ODD), PATH).collect()}
    assert len(got) == len(ODD)
    for i, text in enumerate(ODD):
        ids = ids_of(text)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_encode_then_decode(spark, docs):
    encoded = bpe.encode(docs(ODD), PATH)
    back = {r.doc_id: r.text for r in bpe.decode(encoded, PATH).collect()}
    assert back == {i: t or "" for i, t in enumerate(ODD)}
    assert bpe.encode(docs([]), PATH).collect() == []
    assert bpe.round_trip(docs([]), PATH).collect() == []


def test_library_takes_several_words_at_once():
    text = "The men, who came at 10 o'clock, didn't say \"why\".\nThey sat down and ate; the rest is known to all of us here.\n" * 5
    words, pieces = ([w for w, _ in t.pre_tokenizer.pre_tokenize_str(text)] for t in (LIBRARY, sstable.library(PATH)))
    assert "".join(words) == "".join(pieces) and len(pieces) < len(words) / 8
    assert set(np.cumsum([*map(len, pieces)])) <= set(np.cumsum([*map(len, words)]))


@pytest.mark.parametrize("around", ["", "x'", "'", " ", "\n", "7", ".", "é"])
def test_pieces_where_tokens_join(around):
    with open(PATH, encoding="utf-8") as f:
        merges = json.load(f)["model"]["merges"]
    back = {s: b for b, s in bpe.byte_symbols().items()}
    joined = ["".join(m.split(" ") if isinstance(m, str) else m) for m in merges[::5]]
    texts = [around + bytes(back[c] for c in s).decode(errors="ignore") + around for s in joined]
    assert [x.tolist() for x in sstable.library_encoder(PATH)[0](texts)] == [e.ids for e in LIBRARY.encode_batch_fast(texts, add_special_tokens=False)]


def test_pieces_only_where_ids_are_the_same():
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    assert sstable.piece_pattern(spec)
    assert sstable.piece_pattern(spec | {"pre_tokenizer": None}) is None
    assert sstable.piece_pattern(spec | {"pre_tokenizer": spec["pre_tokenizer"] | {"use_regex": False}}) is None
    assert sstable.piece_pattern(spec | {"model": spec["model"] | {"ignore_merges": True}}) is None
    assert sstable.piece_pattern(spec | {"model": spec["model"] | {"merges": [[a, b] for a in bpe.byte_symbols().values() for b in bpe.byte_symbols().values()]}}) is None


def test_pieces_with_merges_across_words(tmp_path):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"] |= {"vocab": spec["model"]["vocab"] | {"sĠ": 50257, "a,": 50258}, "merges": [["s", "Ġ"], ["a", ","], *spec["model"]["merges"]]}
    path = tmp_path / "odd.json"
    path.write_text(json.dumps(spec))
    texts = ["his a, b is  as", "a, s  x s a,a s", "yes it is a, so"]
    assert [x.tolist() for x in sstable.library_encoder(str(path))[0](texts)] == [Tokenizer.from_file(str(path)).encode(t).ids for t in texts]
