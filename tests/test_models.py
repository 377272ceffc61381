import math
import random
from collections import Counter, defaultdict

import pytest

from surprisal.alphabet import ENGLISH
from surprisal.models import PPM, Huffman, KneserNey, Unigram
from surprisal.models.ppm import context_edges, top_contexts

ABRA, TEST = "abracadabra", "abra cad"
FOX = ("the quick brown fox jumps over the lazy dog " * 5).strip()
CUT = int(len(FOX) * 0.7)


def near(a, b, tol=1e-9):
    assert abs(a - b) < tol, (a, b)


def test_unigram(segs):
    near(Unigram(ENGLISH).fit(segs("abcd " * 100)).entropy(), math.log2(5))
    near(Unigram(ENGLISH).fit(segs(ABRA)).entropy(), 2.0403733937)
    near(Unigram(ENGLISH).fit(segs(ABRA)).evaluate(segs(TEST)), 3.6323259505)
    near(Unigram(ENGLISH).fit(segs(FOX[:CUT])).evaluate(segs(FOX[CUT:])), 4.3864321476)
    with pytest.raises(ValueError):
        Unigram(ENGLISH, smoothing=0)
    with pytest.raises(ValueError):
        Unigram(ENGLISH).fit(segs("", None))
    with pytest.raises(RuntimeError):
        Unigram(ENGLISH).evaluate(segs("a"))
    merged = Unigram(ENGLISH).fit(segs("abra")).merge(Unigram(ENGLISH).fit(segs("cadabra")))
    near(merged.entropy(), 2.0403733937)


def test_huffman(segs):
    fit = Huffman(ENGLISH).fit(segs(ABRA))
    assert {c["ch"]: c["code"] for c in fit.codes()} == {"a": "0", "c": "100", "d": "101", "b": "110", "r": "111"}
    near(fit.values["avg_code_length"], 2.0909090909)
    near(fit.evaluate(segs(TEST)), 2.4693609378)
    assert Huffman(ENGLISH).fit(segs("aaaaaa")).codes()[0]["code"] == "0"
    for text in (FOX, "mississippi river ", "abcdefg " * 100):
        model = Huffman(ENGLISH).fit(segs(text))
        lengths = [c["code_len"] for c in model.codes()]
        assert sum(2.0**-n for n in lengths) <= 1 + 1e-12
        codes = [c["code"] for c in model.codes()]
        assert not any(a != b and b.startswith(a) for a in codes for b in codes)
        h = Unigram(ENGLISH).fit(segs(text)).entropy()
        assert h - 1e-9 <= model.evaluate(segs(text)) < h + 1


@pytest.mark.parametrize(("depth", "plain", "exclusion"), [(1, 2.5147573224, 2.4935166972), (2, 2.4138379572, 2.3925973320), (3, 2.5388379572, 2.5175973320)])
def test_ppm_goldens(segs, depth, plain, exclusion):
    near(PPM(ENGLISH, depth).fit(segs(ABRA)).evaluate(segs(TEST)), plain)
    near(PPM(ENGLISH, depth, update_exclusion=True).fit(segs(ABRA)).evaluate(segs(TEST)), exclusion)


def test_ppm_tables(segs):
    model = PPM(ENGLISH, 2).fit(segs(ABRA))
    assert model.context_tree_size() == 13
    symbols = defaultdict(dict)
    for r in model.symbols().collect():
        symbols[r.ctx][r.sym] = r.cnt
    assert symbols[""] == {"a": 5, "b": 2, "r": 2, "c": 1, "d": 1} and symbols["a"] == {"b": 2, "c": 1, "d": 1} and symbols["ab"] == {"r": 2}
    a = model.tables["contexts"].where("ctx = 'a'").first()
    assert a.u / (a.n + a.u) == 3 / 7
    near(model.symbol_probability("b", "a"), 2 / 7)
    near(PPM(ENGLISH, 3).fit(segs(FOX[:CUT])).evaluate(segs(FOX[CUT:])), 0.5029050783)
    top = top_contexts(model.tables["contexts"], 5).collect()
    assert [(r.ctx, r.n) for r in top][:2] == [("a", 4), ("b", 2)]
    assert ("b", "ab") in {(r.parent, r.child) for r in context_edges(model.top_contexts()).collect()}
    for bad in (0, 13):
        with pytest.raises(ValueError):
            PPM(ENGLISH, bad)
    assert PPM(ENGLISH, 2, escape_method="D").to_dict()["escape_method"] == "A"
    parts = PPM(ENGLISH, 2).fit(segs("abra")).merge(PPM(ENGLISH, 2).fit(segs("cad")))
    near(parts.evaluate(segs(TEST)), PPM(ENGLISH, 2).fit(segs("abra", "cad")).evaluate(segs(TEST)))


def brute_ppm(train, test, depth, size):
    tree = defaultdict(Counter)
    for t in train:
        for i, c in enumerate(t):
            for k in range(min(i, depth) + 1):
                tree[t[i - k : i]][c] += 1
    bits = n = 0
    for t in test:
        for i, c in enumerate(t):
            n += 1
            p = 1.0
            for k in range(min(i, depth), -1, -1):
                seen = tree.get(t[i - k : i])
                if not seen:
                    continue
                total = sum(seen.values()) + len(seen)
                if c in seen:
                    p *= seen[c] / total
                    break
                p *= len(seen) / total
            else:
                p /= size
            bits -= math.log2(max(p, 1e-300))
    return bits / n


@pytest.mark.parametrize("seed", range(4))
def test_ppm_by_brute_force(segs, seed):
    r = random.Random(seed)
    make = lambda letters: ["".join(r.choices(letters, k=r.randint(0, 400))) for _ in range(4)]
    train, test, depth = [*make("abc "), "x" * 250], make("abcd "), r.randint(1, 6)
    near(PPM(ENGLISH, depth).fit(segs(*train)).evaluate(segs(*test)), brute_ppm(train, test, depth, 27))


@pytest.mark.parametrize(("n", "every", "top"), [(2, 2.3750242865, 2.1584679365), (3, 2.1909550267, 2.1500247800), (5, 2.1821438184, 2.7429306257)])
def test_kneser_ney_goldens(segs, n, every, top):
    for boundary in ("segment", "concat"):
        near(KneserNey(ENGLISH, n, boundary=boundary).fit(segs(ABRA)).evaluate(segs(TEST)), every)
        near(KneserNey(ENGLISH, n, mode="top", boundary=boundary).fit(segs(ABRA)).evaluate(segs(TEST)), top)


def test_kneser_ney_chunks(segs):
    long = "hello world this is a test "
    for n, want in ((2, 2.4858663839), (3, 1.8584401541), (5, 1.2551638519)):
        near(KneserNey(ENGLISH, n).fit(segs(long * 400)).evaluate(segs(long * 5)), want)
    near(KneserNey(ENGLISH, 3).fit(segs("aaaaa     bbbbb")).evaluate(segs("zzzzz")), 2.3901460577)
    whole = long * 400
    cuts = [whole[a:b] for a, b in ((0, 350), (350, 350), (350, 3999), (3999, 10800))]
    near(KneserNey(ENGLISH, 3, boundary="concat").fit(segs(*cuts)).evaluate(segs(long * 5)), 1.8584401541)
    with pytest.raises(ValueError):
        KneserNey(ENGLISH, 9)


@pytest.mark.parametrize("model", [Unigram(ENGLISH), Huffman(ENGLISH), PPM(ENGLISH, 3), KneserNey(ENGLISH, 3)])
def test_save_and_load(spark, segs, tmp_path, model):
    fit = model.fit(segs(FOX))
    fit.save(str(tmp_path / "m"))
    back = type(model).load(spark, str(tmp_path / "m"))
    near(back.evaluate(segs(TEST)), fit.evaluate(segs(TEST)))
    assert back.to_dict() == fit.to_dict()
    with pytest.raises(RuntimeError):
        model.save(str(tmp_path / "n"))
    by = {r.seg_id: r.bits / r.events for r in fit.costs(segs("abra", "fox the"), ["seg_id"]).collect()}
    near(by[1], fit.evaluate(segs("fox the")))


@pytest.mark.parametrize("depth", [4])
def test_contexts_across_segments(spark, monkeypatch, depth):
    """Any cutting into segments, empty ones among them, gives the figures of the one joined text."""
    from surprisal.operators import segments as parts

    r = random.Random(depth)
    whole = PPM(ENGLISH, depth, boundary="concat").fit(spark.createDataFrame([(0, FOX[:CUT])], "seg_id bigint, text string"))
    want = whole.evaluate(spark.createDataFrame([(0, FOX[CUT:])], "seg_id bigint, text string"))
    near(want, PPM(ENGLISH, depth).fit(spark.createDataFrame([(0, FOX[:CUT])], "seg_id bigint, text string")).evaluate(spark.createDataFrame([(0, FOX[CUT:])], "seg_id bigint, text string")))

    def cut(text):
        places = sorted(r.choices(range(len(text) + 1), k=40))
        bits = [text[a:b] for a, b in zip([0, *places], [*places, len(text)], strict=True)]
        return spark.createDataFrame([(10 * i - 50, t) for i, t in enumerate(bits)], "seg_id bigint, text string").repartition(3)

    for rows in (1_000_000, 3):
        monkeypatch.setattr(parts, "STRETCH_ROWS", rows)
        model = PPM(ENGLISH, depth, boundary="concat").fit(cut(FOX[:CUT]))
        near(model.evaluate(cut(FOX[CUT:])), want)
        assert model.context_tree_size() == whole.context_tree_size()
        near(KneserNey(ENGLISH, 3, boundary="concat").fit(cut(FOX)).evaluate(cut(FOX[CUT:])), KneserNey(ENGLISH, 3).fit(cut(FOX[:0] + FOX).limit(0).union(spark.createDataFrame([(0, FOX)], "seg_id bigint, text string"))).evaluate(spark.createDataFrame([(0, FOX[CUT:])], "seg_id bigint, text string")))
    with pytest.raises(ValueError, match="segment"):
        model.costs(cut(FOX), ["seg_id"])
    with pytest.raises(ValueError, match="boundary"):
        PPM(ENGLISH, 3, boundary="chunk")


def test_codelength_paths(segs, monkeypatch):
    from surprisal.operators import coding

    train, test = segs(FOX[:60], FOX[60:CUT]), segs(FOX[CUT:], "zebra")
    for boundary in ("segment", "concat"):
        model = PPM(ENGLISH, 3, boundary=boundary).fit(train)
        assert coding.verify_codelength(test, model)["delta_bpc"] < 1e-9
    monkeypatch.setattr(coding, "REPLAYED_MOST", 2)
    assert coding.verify_codelength(test, PPM(ENGLISH, 3).fit(train))["delta_bpc"] < 1e-9
