import gzip
import io
import json
import math
import tarfile
import unicodedata
import zipfile

import duckdb
import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from surprisal.alphabet import ENGLISH, ENGLISH_NO_SPACE, ROMANIAN_32, ROMANIAN_NO_DIACRITICS, get_alphabet
from surprisal.functions.text import redundancy_of
from surprisal.models import PPM, Unigram
from surprisal.operators import coding, metrics, segments, validation
from surprisal.plans import oracles, queries, tables
from surprisal.plans.report import escape_latex, latex_report, markdown_report, report_context
from surprisal.sources import download, registry, results, text

DATA = "/root/testdata/sf0.001"
PUNCT = ENGLISH.variant(include_punctuation=True)


def test_alphabets():
    assert [a.size for a in (ENGLISH, ENGLISH_NO_SPACE, ROMANIAN_32, ROMANIAN_NO_DIACRITICS, PUNCT)] == [27, 26, 32, 27, 42]
    assert ROMANIAN_32.variant(include_punctuation=True).name == "Romanian-47" and ENGLISH.variant(include_diacritics=True).name == "English-32"
    assert ENGLISH.normalize("Hello, World! 123") == "hello  world     "
    assert PUNCT.normalize("Hello, World! 123") == "hello, world!    "
    assert ENGLISH_NO_SPACE.normalize("Hello, World!") == "helloworld"
    assert ENGLISH.normalize("é") == ENGLISH.normalize("é") == "e" and ROMANIAN_32.normalize("Bună é") == "bună  "
    assert ENGLISH.from_indices(ENGLISH.to_indices("abc z")) == "abc z"
    with pytest.raises(ValueError):
        get_alphabet("Klingon-1")


MARKED = st.sampled_from(["a", "e", "B", "Ș", "ș", "ţ", "É", "ñ", "ß", "İ", "́", "̂", "̆", "̦", "̧", "q", " ", "\n", "1", "字", "😀", "ấ", "K", "!", "-", "]", "Ǆ"])


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(MARKED, max_size=8).map("".join), min_size=80, max_size=120))
def test_columns_like_the_definition(spark, texts):
    # Two marks of one kind in other than canonical order are what exact_column is for.
    texts = [t for t in texts if unicodedata.normalize("NFD", unicodedata.normalize("NFC", t)) == unicodedata.normalize("NFD", t) == "".join(unicodedata.normalize("NFD", c) for c in t)]
    rows = spark.createDataFrame(list(enumerate([*texts, None, ""])), "i int, text string")
    for a in (ENGLISH, ENGLISH_NO_SPACE, ROMANIAN_32, PUNCT):
        for r in rows.select("text", a.column(F.col("text")).alias("n"), a.exact_column(F.col("text")).alias("x")).collect():
            want = None if r.text is None else a.normalize(r.text)
            assert r.x == want
            assert r.n == want, (a.name, r.text, r.n, want)


def test_marks_between_a_letter_and_its_mark(spark):
    texts = ["a\u0327\u0302", "a\u0326\u0301", "e\u0326\u0306", "a\u0327\u0302\u0301b", "a\u0323\u0302", "a\u0327\u0326\u0306", "A\u0334\u0327\u030a", "s\u0323\u0307x", "q\u0327\u0302"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for a in (ENGLISH, ENGLISH_NO_SPACE, ROMANIAN_32, PUNCT):
        assert [(r.text, r.n) for r in rows.select("text", a.column(F.col("text")).alias("n")).collect()] == [(t, a.normalize(t)) for t in texts], a.name


def test_segments(spark, segs):
    got = segments.train_test(segs("abcdefghij", "", "é😀z")).collect()
    assert [(r.train, r.test) for r in got] == [("abcdefgh", "ij"), ("", ""), ("é😀", "z")]
    for bad in (0, 1, -1):
        with pytest.raises(ValueError):
            segments.train_test(segs("a"), bad)
    assert [(r.block_id, r.text) for r in segments.blocks(segs("abc\nd"), 2).collect()] == [(0, "ab"), (1, "c\n"), (2, "d")]
    spans = spark.createDataFrame([("c", 0, 1, 3), ("c", 1, 2, 99), ("c", 2, 3, 3)], "corpus string, seg_id bigint, start bigint, end bigint")
    whole = spark.createDataFrame([("c", "hello")], "corpus string, text string")
    assert [(r.seg_id, r.text) for r in segments.from_spans(whole, spans).collect()] == [(0, "el")]
    segments.validate(segs("abc", "d e"), ENGLISH)
    with pytest.raises(ValueError, match="2 characters"):
        segments.validate(segs("abcÉ!"), ENGLISH)
    with pytest.raises(ValueError):
        segments.validate(segs(""), ENGLISH)


def test_redundancy_and_gains(spark):
    for h, want in ((1.5, 0.68454), (0, 1), (4.755, 0), (5.0, 0)):
        assert abs(redundancy_of(h, 4.755) - want) < 1e-4
    raw = spark.createDataFrame([("unigram", 1, 4.2), ("ngram-kn", 5, 2.5), ("ppm", 8, 1.5), ("huffman", 1, 4.22), ("bad", 1, 0.0)], "model_choice string, order int, bits_per_char double").withColumn("log2_alphabet_size", F.lit(4.755))
    rows = [r.asDict() for r in metrics.by_entropy(metrics.normalized_results(raw)).collect()]
    assert [r["model"] for r in rows] == ["huffman", "unigram", "ngram-kn", "ppm"]
    three = spark.createDataFrame([("huffman", 0.12), ("ngram-kn", 0.47), ("ppm", 0.68)], "model string, redundancy double")
    gains = metrics.redundancy_gains(three).first()
    assert np.allclose([gains.huffman_to_ngram_gain, gains.huffman_to_ppm_gain, gains.ngram_to_ppm_gain], [0.35, 0.56, 0.21])
    shown = tables.comparison(rows).splitlines()
    assert shown[0].startswith("Model") and len({len(x) for x in shown}) == 1 and "PPM (depth=8)" in shown[-1]
    assert tables.comparison([]).count("\n") == 1
    assert tables.comparison(rows, "csv").splitlines()[1].startswith("huffman,1,4.220000,4.755000,")
    assert json.loads(tables.comparison(rows, "json"))[0]["model"] == "huffman"
    assert tables.comparison(rows, "markdown").splitlines()[1] == "| --- | --- | --- | --- | --- | --- |"


def test_bootstrap(spark, segs):
    test = segs("hello world this is a bootstrap test " * 250, "short")
    model = Unigram(ENGLISH).fit(test)
    a = validation.block_bootstrap(test, model, 500, 20)
    assert a == validation.block_bootstrap(test, model, 500, 20) and a["ci_lower_bpc"] <= a["mean_bpc"] <= a["ci_upper_bpc"]
    wide, slim = (validation.block_bootstrap(test, model, 200, 50, c) for c in (0.99, 0.5))
    assert wide["ci_upper_bpc"] - wide["ci_lower_bpc"] >= slim["ci_upper_bpc"] - slim["ci_lower_bpc"]
    assert validation.block_bootstrap(test, model, 500, 1)["std_bpc"] == 0
    for bad in ({"block_size": 0}, {"n_resamples": 0}, {"confidence_level": 1.0}):
        with pytest.raises(ValueError):
            validation.block_bootstrap(test, model, **bad)
    ci = validation.bootstrap_redundancy(bits_per_char=1.5, log2_alphabet_size=4, bootstrap_results={"ci_lower_bpc": 1.0, "ci_upper_bpc": 2.0})
    assert ci == {"redundancy": 0.625, "ci_lower_redundancy": 0.5, "ci_upper_redundancy": 0.75}
    each = validation.segment_bootstrap(test, model, block_size=500, n_resamples=10)
    assert set(each) == {0, 1} and each[1]["n_blocks"] == 1
    p = validation.poisson_bootstrap(validation.block_costs(test, model, 200), 200).first()
    assert abs(p.mean_bpc - a["mean_bpc"]) < 0.05
    # The draws are numpy's own.
    r = np.random.default_rng(7)
    assert validation.draws(5, 2, 7).tolist() == [r.integers(0, 5, 5).tolist(), r.integers(0, 5, 5).tolist()]


def test_ablations_and_coding(segs):
    ro = segs("ana are mere și pere " * 30)
    found = validation.ablation_study(model=Unigram, base=ROMANIAN_32, train=ro, test=ro, ablations=["no_diacritics", "no_space"])
    assert [v["name"] for v in found["variants"]] == ["no_diacritics", "no_space"] and [v["alphabet_size"] for v in found["variants"]] == [27, 31]
    assert math.isclose(found["variants"][0]["delta_bpc"], found["variants"][0]["bits_per_char"] - found["baseline"]["bits_per_char"])
    for style in ("table", "markdown", "csv"):
        assert "no_space" in tables.sensitivity(found, style)
    with pytest.warns(UserWarning):
        assert validation.ablation_study(model=Unigram, base=ENGLISH, train=ro, test=ro, ablations=["what"])["variants"] == []
    t = segs("hello world this is a test " * 20)
    for model in (Unigram(ENGLISH), PPM(ENGLISH, 3), PPM(ENGLISH, 3, update_exclusion=True)):
        v = coding.verify_codelength(segs("this is hello x"), model.fit(t))
        assert v["matches"] and v["delta_bpc"] < 1e-9
    payload, bits = coding.ArithmeticCoder(16).encode_with_model(t, PPM(ENGLISH, 2).fit(t))
    assert len(payload) == (math.ceil(bits) + 7) // 8 and not any(payload)


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("b.txt", "Hello")
        z.writestr("a.txt", "caf\xe9".encode("latin-1"))
    assert text.joined(text.zip_text(spark, str(tmp_path / "a.zip"))).first().text == "Hello\ncafé"
    (tmp_path / "g.txt.gz").write_bytes(gzip.compress(b"Salut lume!"))
    assert text.gzip_text(spark, str(tmp_path / "g.txt.gz")).first().text == "Salut lume!"
    for name, members in (("x.tgz", ["other.txt", "europarl-v7.ro-en.ro"]), ("y.tgz", ["nested/path/ro-en/euro.ro"]), ("z.tgz", ["none.txt"])):
        with tarfile.open(tmp_path / name, "w:gz") as t:
            for m in members:
                info = tarfile.TarInfo(m)
                info.size = 4
                t.addfile(info, io.BytesIO(b"buna"))
    assert [text.europarl(spark, str(tmp_path / n)).first().member for n in ("x.tgz", "y.tgz")] == ["europarl-v7.ro-en.ro", "nested/path/ro-en/euro.ro"]
    with pytest.raises(Exception, match="no ro text"):
        text.europarl(spark, str(tmp_path / "z.tgz")).collect()
    (tmp_path / "p.txt").write_bytes(b"ok \xff bytes")
    assert text.plain_text(spark, str(tmp_path / "p.txt")).first().text == "ok  bytes"
    (tmp_path / "broken.zip").write_bytes(b"no zip")
    assert text.any_text(spark, str(tmp_path / "broken.zip")).first().text == ""
    (tmp_path / "l.jsonl").write_text('{"text": "one"}\nnot json\n{"other": 1}\n{"text": "two"}\n')
    assert sorted(r.text for r in text.json_lines(spark, str(tmp_path / "l.jsonl")).collect()) == ["one", "two"]
    (tmp_path / "brown").write_text("The/at dog/nn ran/vbd ./.\n")
    assert text.tagged_words(spark, str(tmp_path / "brown")).first().text == "The dog ran ."
    page = "<mediawiki><page><title>T</title><ns>0</ns><revision><text>'''Bold''' [[link|shown]] {{box}} &lt;ref&gt;x&lt;/ref&gt;end</text></revision></page><page><title>R</title><ns>4</ns><revision><text>no</text></revision></page></mediawiki>"
    (tmp_path / "w.xml").write_text(page)
    assert [(r.title, r.text) for r in text.wikipedia(spark, str(tmp_path / "w.xml")).collect()] == [("T", "Bold shown  end")]
    with pytest.raises(ValueError):
        text.get_extractor("Nope")


def test_registry_and_download(spark, tmp_path):
    assert registry.list_corpora("ro") == [("ro", "europarl"), ("ro", "opus"), ("ro", "oscar"), ("ro", "wikipedia")] and registry.corpora_table(spark).count() == 8
    assert registry.wiki_url("en", "2025-10-01") == ("2025-10-01", "https://dumps.wikimedia.org/enwiki/20251001/enwiki-20251001-pages-articles.xml.bz2")
    assert registry.wiki_url("ro", "20251001")[0] == "2025-10-01" and "/latest/" in registry.wiki_url("de", "soon")[1] and registry.wiki_url("de", "soon")[0] == "soon"
    with pytest.raises(KeyError):
        registry.get_corpus("en", "nope")
    body = b"0123456789"

    class Answer(io.BytesIO):
        def __init__(self, data, status, headers):
            super().__init__(data)
            self.status, self.headers = status, headers

    asked = []

    def opener(request, timeout):
        asked.append(dict(request.headers))
        if len(asked) == 1:
            raise ConnectionError
        if "Range" in request.headers:
            at = int(request.headers["Range"][6:-1])
            return Answer(body[at:], 206, {"Content-Range": f"bytes {at}-9/10"})
        return Answer(body, 200, {})

    (tmp_path / "f.part").write_bytes(body[:4])
    made = download.download("http://x/f", tmp_path / "f", opener=opener, wait=0)
    assert made.read_bytes() == body and asked[1] == {"Range": "bytes=4-"} and (tmp_path / "f.sha256").read_text() == download.sha256_file(made)
    assert download.download("http://x/f", tmp_path / "f", opener=None) == made
    with pytest.raises(ValueError):
        download.download("http://x/f", tmp_path / "g", sha256="00", opener=opener, wait=0)
    assert not (tmp_path / "g").exists()
    assert download.digest_key("a", 1) == download.sha256_text("a|1|")
    assert download.file_digests(spark, str(made)).first().sha256 == download.sha256_file(made)


def test_results_and_report(spark, tmp_path):
    folder = tmp_path / "entropy" / "en" / "text8" / "s"
    boot = {"mean_bpc": 1.5, "ci_lower_bpc": 1.45, "ci_upper_bpc": 1.55, "n_resamples": 10, "block_size": 100, "confidence_level": 0.95}
    sens = {"baseline": {"bits_per_char": 1.5, "redundancy": 0.68}, "variants": [{"name": "no_space", "alphabet_size": 26, "log2_alphabet_size": 4.7, "bits_per_char": 2.0, "redundancy": 0.57, "delta_bpc": 0.5, "delta_redundancy": -0.1}]}
    for name, extra in (("unigram", {"order": 1, "bits_per_char": 4.2}), ("ngram-kn", {"order": 5, "bits_per_char": 2.5}), ("ppm", {"depth": 8, "bits_per_char": 1.5, "bootstrap": boot, "sensitivity": sens}), ("huffman", {"order": 1, "bits_per_char": 4.22})):
        results.save_json({"model_choice": name, "log2_alphabet_size": 4.755, "alphabet_size": 27} | extra, folder / f"{name}.json")
    (folder / "bad.json").write_text("{nope")
    results.save_json({"x": 1}, folder / "comparison.json")
    c = report_context(spark, "en", "text8", "s", str(tmp_path), str(tmp_path))
    assert c["ppm_bpc"] == 1.5 and c["ppm_order"] == 8 and c["ngram_best_order"] == 5 and len(c["comparison_table_data"]) == 4
    assert abs(c["ppm_ci_width"] - 0.05) < 1e-9 and c["space_delta"] == 0.5 and c["ablations_list"] == "no_space"
    assert "no_space" in markdown_report(c) and "\\begin{tabular}" in latex_report(c, "unknown")
    assert escape_latex("a_b{c}\\&") == r"a\_b\{c\}\textbackslash{}\&"
    with pytest.raises(FileNotFoundError):
        report_context(spark, "ro", "opus", "s", str(tmp_path))
    assert results.bootstrap_csv(boot | {"redundancy_ci": {"redundancy": 0.68}}).splitlines()[1].startswith("1.500000,1.450000,1.550000,0.680000,")
    raw = spark.createDataFrame([("Ab é!",), ("c",)], "text string")
    card = results.make_card(raw, ENGLISH, corpus_name="x", language="en")
    assert card["char_count"] == 6 and card["unique_chars"] == [" ", "a", "b", "c", "e"] and card["alphabet_coverage"] == 1.0
    results.save_json(card, tmp_path / "card.json")
    assert results.load_cards(spark, str(tmp_path / "card.json")).first().unique_chars == card["unique_chars"]


def test_oracles(spark):
    """Every query with SQL gives the same rows as DuckDB."""
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations", "events"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    sql, made = oracles.oracle_sql(), queries.queries()
    assert set(sql) <= set(made)
    for name in set(sql) - {"best_model_per_family", "kn_cross_entropy_o5", "ppm_cross_entropy_d5"}:
        got = made[name](spark, DATA).toPandas()
        want = con.sql(sql[name]).df()
        assert sorted(got.columns) == sorted(want.columns), name
        columns = sorted(got.columns)
        assert sorted(map(str, got[columns].itertuples(index=False, name=None))) == sorted(map(str, want[columns].itertuples(index=False, name=None))), name


def test_texts_come_back_from_every_form(spark, tmp_path, monkeypatch):
    from surprisal.sources import sinks, text

    rows = [("a", "plain é text"), ("b", ""), ("c", None), ("d", "line\nline 😀"), ("e", "x" * 5000)]
    frame = spark.createDataFrame(rows, "name string, text string").repartition(2)
    readers = {"plain": text.plain_text, "readable": text.readable_text, "gzip": text.gzip_text, "bz2": text.any_text, "zip": text.zip_text, "tgz": text.any_text, "jsonl": text.json_lines}
    monkeypatch.setattr(sinks, "ARCHIVE_BYTES", 100)
    for form, reader in readers.items():
        sinks.write_texts(frame, f"file://{tmp_path}/{form}", form)
        assert sorted(r.text for r in reader(spark, f"file://{tmp_path}/{form}").collect()) == sorted(t or "" for _, t in rows if t or form not in ("plain", "readable")), form
    with pytest.raises(ValueError, match="forms"):
        sinks.write_texts(frame, f"file://{tmp_path}/x", "rar")


def test_comparison_of_a_corpus(spark):
    rows = [("PPM", 8, 1.5), ("ngram-kn", 5, 2.5), ("huffman", 1, 4.22)]
    found = spark.createDataFrame([(m, o, h, 4.755, f"{i}.json") for i, (m, o, h) in enumerate(rows)], "model_choice string, order int, bits_per_char double, log2_alphabet_size double, file_name string")
    normal = metrics.normalized_results(found)
    said = json.loads(tables.comparison_json([r.asDict() for r in metrics.by_entropy(normal).collect()], metrics.redundancy_gains(normal).first().asDict(), "en", "text8", "2025-10-01"))
    assert [said[k] for k in ("lang", "corpus", "snapshot")] == ["en", "text8", "2025-10-01"] and set(said) == {"lang", "corpus", "snapshot", "results", "gains"}
    assert [r["model"] for r in said["results"]] == ["huffman", "ngram-kn", "PPM"] and abs(said["gains"]["huffman_to_ngram_gain"] - (4.22 - 2.5) / 4.755) < 1e-9
    assert metrics.find_result(found, "ppm").first()["order"] == 8
    assert metrics.find_result(found, "ppm", 5).isEmpty() and metrics.find_result(found, "ngram-KN", 5).count() == 1
