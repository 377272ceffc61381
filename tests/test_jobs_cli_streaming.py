import json
import os
import re
import time

import pytest

from surprisal import cli
from surprisal.alphabet import ENGLISH
from surprisal.config import Config
from surprisal.jobs import JobRunner, Status
from surprisal.models import PPM
from surprisal.operators.counts import char_counts, context_counts
from surprisal.plans import report
from surprisal.streaming import counts as streaming


def test_jobs(spark, segs, tmp_path):
    runner = JobRunner(spark, segs("abracadabra", "cad"), artifacts=str(tmp_path))
    states = {k: runner.wait(runner.submit(k)) for k in ("entropy", "huffman", "ppm")}
    assert {s.status for s in states.values()} == {Status.COMPLETED}
    assert states["entropy"].result["x"][0] == "a" and states["entropy"].result["total"] == 14
    assert states["huffman"].result["codes"][0]["symbol"] == "a"
    assert states["ppm"].result["nodes"] and states["ppm"].result["edges"]
    bad = runner.wait(runner.submit("proof", {"lang": "xx"}))
    assert bad.status == Status.FAILED and bad.error
    assert len(list(tmp_path.glob("*.json"))) == 4
    with pytest.raises(ValueError):
        runner.submit("nope")
    job = runner.submit("ppm", {"depth": 8})
    seen = [0.0]
    while not runner.futures[job].done():
        seen.append(runner.progress(job))
        time.sleep(0.1)
    assert seen == sorted(seen) and 0 < seen[-1] <= 1 and runner.progress(job) == 1
    job = runner.submit("ppm", {"depth": 8})
    runner.cancel(job)
    assert runner.wait(job).status in (Status.CANCELED, Status.COMPLETED)


def test_cli(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "CONFIG", Config(corpora=str(tmp_path / "corpora"), results=str(tmp_path / "results"), block_size=100, resamples=5))
    source = tmp_path / "mine.txt"
    source.write_text("Hello world, this is a test. " * 60)
    run = lambda *a: cli.main([*a, "--lang", "en", "--corpus", "text8"], spark)
    assert run("prep", "--corpus-path", str(source)) == 0
    card = json.loads((tmp_path / "corpora/en/2025-10-01/processed/text8_datacard.json").read_text())
    assert card["char_count"] == 29 * 60 and card["raw_sha256"].startswith("sha256:")
    assert run("estimate", "--model", "unigram", "--bootstrap") == 0
    assert run("estimate", "--model", "ngram", "--order", "3") == 0
    assert run("estimate", "--model", "ppm", "--order", "3", "--verify-codelength", "--sensitivity") == 0
    folder = tmp_path / "results/entropy/en/text8/2025-10-01"
    ppm = json.loads((folder / "ppm_order3.json").read_text())
    assert ppm["codelength_verification"]["matches"] and ppm["sensitivity"]["variants"][0]["name"] == "no_space" and ppm["escape_method"] == "A"
    assert json.loads((folder / "unigram_order1.json").read_text())["bootstrap"]["n_resamples"] == 5
    assert (folder / "unigram_order1_bootstrap.csv").exists() and (folder / "ppm_order3_sensitivity.md").exists()
    back = PPM.load(spark, str(tmp_path / "results/models/en/text8/2025-10-01/ppm_order3"))
    assert back.order == 3
    assert run("huffman", "--compare") == 0
    assert "PPM (depth=3)" in capsys.readouterr().out
    assert run("huffman", "--compare", "--compare-format", "csv") == 0 and (folder / "comparison.csv").exists()
    monkeypatch.setattr("surprisal.plans.report.get_config", lambda: cli.CONFIG)
    assert cli.main(["report", "--lang", "en", "--out", str(tmp_path / "paper"), "--format", "html"], spark) == 0
    assert "PPM" in (tmp_path / "paper/report_en.md").read_text()
    assert cli.main(["report", "--out", str(tmp_path / "all"), "--latex-style", "acm"], spark) == 0  # Romanian has no results
    tex, bib = (tmp_path / "all/report_en.tex").read_text(), (tmp_path / "all/references.bib").read_text()
    assert tex.startswith("\\documentclass[sigconf") and "no\\_space" in tex and "{shannon1951," in bib
    assert all(f"{{{key}," in bib for key in re.findall(r"\\cite\{(\w+)\}", tex))
    assert cli.main(["report", "--lang", "ro", "--out", str(tmp_path / "none")], spark) == 1
    assert run("estimate", "--model", "unigram", "--test-split", "1.5", "--force") == 1
    assert cli.main(["prep", "--lang", "en", "--corpus", "nope"], spark) == 1


def test_report_tools(tmp_path, monkeypatch):
    """Tools stand in as scripts that log their calls; without them, and where they fail, there is no file."""
    tex, page = tmp_path / "r.tex", tmp_path / "r.md"
    tex.write_text(""), page.write_text("")
    monkeypatch.setenv("PATH", str(tmp_path / "bin"))
    assert report.compile_pdf(tex) is None and report.build_site(page, tmp_path / "site") is None
    (tmp_path / "bin").mkdir()

    def tool(name, does=""):
        (tmp_path / "bin" / name).write_text(f"#!/bin/sh\nPATH={os.defpath}\necho {name} >> {tmp_path}/log\n{does}\n")
        (tmp_path / "bin" / name).chmod(0o755)

    tool("pdflatex", "touch r.pdf"), tool("bibtex")
    assert report.compile_pdf(tex) == tmp_path / "r.pdf"
    assert (tmp_path / "log").read_text().split() == ["pdflatex", "bibtex", "pdflatex", "pdflatex"]
    tool("quarto", 'touch "$6/r.html"'), tool("jupyter-book", 'mkdir -p "$4/_build/_page/r/html"; touch "$4/_build/_page/r/html/r.html"')
    assert report.build_site(page, tmp_path / "site") == tmp_path / "site/r.html"
    assert report.build_site(page, tmp_path / "book", "jupyter-book").exists()
    tool("quarto", "exit 1")
    assert report.build_site(page, tmp_path / "site2") is None
    with pytest.raises(ValueError):
        report.build_site(page, tmp_path, "nope")


def test_streaming(spark, tmp_path):
    texts = ["abra", "cadabra", "é b"]
    for i, t in enumerate(texts):
        spark.createDataFrame([(i, t, "en", "s", len(t))], "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streaming.read_documents(spark, str(tmp_path / "in"))
    q = streaming.running_counts(stream).writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    table = spark.createDataFrame([(t,) for t in texts], "text string").select(ENGLISH.column("text").alias("text"))
    assert sorted(map(tuple, spark.table("running").collect())) == sorted(map(tuple, char_counts(table).collect()))
    streaming.accumulate_contexts(stream, str(tmp_path / "out"), str(tmp_path / "c2"), 2).awaitTermination(60)
    assert sorted(map(tuple, streaming.accumulated(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, context_counts(table, 2).collect()))
