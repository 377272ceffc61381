"""python -m surprisal.cli prep | estimate | huffman | report"""

from __future__ import annotations

import argparse
import json
import sys
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surprisal.alphabet import BY_LANGUAGE, Alphabet
from surprisal.config import LANGUAGES, get_config
from surprisal.models import PPM, Huffman, KneserNey, Model, Unigram
from surprisal.operators import coding, metrics, validation
from surprisal.operators.segments import check_split, train_test
from surprisal.plans import tables
from surprisal.plans.report import generate_report
from surprisal.session import get_session
from surprisal.sources import download, registry, results
from surprisal.sources.text import get_extractor, joined, plain_text

CONFIG = get_config()


def home(lang: str, snapshot: str) -> Path:
    return Path(CONFIG.corpora) / lang / snapshot


def prep_one(spark: SparkSession, lang: str, name: str, snapshot: str, path: str | None, force: bool) -> Path:
    """Download (or take path), extract, normalise, and write the texts with their data card."""
    spec = registry.get_corpus(lang, name)
    base, url = home(lang, snapshot), spec.url
    if name == "wikipedia":
        snapshot, url = registry.wiki_url(lang, snapshot)
    raw = Path(path) if path else base / "raw" / name
    if not path and url:
        raw = download.download(url, raw / url.rpartition("/")[2], spec.sha256, force)
    # A file of one's own is plain text.
    found = (plain_text if path else get_extractor(spec.extractor))(spark, str(raw))
    alphabet = BY_LANGUAGE[lang]
    texts = (joined(found) if "at" in found.columns else found).select("text")
    target = base / "processed" / f"{name}.parquet"
    texts.select(F.monotonically_increasing_id().alias("seg_id"), "text", alphabet.column(F.col("text")).alias("norm")).write.mode("overwrite").parquet(str(target))
    kept = spark.read.parquet(str(target))
    card = results.make_card(kept.select("text"), alphabet, corpus_name=name, language=lang, source_url=url, license=spec.license, description=spec.description, snapshot_date=snapshot, raw_sha256=f"sha256:{download.sha256_file(raw)}" if raw.is_file() else None, preprocessing_hash="sha256:" + download.digest_key(alphabet.name, spec.extractor), format=spec.format, extractor=spec.extractor)
    return results.save_json(card, base / "processed" / f"{name}_datacard.json")


def prep(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.corpus_path and a.corpus == "all":
        raise SystemExit("--corpus-path goes with one corpus")
    names = [n for lang, n in registry.list_corpora(a.lang)] if a.corpus == "all" else [a.corpus]
    failed = 0
    for name in names:
        try:
            print(f"OK: {prep_one(spark, a.lang, name, a.snapshot, a.corpus_path, a.force)}")
        except Exception as e:  # the other corpora still run
            failed = 1
            print(f"ERROR: {a.lang}/{name}: {e}", file=sys.stderr)
    return failed


def load_corpus(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame, dict[str, Any], Alphabet]:
    """Normalised segments, raw segments, data card, alphabet."""
    base, alphabet = home(a.lang, a.snapshot) / "processed", BY_LANGUAGE[a.lang]
    card_path = base / f"{a.corpus}_datacard.json"
    card = results.load_card(card_path) if card_path.exists() else {}
    if card.get("alphabet_name", alphabet.name) != alphabet.name:
        raise ValueError(f"the card's alphabet is {card['alphabet_name']}, not {alphabet.name}")
    if (base / f"{a.corpus}.parquet").exists():
        stored = spark.read.parquet(str(base / f"{a.corpus}.parquet"))
        return stored.select("seg_id", F.col("norm").alias("text")), stored.select("seg_id", "text"), card, alphabet
    raw = plain_text(spark, str(base / f"{a.corpus}.txt")).select(F.lit(0).cast("long").alias("seg_id"), "text")
    spans = [(s.get("start", (s.get("span") or [None])[0]), s.get("end", (s.get("span") or [None, None])[-1])) for s in card.get("sources") or []]
    spans = [(i, s, e) for i, (s, e) in enumerate(spans) if isinstance(s, int) and isinstance(e, int) and 0 <= s < e]
    if spans:
        table = spark.createDataFrame(spans, "seg_id bigint, start bigint, end bigint")
        raw = raw.select("text").crossJoin(F.broadcast(table)).where("end <= length(text)").select("seg_id", F.expr("substring(text, cast(start + 1 as int), cast(end - start as int))").alias("text"))
    return raw.withColumn("text", alphabet.column(F.col("text"))), raw, card, alphabet


def make_model(a: argparse.Namespace, alphabet: Alphabet) -> Model:
    if a.model == "unigram":
        return Unigram(alphabet)
    if a.model == "ngram":
        return KneserNey(alphabet, a.order, boundary="concat")
    if a.order < 2:
        print("a depth below 2 is hardly a context", file=sys.stderr)
    return PPM(alphabet, a.order, escape_method=a.escape_method, update_exclusion=a.update_exclusion, boundary="concat")


def split_segments(segments: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    cut = train_test(segments, share)
    return cut.select("seg_id", F.col("train").alias("text")), cut.select("seg_id", F.col("test").alias("text"))


def result_path(a: argparse.Namespace, model: str, order: int) -> Path:
    return Path(a.output or CONFIG.results) / "entropy" / a.lang / a.corpus / a.snapshot / f"{model}_order{order}.json"


def base_record(a: argparse.Namespace, name: str, model: Model, h: float, train: DataFrame, test: DataFrame, card: dict[str, Any]) -> dict[str, Any]:
    chars = lambda df: df.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    return {"model_choice": name, "order": model.order, "language": a.lang, "corpus": a.corpus, "snapshot": a.snapshot, "log2_alphabet_size": model.alphabet.log2_size, "bits_per_char": h, "train_chars": chars(train), "test_chars": chars(test), "test_split": a.test_split, "seed": CONFIG.seed, "timestamp": datetime.now(UTC).isoformat(), "corpus_hash": card.get("preprocessing_hash"), **model.to_dict()}


def estimate(spark: SparkSession, a: argparse.Namespace) -> int:
    check_split(a.test_split)
    a.order = 1 if a.model == "unigram" else a.order
    out = result_path(a, a.model, a.order)
    if out.exists() and not a.force:
        print(out.read_text(encoding="utf-8"))
        return 0
    segments, raw, card, alphabet = load_corpus(spark, a)
    train, test = split_segments(segments.persist(), a.test_split)
    model = make_model(a, alphabet).fit(train).cached()
    h = model.evaluate(test)
    record = base_record(a, a.model, model, h, train, test, card)
    # Segments are scored for themselves, whatever the model runs across.
    single = model.across("segment") if a.model == "ppm" else KneserNey(alphabet, a.order, model.tables, model.values | {"boundary": "segment"}) if a.model == "ngram" else model
    if a.model != "ngram":
        per = metrics.segment_entropies(test, single).persist()
        if per.count() > 1:
            means = metrics.segment_means(per).first()
            rows = per.orderBy("seg_id").collect()
            record |= {"per_corpus": [{"source_id": i, "chars": r["chars"], "bits_per_char": r["bpc"]} for i, r in enumerate(rows)], "per_corpus_unweighted_mean_bpc": means["unweighted_mean_bpc"], "per_corpus_weighted_mean_bpc": means["weighted_mean_bpc"]}
    if a.verify_codelength and a.model == "ppm":
        record["codelength_verification"] = coding.verify_codelength(test, model)
    if a.bootstrap:
        try:
            b = validation.block_bootstrap(test, single, CONFIG.block_size, CONFIG.resamples, CONFIG.confidence, CONFIG.seed)
            record["bootstrap"] = b | {"redundancy_ci": validation.bootstrap_redundancy(bits_per_char=h, log2_alphabet_size=alphabet.log2_size, bootstrap_results=b)}
            if "per_corpus" in record:
                each = validation.segment_bootstrap(test, single, block_size=CONFIG.block_size, n_resamples=CONFIG.resamples, confidence_level=CONFIG.confidence, seed=CONFIG.seed)
                for item, seg in zip(record["per_corpus"], [r["seg_id"] for r in rows], strict=True):
                    if seg in each:
                        item["bootstrap"] = each[seg]
            results.save_text(results.bootstrap_csv(record["bootstrap"]), out.with_name(f"{a.model}_order{a.order}_bootstrap.csv"))
        except Exception as e:
            print(f"the bootstrap failed: {e}", file=sys.stderr)
    if a.sensitivity or a.ablations:
        try:
            names = a.ablations.split(",") if a.ablations else validation.DEFAULT_ABLATIONS[a.lang]
            raw_train, raw_test = split_segments(raw, a.test_split)
            found = validation.ablation_study(model=lambda x: make_model(a, x), base=alphabet, train=raw_train, test=raw_test, ablations=names)
            record["sensitivity"] = found
            for style, suffix in (("markdown", "md"), ("csv", "csv")):
                results.save_text(tables.sensitivity(found, style), out.with_name(f"{a.model}_order{a.order}_sensitivity.{suffix}"))
        except Exception as e:
            print(f"the ablations failed: {e}", file=sys.stderr)
    model.save(str(Path(a.output or CONFIG.results) / "models" / a.lang / a.corpus / a.snapshot / f"{a.model}_order{a.order}"))
    results.save_json(record, out)
    print(f"OK: {a.model} (order={a.order}) on {a.lang}/{a.corpus}: {h:.4f} bits/char")
    return 0


def huffman(spark: SparkSession, a: argparse.Namespace) -> int:
    check_split(a.test_split)
    out = result_path(a, "huffman", 1)
    if not out.exists() or a.force:
        segments, _, card, alphabet = load_corpus(spark, a)
        train, test = split_segments(segments, a.test_split)
        model = Huffman(alphabet).fit(train)
        h = model.evaluate(test)
        results.save_json(base_record(a, "huffman", model, h, train, test, card), out)
    print(f"OK: huffman on {a.lang}/{a.corpus}: {json.loads(out.read_text(encoding='utf-8'))['bits_per_char']:.4f} bits/char")
    if a.compare:
        found = metrics.normalized_results(results.load_results(spark, str(out.parent)))
        rows = [r.asDict() for r in metrics.by_entropy(found).drop("file_name").collect()]
        text = tables.comparison_json(rows, metrics.redundancy_gains(found).first().asDict(), a.lang, a.corpus, a.snapshot) if a.compare_format == "json" else tables.comparison(rows, a.compare_format)
        if a.compare_format in ("json", "csv"):
            print(results.save_text(text, out.with_name(f"comparison.{a.compare_format}")))
        else:
            print(text)
    return 0


def report(spark: SparkSession, a: argparse.Namespace) -> int:
    for kind, path in generate_report(spark, a.lang, a.corpus, a.snapshot, a.format, a.out, a.latex_style, figures_dir=a.figures_dir, site_tool=a.site_tool).items():
        print(f"{kind}: {path}")
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="surprisal")
    sub = top.add_subparsers(dest="command", required=True)
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--snapshot", default=CONFIG.snapshot)
    one = argparse.ArgumentParser(add_help=False, parents=[shared])
    one.add_argument("--lang", choices=LANGUAGES, required=True)
    one.add_argument("--corpus", required=True)
    one.add_argument("--force", action="store_true")
    p = sub.add_parser("prep", parents=[one])
    p.add_argument("--corpus-path")
    scored = argparse.ArgumentParser(add_help=False, parents=[one])
    scored.add_argument("--test-split", type=float, default=CONFIG.test_split)
    scored.add_argument("--output")
    p = sub.add_parser("estimate", parents=[scored])
    p.add_argument("--model", choices=["unigram", "ngram", "ppm"], required=True)
    p.add_argument("--order", type=int, default=CONFIG.ngram_order)
    p.add_argument("--escape-method", choices=list("ABCD"), default="A")
    for flag in ("--update-exclusion", "--verify-codelength", "--bootstrap", "--sensitivity"):
        p.add_argument(flag, action="store_true")
    p.add_argument("--ablations", default="")
    p = sub.add_parser("huffman", parents=[scored])
    p.add_argument("--compare", action="store_true")
    p.add_argument("--compare-format", choices=["table", "json", "csv", "markdown"], default="table")
    p = sub.add_parser("report", parents=[shared])
    p.add_argument("--lang", choices=[*LANGUAGES, "both"], default="both")
    p.add_argument("--corpus")
    p.add_argument("--format", choices=["pdf", "html", "both"], default="both")
    p.add_argument("--out", default="paper")
    p.add_argument("--figures-dir")
    p.add_argument("--site-tool", choices=["quarto", "jupyter-book"], default="quarto")
    p.add_argument("--latex-style", choices=["article", "acm", "arxiv"], default="article")
    return top


COMMANDS = {"prep": prep, "estimate": estimate, "huffman": huffman, "report": report}


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    try:
        return COMMANDS[a.command](spark or get_session(), a)
    except Exception as e:
        print(f"ERROR: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
