"""Result records and data cards as JSON, comparison files and bootstrap rows."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surprisal.alphabet import Alphabet
from surprisal.functions.text import coverage

RESULT = """model_choice string, model_type string, order int, depth int, language string, corpus string, snapshot string,
alphabet_name string, alphabet_size int, log2_alphabet_size double, bits_per_char double, train_chars bigint, test_chars bigint,
test_split double, seed int, timestamp string, corpus_hash string, escape_method string, escape_method_requested string, update_exclusion boolean,
per_corpus array<struct<source_id: bigint, chars: bigint, bits_per_char: double>>, per_corpus_unweighted_mean_bpc double, per_corpus_weighted_mean_bpc double,
codelength_verification struct<cross_entropy_bpc: double, codelength_bpc: double, delta_bpc: double, matches: boolean>,
bootstrap struct<mean_bpc: double, std_bpc: double, ci_lower_bpc: double, ci_upper_bpc: double, n_resamples: int, block_size: int, confidence_level: double, redundancy_ci: struct<redundancy: double, ci_lower_redundancy: double, ci_upper_redundancy: double>>,
sensitivity struct<baseline: struct<bits_per_char: double, redundancy: double>, variants: array<struct<name: string, alphabet_size: int, log2_alphabet_size: double, bits_per_char: double, redundancy: double, delta_bpc: double, delta_redundancy: double>>>"""
CARD = """corpus_name string, language string, source_url string, license string, description string, snapshot_date string, download_date string,
raw_size_bytes bigint, processed_size_bytes bigint, char_count bigint, unique_chars array<string>, alphabet_coverage double, raw_coverage double,
alphabet_name string, raw_sha256 string, preprocessing_hash string, format string, extractor string,
sources array<struct<start: bigint, end: bigint, span: array<bigint>, file: string, path: string>>"""
BOOTSTRAP = ["mean_bpc", "ci_lower_bpc", "ci_upper_bpc", "redundancy", "ci_lower_redundancy", "ci_upper_redundancy", "n_resamples", "block_size", "confidence_level"]


def load_results(spark: SparkSession, folder: str) -> DataFrame:
    """All result files of a folder with file_name; malformed ones and comparison files are left out."""
    rows = spark.read.schema(RESULT + ", _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").option("pathGlobFilter", "*.json").json(folder)
    named = rows.withColumn("file_name", F.col("_metadata.file_name"))
    return named.where("_bad IS NULL AND file_name <> 'comparison.json'").drop("_bad")


def save_json(record: dict[str, Any], path: str | Path) -> Path:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(record, indent=2, ensure_ascii=False), encoding="utf-8")
    return path


def save_text(text: str, path: str | Path) -> Path:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return path


def bootstrap_csv(result: dict[str, Any]) -> str:
    flat = result | result.get("redundancy_ci", {})
    form = lambda k: str(int(flat.get(k, 0))) if k in ("n_resamples", "block_size") else f"{flat.get(k, 0.0):.2f}" if k == "confidence_level" else f"{flat.get(k, float('nan')):.6f}"
    return ",".join(BOOTSTRAP) + "\n" + ",".join(map(form, BOOTSTRAP))


def card_measures(raw: DataFrame, alphabet: Alphabet) -> DataFrame:
    """One row: characters, symbols, coverage before and after normalising, sizes in bytes."""
    both = raw.select("text", alphabet.column(F.col("text")).alias("norm"))
    return both.agg(
        F.sum(F.octet_length("text")).alias("raw_size_bytes"),
        F.sum(F.octet_length("norm")).alias("processed_size_bytes"),
        F.sum(F.length("norm")).alias("char_count"),
        F.array(*(F.when(F.bool_or(F.contains("norm", F.lit(s))), F.lit(s)) for s in sorted(alphabet.symbols))).alias("unique_chars"),
        coverage(alphabet, "norm").alias("alphabet_coverage"),
        coverage(alphabet, "text").alias("raw_coverage"),
    ).withColumn("unique_chars", F.filter("unique_chars", lambda c: c.isNotNull()))


def make_card(raw: DataFrame, alphabet: Alphabet, **facts: Any) -> dict[str, Any]:
    """A data card of a corpus: what is measured, and what is told."""
    row = card_measures(raw, alphabet).first().asDict()
    told = {k: facts.get(k) for k in ("corpus_name", "language", "source_url", "license", "description", "snapshot_date", "raw_sha256", "preprocessing_hash", "format", "extractor")}
    return told | row | {"alphabet_name": alphabet.name, "download_date": facts.get("download_date") or datetime.now(UTC).isoformat()}


def load_card(path: str | Path) -> dict[str, Any]:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def load_cards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CARD).option("multiLine", True).json(path)
