"""The training-data pipeline: low quality out, near copies out, test passages out, personal data masked, tokens made.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows to the
shared folder and reads them back as the next stage's documents, so a lost executor never costs more
than one stage's work, and deletes what the stage before and its own scratch tables left.

Defined results: a null text counts as empty in every stage and stays null until it is encoded, as no
ids; empty and null texts are near copies of each other; a null doc_id stays where its group has no
other, and is never labelled; repeated rows are near copies; all columns of the documents, whatever
their names, pass through the stages but the last; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from surprisal.llm import bpe, decontam, pii, quality, resemblance
from surprisal.llm.common import MADE, discard, materialize, table
from surprisal.llm.queries import vocabulary

#: SQL cannot fit the classifier, hash shingles or merge byte pairs; tests hold the rows against brute force.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (4/5 of the five-word shingles shared) stays: the one with the smallest doc_id."""
    return resemblance.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; shorter passages of test items are cut from the others."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind in brackets."""
    return pii.redact(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, checked by decoding: doc_id, n_tokens, ids_sha256, decoded_sha256, ids."""
    return bpe.round_trip(docs, vocabulary(), keep_ids=True)


STAGES = [
    ("quality classifier", keep_quality),
    ("near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("PII", mask_personal_data),
    ("BPE encoding and decoding", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    begun = len(MADE)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0]}")
        discard(spark, begun, (docs,))
    return docs
