"""The registered queries of the analyses, each with SQL of the same meaning where SQL can say it.

All run over whole tables. A float is rounded to six places on both sides, since sums come in any order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surprisal.alphabet import ENGLISH, ENGLISH_NO_SPACE, ROMANIAN_32, Alphabet
from surprisal.functions.text import coverage, entropy_of_counts, redundancy
from surprisal.models import PPM, Huffman, KneserNey, Unigram
from surprisal.models.kneser_ney import grams
from surprisal.models.ppm import context_edges, top_contexts
from surprisal.models.unigram import smoothed_costs
from surprisal.operators import coding, metrics, segments, validation
from surprisal.operators.counts import char_counts, context_counts, context_tables, symbol_tables
from surprisal.operators.segments import train_test
from surprisal.plans import tables
from surprisal.session import scratch
from surprisal.sources.results import card_measures, load_results
from surprisal.sources.sinks import write_texts
from surprisal.sources.text import any_text, gzip_text, json_lines, plain_text, readable_text, tagged_words, wikipedia, zip_text

PUNCTUATED = ENGLISH.variant(include_punctuation=True)
RESAMPLES = 1000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column) -> Column:
    return F.round(c, 6)


def normalized(spark: SparkSession, sf_dir: str, alphabet: Alphabet = ENGLISH, extra: tuple[str, ...] = ()) -> DataFrame:
    """seg_id, text of all documents on an alphabet."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("seg_id"), *extra, alphabet.column(F.col("text")).alias("text"))


def halves(spark: SparkSession, sf_dir: str, alphabet: Alphabet = ENGLISH) -> tuple[DataFrame, DataFrame]:
    """Train and test segments of all documents, 80 to 20."""
    split = train_test(normalized(spark, sf_dir, alphabet))
    return split.select("seg_id", F.col("train").alias("text")), split.select("seg_id", F.col("test").alias("text"))


# Normalising and projecting


def _normalize(alphabet: Alphabet) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: read(spark, d, "documents").select("doc_id", alphabet.column(F.col("text")).alias("norm"))


def alphabet_coverage_raw(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").groupBy("lang").agg(r6(coverage(ENGLISH)).alias("coverage"))


def to_indices(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of each text, and the sum of their places weighted by 1 to 1000 over and over."""

    @F.arrow_udf("n long, checksum long")
    def weighed(texts: pa.Array) -> pa.Array:
        flat, at = ENGLISH.places(texts)
        size = np.diff(at)
        sums = np.concatenate([[0], np.cumsum(flat * ((np.arange(len(flat)) - np.repeat(at[:-1], size)) % 1000 + 1), dtype=np.int64)])
        return pa.StructArray.from_arrays([pa.array(size, pa.int64()), pa.array(sums[at[1:]] - sums[at[:-1]], pa.int64())], names=["n", "checksum"], mask=texts.is_null())

    out = read(spark, d, "documents").select("doc_id", weighed(ENGLISH.column(F.col("text"))).alias("x"))
    return out.select("doc_id", "x.n", F.coalesce("x.checksum", F.lit(0).cast("long")).alias("checksum"))


def document_digests(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.sha2(ENGLISH.column(F.col("text")), 256).alias("sha256"))


def train_test_split(spark: SparkSession, d: str) -> DataFrame:
    split = train_test(normalized(spark, d))
    return split.select(F.col("seg_id").alias("doc_id"), F.length("train").alias("n_train"), F.length("test").alias("n_test"), F.md5("train").alias("train_md5"), F.md5("test").alias("test_md5"))


# Symbols


def char_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return char_counts(normalized(spark, d)).orderBy(F.desc("cnt"), "ch")


def char_frequencies_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return char_counts(normalized(spark, d, extra=("lang",)), ["lang"])


def _entropy(counts: DataFrame, by: str) -> DataFrame:
    out = counts.groupBy(by).agg(F.sum("cnt").alias("n_chars"), entropy_of_counts().alias("h"))
    return out.select(by, "n_chars", r6(F.col("h")).alias("entropy"), r6(redundancy(F.col("h"), ENGLISH.log2_size)).alias("redundancy"))


def unigram_entropy_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return _entropy(char_counts(normalized(spark, d, extra=("lang",)), ["lang"]), "lang")


def unigram_entropy_by_source(spark: SparkSession, d: str) -> DataFrame:
    return _entropy(char_counts(normalized(spark, d, extra=("source",)), ["source"]), "source")


def unigram_cross_entropy(spark: SparkSession, d: str) -> DataFrame:
    """A model for each language, fit on the first part of its documents and tested on the rest."""
    split = train_test(normalized(spark, d, extra=("lang",)))
    train, test = (char_counts(split.select("lang", F.col(c).alias("text")), ["lang"]) for c in ("train", "test"))
    costs = smoothed_costs(train, test, ENGLISH.size, 1.0, ["lang"], ["lang"])
    return costs.select("lang", F.col("events").alias("test_chars"), r6(F.col("bits") / F.col("events")).alias("bpc"))


def per_segment_cross_entropy(spark: SparkSession, d: str) -> DataFrame:
    train, test = halves(spark, d)
    return metrics.segment_entropies(test, Unigram(ENGLISH).fit(train)).select(F.col("seg_id").alias("doc_id"), "chars", r6(F.col("bpc")).alias("bpc"))


def per_segment_means(spark: SparkSession, d: str) -> DataFrame:
    train, test = halves(spark, d)
    out = metrics.segment_means(metrics.segment_entropies(test, Unigram(ENGLISH).fit(train)))
    return out.select(r6(F.col("unweighted_mean_bpc")).alias("unweighted_mean_bpc"), r6(F.col("weighted_mean_bpc")).alias("weighted_mean_bpc"), "segments")


def huffman_code_lengths(spark: SparkSession, d: str) -> DataFrame:
    return Huffman(ENGLISH).fit(normalized(spark, d)).tables["codes"].orderBy("code_len", "ch")


def _score(name: str, order: int, costs: DataFrame) -> DataFrame:
    return costs.select(F.lit(name).alias("model"), F.lit(order).alias("order"), F.col("events"), r6(F.col("bits") / F.col("events")).alias("bpc"))


def huffman_cross_entropy(spark: SparkSession, d: str) -> DataFrame:
    train, test = halves(spark, d)
    return _score("huffman", 1, Huffman(ENGLISH).fit(train).costs(test))


# Grams and contexts


def _trigrams(spark: SparkSession, d: str) -> DataFrame:
    """The condition names the count, lest it be pushed below the aggregation, where every position would cut its gram twice."""
    return grams(normalized(spark, d), 3).where("CASE WHEN cnt > 0 THEN length(gram) = 3 END")


def ngram_counts_k3(spark: SparkSession, d: str) -> DataFrame:
    return _trigrams(spark, d)


def continuation_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many distinct characters come before each bigram."""
    return _trigrams(spark, d).groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("lefts"))


def _kneser_ney(order: int) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        train, test = halves(spark, d)
        return _score("ngram-kn", order, KneserNey(ENGLISH, order).fit(train).costs(test))

    return query


def _contexts(spark: SparkSession, d: str, depth: int = 3) -> DataFrame:
    return context_tables(symbol_tables(context_counts(normalized(spark, d), depth)))


def ppm_context_stats(spark: SparkSession, d: str) -> DataFrame:
    return _contexts(spark, d).groupBy("k").agg(F.count("*").alias("contexts"), F.sum("n").alias("total"), F.sum("u").alias("symbols"))


def ppm_top_contexts(spark: SparkSession, d: str) -> DataFrame:
    return top_contexts(_contexts(spark, d), 100)


def ppm_context_edges(spark: SparkSession, d: str) -> DataFrame:
    return context_edges(top_contexts(_contexts(spark, d), 100))


def _ppm(depth: int) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        train, test = halves(spark, d)
        return _score("ppm", depth, PPM(ENGLISH, depth).fit(train).costs(test))

    return query


def ppm_cross_entropy_concat_d3(spark: SparkSession, d: str) -> DataFrame:
    """Contexts run across documents in order of doc_id, as if each half were one text."""
    train, test = halves(spark, d)
    return _score("ppm", 3, PPM(ENGLISH, 3, boundary="concat").fit(train).costs(test))


def ppm_self_entropy_d2(spark: SparkSession, d: str) -> DataFrame:
    """Fit and tested on the same text, as the jobs do."""
    rows = normalized(spark, d)
    return _score("ppm", 2, PPM(ENGLISH, 2).fit(rows).costs(rows))


def ppm_update_exclusion_d2(spark: SparkSession, d: str) -> DataFrame:
    """A model of the German documents on all others: symbols that it has not seen cost less under exclusion."""
    rows = normalized(spark, d, extra=("lang",))
    german, others = (rows.where(c).select("seg_id", "text") for c in ("lang = 'de'", "lang <> 'de'"))
    return _score("ppm", 2, PPM(ENGLISH, 2, update_exclusion=True).fit(german.withColumn("text", F.translate("text", "qxz", "   "))).costs(others))


def kn_top_o3(spark: SparkSession, d: str) -> DataFrame:
    """Averaged over grams of full length only."""
    train, test = halves(spark, d)
    return _score("ngram-kn", 3, KneserNey(ENGLISH, 3, mode="top").fit(train).costs(test))


def kn_cross_entropy_concat_o2(spark: SparkSession, d: str) -> DataFrame:
    """Chunks run across documents in order of doc_id."""
    train, test = halves(spark, d)
    return _score("ngram-kn", 2, KneserNey(ENGLISH, 2, boundary="concat").fit(train).costs(test))


def huffman_metadata(spark: SparkSession, d: str) -> DataFrame:
    v = Huffman(ENGLISH).fit(normalized(spark, d)).values
    return spark.createDataFrame([(round(v["avg_code_length"], 6), v["max_code_length"], v["unique_chars"])], "avg_code_length double, max_code_length int, unique_chars int")


def coder_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Bits and payload bytes of the test halves under a unigram model, and under PPM."""
    train, test = halves(spark, d)
    rows = []
    for model in (Unigram(ENGLISH).fit(train), PPM(ENGLISH, 2).fit(train)):
        payload, bits = coding.ArithmeticCoder().encode_with_model(test, model)
        rows.append((model.kind, round(bits, 2), len(payload)))
    return spark.createDataFrame(rows, "model string, bits double, payload_bytes bigint")


def validate_alphabet(spark: SparkSession, d: str) -> DataFrame:
    """Characters of the raw texts, and those outside the alphabet."""
    return segments.invalid(read(spark, d, "documents"), ENGLISH)


def span_segments(spark: SparkSession, d: str) -> DataFrame:
    """Each document cut by a card's spans: two that fit, one that ends beyond the text, one that is empty."""
    texts = normalized(spark, d).select(F.col("seg_id").alias("corpus"), "text")
    n, half = F.length("text").cast("long"), F.floor(F.length("text") / 2)
    span = lambda i, a, b: F.struct(F.lit(i).cast("long").alias("seg_id"), a.cast("long").alias("start"), b.cast("long").alias("end"))
    spans = texts.select("corpus", F.explode(F.array(span(0, F.lit(0), half), span(1, half, n), span(2, half, n + 1), span(3, half, half))).alias("s")).select("corpus", "s.*")
    return segments.from_spans(texts, spans).select(F.col("corpus").alias("doc_id"), "seg_id", F.length("text").alias("n"), F.md5("text").alias("md5"))


def chunk_table(spark: SparkSession, d: str) -> DataFrame:
    cut = segments.chunks(normalized(spark, d), 1000)
    return cut.select(F.col("seg_id").alias("doc_id"), "chunk_id", F.length("text").alias("n"), F.md5("text").alias("md5"))


def indices_round_trip(spark: SparkSession, d: str) -> DataFrame:
    back = ENGLISH.symbols_column(ENGLISH.index_column(F.col("text")))
    return read(spark, d, "documents").select("doc_id", F.md5(back).alias("md5"))


def segment_bootstrap_means(spark: SparkSession, d: str) -> DataFrame:
    """A bootstrap of each source's blocks in one pass."""
    split = train_test(normalized(spark, d, extra=("source",)))
    train = split.select("seg_id", F.col("train").alias("text"))
    test = split.select("source", "seg_id", F.col("test").alias("text"))
    costs = validation.block_costs(test, Unigram(ENGLISH).fit(train), by=["source"])
    found = validation.poisson_bootstrap(costs, 100, by=["source"])
    return found.select("source", *(r6(F.col(c)).alias(c) for c in found.columns[1:]))


def comparison_lines(spark: SparkSession, d: str) -> DataFrame:
    """The comparison as the lines of its CSV file."""
    rows = [r.asDict() for r in metrics.by_entropy(metrics.normalized_results(model_scores(spark, d))).collect()]
    return spark.createDataFrame(list(enumerate(tables.comparison(rows, "csv").split("\n"))), "line bigint, text string")


# Files: texts are written to the shared folder in some form and read back


def _stored(form: str, reader: Callable[..., DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        folder = scratch(spark, form)
        write_texts(read(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".ro")).alias("name"), "text"), folder, form)
        found = reader(spark, folder)
        return found.select(F.length("text").alias("n"), F.md5("text").alias("md5"))

    return query


def source_tagged(spark: SparkSession, d: str) -> DataFrame:
    """Every word of the texts gets a tag, and loses it when read."""
    folder = scratch(spark, "tagged")
    write_texts(read(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".pos")).alias("name"), F.regexp_replace("text", r"([^\s]+)", "$1/nn").alias("text")), folder, "plain")
    return tagged_words(spark, folder).select(F.length("text").alias("n"), F.md5("text").alias("md5"))


def source_wikipedia(spark: SparkSession, d: str) -> DataFrame:
    """A dump of an article for each document, in markup, with a talk page and a redirect beside it."""
    folder = scratch(spark, "dump")
    marked = F.concat(F.lit("== Heading ==\n'''"), F.coalesce("text", F.lit("")), F.lit("''' [[File:x.png|thumb]] {{cite|{{a}}}} [[Link|shown]]<ref>note</ref>"))
    revision = F.struct(F.struct(marked.alias("_VALUE")).alias("text"))
    page = normalized(spark, d).select(F.col("seg_id").cast("string").alias("title"), revision.alias("revision"))
    kinds = F.array(*(F.struct(F.lit(ns).alias("ns"), F.lit(to).cast("string").alias("to")) for ns, to in ((0, None), (1, None), (0, "elsewhere"))))
    pages = page.withColumn("kind", F.explode(kinds)).select("title", "kind.ns", F.when(F.col("kind.to").isNotNull(), F.struct(F.col("kind.to").alias("_title"))).alias("redirect"), "revision")
    pages.write.format("xml").option("rootTag", "mediawiki").option("rowTag", "page").save(folder)
    return wikipedia(spark, folder).select(F.col("title").cast("long").alias("doc_id"), F.md5("text").alias("md5"))


def results_scan(spark: SparkSession, d: str) -> DataFrame:
    """The comparison read from files of results, beside which a broken file and a comparison lie."""
    folder = scratch(spark, "results")
    name = F.concat("model_choice", F.lit("_order"), F.col("order").cast("string"), F.lit(".json"))
    others = spark.createDataFrame([("broken.json", "{\"order\": "), ("comparison.json", "{\"order\": 1}")], "name string, text string")
    write_texts(model_scores(spark, d).select(name.alias("name"), F.to_json(F.struct("*")).alias("text")).union(others), folder, "plain")
    out = metrics.normalized_results(load_results(spark, folder))
    return out.select("file_name", "model", "order", *(r6(F.col(c)).alias(c) for c in ("bits_per_char", "redundancy")))


def saved_ppm_d3(spark: SparkSession, d: str) -> DataFrame:
    """A model is saved, and the one loaded scores the test halves."""
    train, test = halves(spark, d)
    folder = scratch(spark, "model")
    PPM(ENGLISH, 3).fit(train).save(folder)
    return _score("ppm", 3, PPM.load(spark, folder).costs(test))


def ppm_per_segment_d3(spark: SparkSession, d: str) -> DataFrame:
    train, test = halves(spark, d)
    return metrics.segment_entropies(test, PPM(ENGLISH, 3).fit(train)).select(F.col("seg_id").alias("doc_id"), "chars", r6(F.col("bpc")).alias("bpc"))


def ppm_codelength_verify(spark: SparkSession, d: str) -> DataFrame:
    train, test = halves(spark, d)
    model = PPM(ENGLISH, 2).fit(train).cached()
    v = coding.verify_codelength(test, model)
    model.released()
    return spark.createDataFrame([(round(v["cross_entropy_bpc"], 6), round(v["codelength_bpc"], 6), v["matches"])], "cross_entropy_bpc double, codelength_bpc double, matches boolean")


# Comparison, bootstrap, ablations


def model_scores(spark: SparkSession, d: str) -> DataFrame:
    """model_choice, order, bits_per_char, log2_alphabet_size of several models over the same split."""
    train, test = halves(spark, d)
    train, test = train.persist(), test.persist()
    try:
        deep = PPM(ENGLISH, 3).fit(train).cached()
        fit = [("unigram", Unigram(ENGLISH).fit(train)), ("huffman", Huffman(ENGLISH).fit(train)), ("ngram-kn", KneserNey(ENGLISH, 2).fit(train)), ("ngram-kn", KneserNey(ENGLISH, 3).fit(train)), ("ppm", deep.shallower(2)), ("ppm", deep)]
        rows = [(name, model.order, model.evaluate(test), ENGLISH.log2_size) for name, model in fit]
    finally:
        deep.released()
        train.unpersist(), test.unpersist()
    return spark.createDataFrame(rows, "model_choice string, order int, bits_per_char double, log2_alphabet_size double")


def redundancy_comparison(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.by_entropy(metrics.normalized_results(model_scores(spark, d)))
    return out.select("model", "order", *(r6(F.col(c)).alias(c) for c in ("bits_per_char", "log2_alphabet_size", "redundancy", "compression_ratio")))


def redundancy_gains(spark: SparkSession, d: str) -> DataFrame:
    gains = metrics.redundancy_gains(metrics.normalized_results(model_scores(spark, d)))
    return gains.select(*(r6(F.col(c)).alias(c) for c in gains.columns))


def best_model_per_family(spark: SparkSession, d: str) -> DataFrame:
    found = metrics.normalized_results(model_scores(spark, d)).where("model <> 'huffman'")
    return metrics.best_per_family(found).select("model", "order", r6(F.col("bits_per_char")).alias("bits_per_char"))


def block_costs(spark: SparkSession, d: str) -> DataFrame:
    train, test = halves(spark, d)
    costs = validation.block_costs(test, Unigram(ENGLISH).fit(train))
    return costs.select(F.col("seg_id").alias("doc_id"), "block_id", "events", r6(F.col("bits")).alias("bits"))


def bootstrap_unigram_ci(spark: SparkSession, d: str) -> DataFrame:
    train, test = halves(spark, d)
    b = validation.block_bootstrap(test, Unigram(ENGLISH).fit(train), n_resamples=RESAMPLES)
    ci = validation.bootstrap_redundancy(bits_per_char=b["mean_bpc"], log2_alphabet_size=ENGLISH.log2_size, bootstrap_results=b)
    row = [round(b[k], 6) for k in ("mean_bpc", "std_bpc", "ci_lower_bpc", "ci_upper_bpc")] + [round(ci[k], 6) for k in ("redundancy", "ci_lower_redundancy", "ci_upper_redundancy")]
    return spark.createDataFrame([tuple(row)], "mean_bpc double, std_bpc double, ci_lower_bpc double, ci_upper_bpc double, redundancy double, ci_lower_redundancy double, ci_upper_redundancy double")


def bootstrap_poisson_ci(spark: SparkSession, d: str) -> DataFrame:
    train, test = halves(spark, d)
    found = validation.poisson_bootstrap(validation.block_costs(test, Unigram(ENGLISH).fit(train)), RESAMPLES)
    return found.select(*(r6(F.col(c)).alias(c) for c in found.columns))


def sensitivity_unigram(spark: SparkSession, d: str) -> DataFrame:
    split = train_test(read(spark, d, "documents").select(F.col("doc_id").alias("seg_id"), F.coalesce("text", F.lit("")).alias("text")))
    train, test = (split.select("seg_id", F.col(c).alias("text")) for c in ("train", "test"))
    found = validation.ablation_study(model=Unigram, base=ENGLISH, train=train, test=test, ablations=["no_space", "with_punctuation"])
    rows = [("baseline", found["baseline"]["alphabet_size"], found["baseline"]["bits_per_char"], 0.0)] + [(v["name"], v["alphabet_size"], v["bits_per_char"], v["delta_bpc"]) for v in found["variants"]]
    return spark.createDataFrame([(a, b, round(h, 6), round(x, 6)) for a, b, h, x in rows], "variant string, alphabet_size int, bits_per_char double, delta_bpc double")


def corpus_datacard(spark: SparkSession, d: str) -> DataFrame:
    m = card_measures(read(spark, d, "documents").select("text"), ENGLISH)
    return m.select("raw_size_bytes", "processed_size_bytes", "char_count", F.array_join("unique_chars", "").alias("unique_chars"), r6(F.col("alphabet_coverage")).alias("alphabet_coverage"), r6(F.col("raw_coverage")).alias("raw_coverage"))


# Other tables


def entropy_by_label(spark: SparkSession, d: str) -> DataFrame:
    labelled = normalized(spark, d).join(read(spark, d, "labels").select(F.col("doc_id").alias("seg_id"), "quality"), "seg_id")
    return _entropy(char_counts(labelled, ["quality"]), "quality")


def conversation_entropy_by_role(spark: SparkSession, d: str) -> DataFrame:
    said = read(spark, d, "conversations").select("role", ENGLISH.column(F.col("text")).alias("text"))
    return _entropy(char_counts(said, ["role"]), "role")


def event_type_entropy(spark: SparkSession, d: str) -> DataFrame:
    counts = read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("cnt"))
    return counts.agg(F.sum("cnt").alias("n"), F.count("*").alias("types"), r6(entropy_of_counts()).alias("entropy"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [alphabet_coverage_raw, to_indices, document_digests, train_test_split, char_frequencies, char_frequencies_by_lang, unigram_entropy_by_lang, unigram_entropy_by_source, unigram_cross_entropy, per_segment_cross_entropy, per_segment_means, huffman_code_lengths, huffman_cross_entropy, ngram_counts_k3, continuation_counts, ppm_context_stats, ppm_top_contexts, ppm_context_edges, ppm_per_segment_d3, ppm_cross_entropy_concat_d3, ppm_self_entropy_d2, ppm_update_exclusion_d2, kn_top_o3, kn_cross_entropy_concat_o2, huffman_metadata, coder_sizes, validate_alphabet, span_segments, chunk_table, indices_round_trip, segment_bootstrap_means, comparison_lines, source_tagged, source_wikipedia, results_scan, saved_ppm_d3, ppm_codelength_verify, redundancy_comparison, redundancy_gains, best_model_per_family, block_costs, bootstrap_unigram_ci, bootstrap_poisson_ci, sensitivity_unigram, corpus_datacard, entropy_by_label, conversation_entropy_by_role, event_type_entropy]
    stored = {"plain": plain_text, "readable": readable_text, "gzip": gzip_text, "zip": zip_text, "bz2": any_text, "tgz": any_text, "jsonl": json_lines}
    alphabets = {"en27": ENGLISH, "en26": ENGLISH_NO_SPACE, "ro32": ROMANIAN_32, "punct": PUNCTUATED}
    out = {f"normalize_{k}": _normalize(a) for k, a in alphabets.items()} | {f.__name__: f for f in named}
    out |= {f"source_{k}": _stored(k, r) for k, r in stored.items()}
    return out | {f"kn_cross_entropy_o{n}": _kneser_ney(n) for n in (2, 3, 5)} | {f"ppm_cross_entropy_d{n}": _ppm(n) for n in (3, 5)}
