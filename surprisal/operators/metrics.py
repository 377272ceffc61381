"""Derived figures: per-segment means, comparisons of results, gains, best models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surprisal.functions.text import compression_ratio, redundancy
from surprisal.models.base import Model


def segment_entropies(segments: DataFrame, model: Model, by: str = "seg_id") -> DataFrame:
    """by, chars, bpc of each segment with text. Costs leave out those without; a condition here would be pushed down, and the text made once more for each of its uses."""
    return model.costs(segments, [by]).select(by, F.col("events").alias("chars"), (F.col("bits") / F.col("events")).alias("bpc"))


def segment_means(entropies: DataFrame) -> DataFrame:
    """unweighted_mean_bpc, weighted_mean_bpc, segments."""
    return entropies.agg(F.avg("bpc").alias("unweighted_mean_bpc"), (F.sum(F.col("bpc") * F.col("chars")) / F.sum("chars")).alias("weighted_mean_bpc"), F.count("*").alias("segments"))


def _column(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def normalized_results(results: DataFrame) -> DataFrame:
    """model, order, bits_per_char, log2_alphabet_size, redundancy, compression_ratio of raw result rows; impossible rows go."""
    name = F.coalesce(*(F.nullif(_column(results, c, "string"), F.lit("")) for c in ("model_choice", "model_type")), F.lit("?"))
    order = F.coalesce(*(F.nullif(_column(results, c, "int"), F.lit(0)) for c in ("order", "depth")), F.lit(0))
    h, top = F.coalesce(_column(results, "bits_per_char", "double"), F.lit(0.0)), F.coalesce(_column(results, "log2_alphabet_size", "double"), F.lit(0.0))
    out = results.select(name.alias("model"), order.alias("order"), h.alias("bits_per_char"), top.alias("log2_alphabet_size"), redundancy(h, top).alias("redundancy"), compression_ratio(h, top).alias("compression_ratio"), *([F.col("file_name")] if "file_name" in results.columns else []))
    return out.where("bits_per_char > 0 AND log2_alphabet_size > 0")


def by_entropy(results: DataFrame) -> DataFrame:
    """Highest entropy first."""
    return results.orderBy(F.desc("bits_per_char"), *(["file_name"] if "file_name" in results.columns else ["model", "order"]))


def find_result(results: DataFrame, model: str, order: int | None = None) -> DataFrame:
    """The first raw result row, by file name where there is one, of a model's name in any case and, if given, an order; no row if none."""
    name = F.coalesce(*(F.nullif(_column(results, c, "string"), F.lit("")) for c in ("model_choice", "model_type", "model")), F.lit(""))
    number = F.coalesce(*(F.nullif(_column(results, c, "int"), F.lit(0)) for c in ("order", "depth")), F.lit(0))
    found = results.where((F.lower(name) == model.lower()) & (F.lit(True) if order is None else number == order))
    return (found.orderBy("file_name") if "file_name" in results.columns else found).limit(1)


def redundancy_gains(results: DataFrame) -> DataFrame:
    """The best redundancy of each family, and what each next family gains; an absent family counts 0."""
    best = lambda cond: F.coalesce(F.max(F.when(cond, F.col("redundancy"))), F.lit(0.0))
    m = F.lower("model")
    families = results.agg(best(m.startswith("huffman")).alias("huffman_redundancy"), best(m.startswith("ngram")).alias("ngram_redundancy"), best(m == "ppm").alias("ppm_redundancy"))
    h, n, p = (F.col(f"{f}_redundancy") for f in ("huffman", "ngram", "ppm"))
    return families.select("*", (n - h).alias("huffman_to_ngram_gain"), (p - h).alias("huffman_to_ppm_gain"), (p - n).alias("ngram_to_ppm_gain"))


def best_per_family(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Of each model, the row of least entropy; of equal ones the larger order."""
    first = F.row_number().over(Window.partitionBy(*(by or ["model"])).orderBy("bits_per_char", F.desc("order")))
    return results.withColumn("__rank", first).where("__rank = 1").drop("__rank")
