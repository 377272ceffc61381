"""Column functions of the analyses, and their registration for SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from surprisal.alphabet import Alphabet, get_alphabet


def entropy_of_counts(count: str = "cnt") -> Column:
    """Aggregate: entropy in bits of a table of counts; 0 for an empty one."""
    c = F.col(count).cast("double")
    return F.coalesce(F.log2(F.sum(c)) - F.sum(c * F.log2(c)) / F.sum(c), F.lit(0.0))


def redundancy(bits: Column, log2_size: Column | float) -> Column:
    """1 - H / log2 M within 0 and 1; 0 where H is negative or beyond log2 M, or the alphabet has one symbol."""
    top = log2_size if isinstance(log2_size, Column) else F.lit(float(log2_size))
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - bits / top))
    return F.when((top <= 0) | (bits < 0) | (bits > top + 1e-9), F.lit(0.0)).otherwise(inside)


def redundancy_of(bits: float, log2_size: float) -> float:
    if log2_size <= 0 or bits < 0 or bits > log2_size + 1e-9:
        return 0.0
    return max(0.0, min(1.0, 1 - bits / log2_size))


def compression_ratio(bits: Column, log2_size: Column) -> Column:
    return F.when((bits > 0) & (log2_size > 0), log2_size / bits).otherwise(0.0)


def coverage(alphabet: Alphabet, text: str = "text") -> Column:
    """Aggregate: share of characters that are symbols; 1 for no characters at all."""
    t = F.col(text)
    return F.coalesce(F.sum(alphabet.known_chars(t)) / F.nullif(F.sum(F.length(t)), F.lit(0)), F.lit(1.0))


def max_entropy(size: int) -> float:
    return math.log2(size) if size > 0 else 0.0


def digest_key(*parts: Column) -> Column:
    """SHA-256 of parts, each followed by a bar."""
    return F.sha2(F.concat(*(x for p in parts for x in (p.cast("string"), F.lit("|")))), 256)


def register(spark: SparkSession) -> None:
    """SQL functions normalize_<alphabet>(text) as SQL, and normalize_text(text, alphabet) in Arrow batches."""
    import pandas as pd

    @F.pandas_udf("string")
    def normalize_text(texts: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else get_alphabet(n).normalize(t) for t, n in zip(texts, names, strict=True)])

    spark.udf.register("normalize_text", normalize_text)
