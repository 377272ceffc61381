"""Interpolated Kneser-Ney n-grams over padded chunks, as joins.

Texts are cut into chunks of 1000 characters, each padded with n - 1 marks on either side. Marks and
characters that training has not seen are one and the same symbol. A gram's longest form ends at each
position of a padded chunk; shorter grams are its suffixes. With boundary "concat", chunks run across
segments in order of seg_id; with "segment" each segment has its own, which needs no global order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surprisal.models.base import Model
from surprisal.operators.counts import char_counts, gram_counts, task_counts
from surprisal.operators.segments import offsets, pieces

UNKNOWN = "\x01"


def concatenated(segments: DataFrame, size: int) -> DataFrame:
    """chunk_id, text of the chunks of all segments joined in order of seg_id. Offsets come from lengths alone."""
    placed = segments.join(offsets(segments), "seg_id")
    room = F.lit(size) - F.col("start") % size
    head = F.col("text").substr(F.lit(1), room.cast("int"))
    parts = F.concat(F.array(head), pieces(F.expr(f"substring(text, cast({size} - start % {size} as int) + 1)"), size))
    cut = placed.select("start", F.posexplode(parts).alias("i", "part")).where("part <> ''")
    numbered = cut.select((F.floor(F.col("start") / size) + F.col("i")).alias("chunk_id"), "start", "i", "part")
    whole = numbered.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("start", "i", "part"))).alias("parts"))
    return whole.select("chunk_id", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("text"))


def grams(segments: DataFrame, order: int, size: int = 1000, boundary: str = "segment", by: list[str] | None = None) -> DataFrame:
    """by, gram, cnt: at each position of the padded chunks, the longest gram that ends there."""
    by = by or []
    if boundary == "concat":
        chunked = concatenated(segments, size)
    elif boundary == "segment" and not by:
        chunked = segments
    elif boundary == "segment":
        chunked = segments.select(*by, F.explode(pieces(F.col("text"), size)).alias("text"))
    else:
        raise ValueError("the boundary is segment or concat")
    if not by:
        return task_counts(chunked.select("text", F.lit(0).alias("off")), order - 1, size, order - 1, UNKNOWN)
    pad = UNKNOWN * (order - 1)
    padded = chunked.withColumn("text", F.concat(F.lit(pad), "text", F.lit(pad)))
    return gram_counts(padded, order - 1, by)


def levels(longest: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, gram, k, cnt for grams of every length."""
    by = by or []
    each = longest.withColumn("k", F.explode(F.sequence(F.lit(1), F.length("gram"))))
    return each.groupBy(*by, F.expr("right(gram, k)").alias("gram"), "k").agg(F.sum("cnt").alias("cnt"))


def context_table(counts: DataFrame, order: int) -> DataFrame:
    """ctx, k, total, followers, syms: for contexts of grams of length k, what each symbol counts there.

    That is its count for full-length grams, and its number of distinct left neighbours for shorter ones.
    Each gram is counted for itself and as a left extension of its suffix in one aggregation.
    """
    own = F.struct("gram", "k", F.col("cnt").alias("seen"), F.lit(0).cast("long").alias("lefts"))
    suffix = F.struct(F.expr("substring(gram, 2)").alias("gram"), (F.col("k") - 1).alias("k"), F.lit(0).cast("long").alias("seen"), F.lit(1).cast("long").alias("lefts"))
    both = counts.select(F.explode(F.when(F.col("k") > 1, F.array(own, suffix)).otherwise(F.array(own))).alias("e")).select("e.*")
    words = both.groupBy("gram", "k").agg(F.sum("seen").alias("seen"), F.sum("lefts").alias("lefts")).where("seen > 0")
    x = F.when(F.col("k") == order, F.col("seen")).otherwise(F.col("lefts"))
    split = words.select(F.expr("substring(gram, 1, k - 1)").alias("ctx"), "k", F.expr("right(gram, 1)").alias("sym"), x.alias("x"))
    return split.groupBy("ctx", "k").agg(F.sum("x").alias("total"), F.count("*").alias("followers"), F.map_from_entries(F.collect_list(F.struct("sym", "x"))).alias("syms"))


def gram_costs(distinct: DataFrame, contexts: DataFrame, discount: float) -> DataFrame:
    """gram, m (where there) and bits of distinct grams."""
    kept = [c for c in ("m",) if c in distinct.columns]
    each = distinct.select("gram", *kept, F.explode(F.sequence(F.lit(1), F.length("gram"))).alias("k"))
    each = each.withColumn("ctx", F.expr("substring(gram, length(gram) - k + 1, k - 1)"))
    known = each.join(contexts, ["ctx", "k"])
    x, total = F.coalesce(F.col("syms")[F.expr("right(gram, 1)")], F.lit(0)), F.col("total")
    alpha = F.when(F.col("k") == 1, x / total).otherwise(F.greatest(x - discount, F.lit(0.0)) / total)
    gamma = F.when(F.col("k") == 1, F.lit(0.0)).otherwise(discount * F.col("followers") / total)
    # At most one step for each length up to the order.
    folded = F.aggregate(F.array_sort(F.collect_list(F.struct("k", alpha.alias("alpha"), gamma.alias("gamma")))), F.lit(0.0), lambda p, s: s["alpha"] + s["gamma"] * p)
    return known.groupBy("gram").agg(*(F.first(c).alias(c) for c in kept), folded.alias("p")).select("gram", *kept, (-F.log2(F.greatest("p", F.lit(1e-12)))).alias("bits"))


@dataclass
class KneserNey(Model):
    """mode everygram averages over grams of all lengths, marks included; mode top over those of full length only."""

    order: int = 5
    discount: float = 0.1
    chunk_size: int = 1000
    mode: str = "everygram"
    boundary: str = "segment"
    kind = "ngram"

    def __post_init__(self) -> None:
        for name in ("discount", "chunk_size", "mode", "boundary"):
            setattr(self, name, self.values.get(name, getattr(self, name)))
        if not 2 <= self.order <= 8:
            raise ValueError("the order must lie between 2 and 8")
        if self.mode not in ("everygram", "top"):
            raise ValueError("the mode is everygram or top")
        self.values |= {"discount": self.discount, "chunk_size": self.chunk_size, "mode": self.mode, "boundary": self.boundary}

    def fit(self, segments: DataFrame) -> KneserNey:
        counts = levels(grams(segments, self.order, self.chunk_size, self.boundary))
        # The vocabulary has no more symbols than the alphabet; taken apart, so that scoring plans need no result of this one.
        seen = char_counts(segments).select("ch").collect()
        known = "".join(sorted(r["ch"] for r in seen if r["ch"] != UNKNOWN))
        if not known:
            raise ValueError("there is no text")
        return KneserNey(self.alphabet, self.order, {"contexts": context_table(counts, self.order)}, self.values | {"known": known})

    def costs(self, segments: DataFrame, by: list[str] | None = None) -> DataFrame:
        self.need()
        by = by or []
        if by and self.boundary == "concat":
            raise ValueError("scores by group need boundary segment")
        unseen = "[^" + "".join(f"\\x{{{ord(c):x}}}" for c in self.values["known"]) + "]"
        masked = segments.withColumn("text", F.regexp_replace("text", unseen, UNKNOWN))
        counted = levels(grams(masked, self.order, self.chunk_size, self.boundary, by), by)
        if self.mode == "top":
            counted = counted.where(F.col("k") == self.order)
        counted = counted.withColumnRenamed("cnt", "m")
        scored = gram_costs(counted.select("gram").distinct() if by else counted, self.tables["contexts"], self.discount)
        if by:
            scored = counted.join(scored, "gram")
        return scored.groupBy(*by).agg(F.sum("m").alias("events"), F.sum(F.col("m") * F.col("bits")).alias("bits"))
