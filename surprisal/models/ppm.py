"""Prediction by partial matching, as joins.

The cost of a symbol after a context: contexts that training has not seen are passed over; each seen
context without the symbol, from the longest, costs its escape -log2(u / (n + u)); the longest one with
the symbol costs -log2(cnt / (n + u)) and ends it; a symbol that training has not seen costs log2 M at
last. A symbol that follows a context follows all its suffixes, so the escapes to pay are those of all
seen contexts without the symbol, whatever their order.

With boundary "concat" contexts run across segments in order of seg_id, as if all were one text; with
"segment" they begin anew with each, which needs no order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from surprisal.models.base import Model, require_text
from surprisal.operators.codes import Lookup
from surprisal.operators.counts import context_counts, context_tables, symbol_tables, with_levels
from surprisal.operators.segments import carried


#: Pairs of context and symbol whose costs are broadcast where they are asked for by groups (24 MB of numbers); more are joined.
LOOKED_UP_MOST = 1_000_000


def escape_probability(n: Column, u: Column) -> Column:
    """u / (n + u): what is called method A here, and C in the literature; 1 for an unseen context."""
    return F.coalesce(F.when(n > 0, u / (n + u)), F.lit(1.0))


def pair_costs(pairs: DataFrame, contexts: DataFrame, size: int, update_exclusion: bool = False) -> DataFrame:
    """ctx, sym, m (where pairs, which are distinct, have it) and bits. One join: a context's row holds its symbols' counts."""
    seen = contexts.select(F.col("ctx").alias("level"), "n", "u", "syms")
    kept = [c for c in ("m",) if c in pairs.columns]
    levels = with_levels(pairs.select("ctx", "sym", *kept)).join(seen, "level", "left").withColumn("cnt", F.col("syms")[F.col("sym")])
    n, u = F.col("n"), F.col("u")
    base = F.lit(float(size))
    if update_exclusion:
        excluded = F.coalesce(F.min_by(u, F.when((F.col("k") >= 1) & u.isNotNull(), F.col("k"))), F.lit(0))
        base = F.when(F.lit(size) - excluded > 0, F.lit(size) - excluded).otherwise(size).cast("double")
    escapes = F.sum(F.when(F.col("cnt").isNull() & n.isNotNull(), -F.log2(u / (n + u))).otherwise(0.0))
    hit = F.when(F.col("cnt").isNotNull(), F.col("k"))
    end = F.coalesce(F.max_by(-F.log2(F.col("cnt") / (n + u)), hit), F.log2(base))
    bits = F.least(escapes + end, F.lit(996.578428466209))  # a probability of 1e-300 at least
    return levels.groupBy("ctx", "sym").agg(*(F.first(c).alias(c) for c in kept), bits.alias("bits"))


def summed_costs(segments: DataFrame, lookup: Lookup, by: list[str]) -> DataFrame:
    """by, events, bits, where lookup has the bits of all grams of the segments."""
    rows = segments.select(*(F.col(k).alias(f"by_{i}") for i, k in enumerate(by)), "text")
    kind = StructType([*rows.schema.fields[:-1], StructField("events", LongType()), StructField("bits", DoubleType())])
    held = segments.sparkSession.sparkContext.broadcast(lookup)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for each in batches:
            events, bits = held.value.sums(each.column(each.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*each.columns[:-1], pa.array(events, pa.int64()), pa.array(bits)], names=kind.names).filter(pa.array(events > 0))

    sums = rows.mapInArrow(run, kind).groupBy(*(F.col(f"by_{i}").alias(k) for i, k in enumerate(by)))
    return sums.agg(F.sum("events").alias("events"), F.sum("bits").alias("bits"))


@dataclass
class PPM(Model):
    """depth is order; asked-for escape methods other than A fall back to it, and the wish is kept."""

    order: int = 8
    escape_method: str = "A"
    update_exclusion: bool = False
    boundary: str = "segment"
    kind = "ppm"

    def __post_init__(self) -> None:
        self.escape_method = self.values.get("escape_method_requested", self.escape_method)
        self.update_exclusion = self.values.get("update_exclusion", self.update_exclusion)
        if not 1 <= self.order <= 12:
            raise ValueError("the depth must lie between 1 and 12")
        if self.escape_method not in ("A", "B", "C", "D"):
            raise ValueError("escape methods are A, B, C and D")
        self.boundary = self.values.get("boundary", self.boundary)
        if self.boundary not in ("segment", "concat"):
            raise ValueError("the boundary is segment or concat")
        self.values |= {"boundary": self.boundary, "depth": self.order, "escape_method": "A", "escape_method_requested": self.escape_method, "update_exclusion": self.update_exclusion}

    def _with(self, tables: dict[str, DataFrame]) -> PPM:
        return PPM(self.alphabet, self.order, tables, dict(self.values))

    def across(self, boundary: str) -> PPM:
        """The same model with contexts that begin anew with each segment, or run across them."""
        return PPM(self.alphabet, self.order, self.tables, self.values | {"boundary": boundary})

    def shallower(self, depth: int) -> PPM:
        """The model of a smaller depth: its contexts are among this one's."""
        self.need()
        if depth > self.order:
            raise ValueError(f"the depth is {self.order}")
        return PPM(self.alphabet, depth, {"contexts": self.tables["contexts"].where(F.col("k") <= depth)}, {k: v for k, v in self.values.items() if k != "depth"})

    def counts(self, segments: DataFrame, by: list[str] | None = None) -> DataFrame:
        """by, ctx, sym, cnt; with boundary concat the first contexts of a segment are what stands before it."""
        if self.boundary == "segment":
            return context_counts(segments, self.order, by)
        if by:
            raise ValueError("scores by group need boundary segment")
        return context_counts(carried(segments, self.order), self.order, left="left")

    def fit(self, segments: DataFrame) -> PPM:
        require_text(segments)
        return self._with({"contexts": context_tables(symbol_tables(self.counts(segments)))})

    def symbols(self) -> DataFrame:
        """ctx, k, sym, cnt."""
        self.need()
        return self.tables["contexts"].select("ctx", "k", F.explode("syms").alias("sym", "cnt"))

    def merge(self, other: PPM) -> PPM:
        """The model of both trainings."""
        both = self.symbols().unionByName(other.symbols()).groupBy("ctx", "k", "sym").agg(F.sum("cnt").alias("cnt"))
        return self._with({"contexts": context_tables(both)})

    def context_tree_size(self) -> int:
        self.need()
        return self.tables["contexts"].count()

    def symbol_probability(self, symbol: str, context: str) -> float:
        self.need()
        pair = self.tables["contexts"].sparkSession.createDataFrame([(context[-self.order :], symbol)], "ctx string, sym string")
        return 2.0 ** -pair_costs(pair, self.tables["contexts"], self.alphabet.size, self.update_exclusion).first()["bits"]

    def costs(self, segments: DataFrame, by: list[str] | None = None) -> DataFrame:
        """Distinct pairs are scored once. By groups, few of them are broadcast, and each text adds up its characters' costs where it lies."""
        self.need()
        by = by or []
        if by and self.boundary == "segment" and self.alphabet.size ** (self.order + 1) <= LOOKED_UP_MOST:
            scored = pair_costs(self.counts(segments).select("ctx", "sym"), self.tables["contexts"], self.alphabet.size, self.update_exclusion)
            found = scored.select(F.concat("ctx", "sym").alias("gram"), "bits").limit(LOOKED_UP_MOST + 1).toArrow()
            symbols = len(set("".join(grams := found.column("gram").to_pylist())))
            if len(grams) <= LOOKED_UP_MOST and Lookup.fits(symbols, self.order):
                return summed_costs(segments, Lookup(grams, found.column("bits").to_numpy(), self.order), by)
        counted = self.counts(segments, by).withColumnRenamed("cnt", "m")
        pairs = counted.select("ctx", "sym").distinct() if by else counted
        scored = pair_costs(pairs, self.tables["contexts"], self.alphabet.size, self.update_exclusion)
        if by:
            scored = counted.join(scored, ["ctx", "sym"])
        return scored.groupBy(*by).agg(F.sum("m").alias("events"), F.sum(F.col("m") * F.col("bits")).alias("bits"))

    def top_contexts(self, most: int = 100) -> DataFrame:
        """ctx, k, n of the most frequent contexts but the empty one."""
        self.need()
        return top_contexts(self.tables["contexts"], most)


def top_contexts(contexts: DataFrame, most: int = 100) -> DataFrame:
    return contexts.where("k > 0").orderBy(F.desc("n"), "k", "ctx").limit(most).select("ctx", "k", "n")


def context_edges(top: DataFrame) -> DataFrame:
    """parent, child where a context and the same without its first character are both in top."""
    child = top.select(F.col("ctx").alias("child"), F.expr("substring(ctx, 2)").alias("parent")).where("parent <> ''")
    return child.join(F.broadcast(top.select(F.col("ctx").alias("parent"))), "parent").select("parent", "child")
