"""Counts of symbols, and of contexts with the symbol that follows.

A context count is one pass: every position gives its longest context and its symbol, and equal ones
are added up in the task, with array operations, and after the shuffle. Counts by groups cut texts into
short pieces that carry the last characters of the piece before. Shorter contexts come from the distinct
rows, not from positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from surprisal.operators.codes import char_batches, gram_batches
from surprisal.operators.segments import pieces

#: Characters of a piece: substrings are found by counting from its start.
PIECE = 24


def char_counts(segments: DataFrame, by: list[str] | None = None, text: str = "text") -> DataFrame:
    """by, ch, cnt."""
    by = by or []
    return _task_chars(segments.select(*by, F.col(text).alias("text")), by).groupBy(*by, "ch").agg(F.sum("cnt").alias("cnt"))


def _task_chars(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, ch, cnt of each row of by and text; without by, of each task."""
    kind = StructType([*(rows.schema[k] for k in by), StructField("ch", StringType()), StructField("cnt", LongType())])
    return rows.mapInArrow(lambda batches: char_batches(batches, by), kind)


def counts_and_places(segments: DataFrame, seg_id: str = "seg_id", text: str = "text") -> list[tuple[str, int]]:
    """Each character and its count, in order of first occurrence: one pass over all text, and one over the segments of first occurrences.

    The driver gets a row for each character of the text."""
    seen = _task_chars(segments.select(F.col(seg_id).alias("seg"), F.col(text).alias("text")), ["seg"])
    rows = seen.groupBy("ch").agg(F.sum("cnt").alias("cnt"), F.min("seg").alias("seg")).collect()
    some = segments.where(F.col(seg_id).isin(sorted({r["seg"] for r in rows if r["seg"] is not None}))) if rows else segments.where("false")
    first = some.select(F.col(seg_id).alias("seg"), F.posexplode(F.array_distinct(F.split(text, ""))).alias("at", "ch")).where("ch <> ''")
    places = {(r["seg"], r["ch"]): r["at"] for r in first.groupBy("seg", "ch").agg(F.min("at").alias("at")).collect()}
    order = sorted(rows, key=lambda r: (r["seg"] is not None, r["seg"] or 0, places.get((r["seg"], r["ch"]), 0), r["ch"]))
    return [(r["ch"], r["cnt"]) for r in order]


def _windows(text: Column, depth: int, left: Column) -> Column:
    """array<struct<left, piece>>: pieces with up to depth characters before each; left stands before the first."""
    if depth == 0:
        return F.transform(pieces(text, PIECE), lambda p: F.struct(F.lit("").alias("left"), p.alias("piece")))
    size = max(PIECE, depth)
    all_pieces = pieces(text, size)
    return F.zip_with(
        all_pieces,
        F.concat(F.array(left), F.transform(all_pieces, lambda p: F.substring(p, -depth, depth))),
        lambda p, left: F.struct(F.coalesce(left, F.lit("")).alias("left"), p.alias("piece")),
    )


def task_counts(rows: DataFrame, depth: int, chunk: int = 0, pad: int = 0, mark: str = "\x01") -> DataFrame:
    """gram, cnt over rows of text and off, the characters of a text that only stand before others; with chunk, over its chunks with pad marks on either side."""
    return rows.mapInArrow(lambda batches: gram_batches(batches, depth, chunk, pad, ord(mark)), "gram string, cnt bigint").groupBy("gram").agg(F.sum("cnt").alias("cnt"))


def gram_counts(segments: DataFrame, depth: int, by: list[str] | None = None, text: str = "text", left: str | None = None) -> DataFrame:
    """by, gram, cnt: each character with up to depth characters before it within its text; before the first ones stands the column left."""
    by = by or []
    if not by:
        before = F.coalesce(F.col(left), F.lit("")) if left else F.lit("")
        return task_counts(segments.select(F.concat(before, text).alias("text"), F.length(before).alias("off")), depth)
    parts = segments.select(*by, F.explode(_windows(F.col(text), depth, F.col(left) if left else F.lit(""))).alias("w")).where("w.piece IS NOT NULL")
    # Positions are exploded as numbers, so that cutting and counting grams stays in generated code.
    placed = parts.select(*by, F.concat("w.left", "w.piece").alias("all"), F.length("w.left").alias("off"))
    each = placed.select(*by, "all", F.explode(F.sequence(F.col("off") + 1, F.length("all"))).alias("i"))
    gram = F.col("all").substr(F.greatest(F.col("i") - depth, F.lit(1)), F.least(F.lit(depth + 1), F.col("i")))
    return each.select(*by, gram.alias("gram")).groupBy(*by, "gram").agg(F.count("*").alias("cnt"))


def context_counts(segments: DataFrame, depth: int, by: list[str] | None = None, text: str = "text", left: str | None = None) -> DataFrame:
    """by, ctx, sym, cnt for the longest contexts."""
    by = by or []
    counted = gram_counts(segments, depth, by, text, left)
    return counted.select(*by, F.expr("substring(gram, 1, length(gram) - 1)").alias("ctx"), F.expr("right(gram, 1)").alias("sym"), "cnt")


def with_levels(pairs: DataFrame, ctx: str = "ctx") -> DataFrame:
    """pairs repeated for each suffix of the context: k, its length, and level, the suffix itself."""
    suffix = F.when(F.col("k") > 0, F.expr(f"right({ctx}, k)")).otherwise("")
    return pairs.withColumn("k", F.explode(F.sequence(F.lit(0), F.length(ctx)))).withColumn("level", suffix)


def symbol_tables(counts: DataFrame) -> DataFrame:
    """ctx, k, sym, cnt for contexts of every length, from counts of the longest."""
    return with_levels(counts).groupBy(F.col("level").alias("ctx"), "k", "sym").agg(F.sum("cnt").alias("cnt"))


def context_tables(symbols: DataFrame) -> DataFrame:
    """ctx, k, n (occurrences), u (distinct symbols), syms (count of each symbol, as many as the alphabet has)."""
    syms = F.map_from_entries(F.collect_list(F.struct("sym", "cnt")))
    return symbols.groupBy("ctx", "k").agg(F.sum("cnt").alias("n"), F.count("*").alias("u"), syms.alias("syms"))
