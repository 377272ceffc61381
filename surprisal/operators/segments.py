"""Segments of a corpus: rows of seg_id and text. Splits, spans, chunks and blocks of them."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surprisal.alphabet import Alphabet


def check_split(share: float) -> None:
    if not 0 < share < 1:
        raise ValueError("the test share must lie between 0 and 1")


def train_test(segments: DataFrame, share: float = 0.2, text: str = "text") -> DataFrame:
    """segments with train and test: each text's first and last part, train having floor(length * (1 - share)) characters."""
    check_split(share)
    at = F.floor(F.length(text) * F.lit(1 - share)).cast("int")
    t = F.col(text)
    return segments.withColumns({"train": t.substr(F.lit(1), at), "test": t.substr(at + 1, F.length(text))})


def from_spans(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """seg_id, text of the spans (seg_id, start, end) of each text (joined on corpus); spans outside of it are left out."""
    found = texts.join(spans, "corpus").where("start >= 0 AND start < end AND end <= length(text)")
    return found.select("corpus", "seg_id", F.col("text").substr(F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int")).alias("text"))


def pieces(text: Column, size: int) -> Column:
    """A text's successive pieces of size characters, the last one shorter; in one pass over the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def chunks(segments: DataFrame, size: int, text: str = "text", name: str = "chunk") -> DataFrame:
    """A row for each piece of each text; name_id counts from 0 within the segment."""
    others = [c for c in segments.columns if c != text]
    return segments.select(*others, F.posexplode(pieces(F.col(text), size)).alias(f"{name}_id", text))


def blocks(segments: DataFrame, size: int = 2000, text: str = "text") -> DataFrame:
    """The blocks that a bootstrap draws from."""
    if size <= 0:
        raise ValueError("blocks need a size above 0")
    return chunks(segments, size, text, "block")


#: Rows of a stretch of segments that one task puts in order; stretches are as many as it takes.
STRETCH_ROWS = 1_000_000


def stretches(rows: DataFrame, key: str = "seg_id") -> DataFrame:
    """rows with stretch: ascending ranges of key of about STRETCH_ROWS rows each."""
    parts = -(-rows.count() // STRETCH_ROWS)
    bounds = sorted(set(rows.approxQuantile(key, [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    above = F.size(F.filter(F.array(*(F.lit(b) for b in bounds)), lambda b: F.col(key) >= b)) if bounds else F.lit(0)
    return rows.withColumn("stretch", above)


def _held(sizes: DataFrame) -> DataFrame:
    """A short row for each segment, made once: the steps that put them in order would each go over all text again. Those of n 0 are left out."""
    return sizes.localCheckpoint().where("n > 0")


def offsets(segments: DataFrame, text: str = "text") -> DataFrame:
    """seg_id, start: the characters of all segments before, in order of seg_id (unique); empty segments are left out.

    Running sums go by stretches, whose totals (a row each) are added up on the driver."""
    rows = stretches(_held(segments.select("seg_id", F.length(text).alias("n"))))
    totals = sorted(map(tuple, rows.groupBy("stretch").agg(F.sum("n")).collect()))
    base = dict(zip((k for k, _ in totals), accumulate((n for _, n in totals), initial=0), strict=False))
    bases = rows.sparkSession.createDataFrame(list(base.items()), "stretch int, base bigint")
    own = F.sum("n").over(Window.partitionBy("stretch").orderBy("seg_id").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("own", F.coalesce(own, F.lit(0))).join(F.broadcast(bases), "stretch").select("seg_id", (F.col("base") + F.col("own")).alias("start"))


def carried(segments: DataFrame, depth: int, text: str = "text") -> DataFrame:
    """segments with left: the last depth characters of all segments before, in order of seg_id (unique); empty segments are left out.

    Only the last characters of segments are put in order, by stretches; the driver gets depth short strings of each stretch."""
    rows = stretches(_held(segments.select("seg_id", F.length(text).alias("n"), F.right(F.col(text), F.lit(depth)).alias("tail"))).select("seg_id", "tail"))
    order = Window.partitionBy("stretch").orderBy("seg_id")
    own = F.array_join(F.collect_list("tail").over(order.rowsBetween(-depth, -1)), "")
    last = rows.withColumn("back", F.row_number().over(Window.partitionBy("stretch").orderBy(F.desc("seg_id")))).where(F.col("back") <= depth)
    ends: dict[int, str] = {}
    for r in sorted(last.collect(), key=lambda r: (r["stretch"], -r["back"])):
        ends[r["stretch"]] = ends.get(r["stretch"], "") + r["tail"]
    numbers, held = sorted(ends), ""
    before = []
    for k in numbers:
        before.append((k, held))
        held = (held + ends[k])[-depth:]
    bases = rows.sparkSession.createDataFrame(before, "stretch int, base string")
    left = rows.withColumn("own", own).join(F.broadcast(bases), "stretch").select("seg_id", F.right(F.concat("base", "own"), F.lit(depth)).alias("left"))
    return segments.join(left, "seg_id")


def invalid(segments: DataFrame, alphabet: Alphabet, text: str = "text") -> DataFrame:
    """One row: characters in all, and those outside the alphabet."""
    return segments.agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("chars"), F.coalesce(F.sum(F.length(text) - alphabet.known_chars(F.col(text))), F.lit(0)).alias("outside"))


def validate(segments: DataFrame, alphabet: Alphabet, text: str = "text") -> None:
    """Raise where there is no text, or characters are outside the alphabet."""
    chars, outside = invalid(segments, alphabet, text).first()
    if not chars:
        raise ValueError("there is no text")
    if outside:
        odd = segments.select(F.explode(F.array_distinct(F.split(F.regexp_replace(text, "[" + alphabet.others[2:], ""), ""))).alias("c")).where("c <> ''").distinct().limit(10)
        raise ValueError(f"{outside} characters are outside {alphabet.name}, such as {sorted(r.c for r in odd.collect())}")
