"""Symbol and context counts of a growing corpus, with Structured Streaming.

Counts are sums, so each micro-batch is counted like a table and added to what is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from surprisal.alphabet import ENGLISH, Alphabet
from surprisal.operators.counts import char_counts, context_counts


def read_documents(spark: SparkSession, folder: str, schema: str = "doc_id bigint, text string, lang string, source string, n_chars bigint") -> DataFrame:
    """Parquet files as they arrive."""
    return spark.readStream.schema(schema).parquet(folder)


def running_counts(documents: DataFrame, alphabet: Alphabet = ENGLISH, by: list[str] | None = None) -> DataFrame:
    """by, ch, cnt of all documents so far: a stream for update or complete mode. Its state has a row for each symbol and group."""
    by = by or []
    return char_counts(documents.select(*by, alphabet.column(F.col("text")).alias("text")), by)


def windowed_counts(documents: DataFrame, time: str, window: str, late: str, alphabet: Alphabet = ENGLISH) -> DataFrame:
    """window, ch, cnt of timed documents; what comes later than the watermark is left out."""
    timed = documents.withWatermark(time, late).select(time, F.explode(F.split(alphabet.column(F.col("text")), "")).alias("ch")).where("ch <> ''")
    return timed.groupBy(F.window(time, window), "ch").agg(F.count("*").alias("cnt"))


def accumulate_contexts(documents: DataFrame, folder: str, checkpoint: str, depth: int = 3, alphabet: Alphabet = ENGLISH) -> StreamingQuery:
    """Write each micro-batch's context counts below folder, under its number, so that a repeated batch replaces itself."""

    def step(batch: DataFrame, number: int) -> None:
        segments = batch.select(alphabet.column(F.col("text")).alias("text"))
        context_counts(segments, depth).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return documents.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def accumulated(spark: SparkSession, folder: str) -> DataFrame:
    """ctx, sym, cnt of all batches."""
    return spark.read.parquet(folder).groupBy("ctx", "sym").agg(F.sum("cnt").alias("cnt"))
