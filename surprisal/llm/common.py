"""Plumbing shared by the training-data operators.

Conventions of every operator in this subpackage:

* a null text counts as the empty text unless the operator says otherwise;
* repeated rows stay repeated rows, each with its own result;
* only the columns named by the operator are read, so extra columns never clash;
* an empty table gives an empty result with the same schema;
* scratch tables lie below the shared folder, in a folder of the application. What later plans do not
  read is deleted as soon as may be; what a returned DataFrame reads stays until `discard(spark)`.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surprisal.session import ship

#: Rows and bytes an Arrow batch may hold: whole texts may be long, so batches are bounded by both.
ARROW_ROWS, ARROW_BYTES = 2000, "4m"


#: Scratch paths made and not yet deleted, in order.
MADE: list[str] = []


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches, so that a batch of long texts fits a Python worker; let workers find this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, a local master gets one below its warehouse; a cluster is refused."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/surprisal-checkpoints").rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, with the scheme of its file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/surprisal/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}")
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    whole = whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole
    MADE.append(whole)
    return whole


def materialize(df: DataFrame, label: str, partitions_by: list[str] | None = None) -> DataFrame:
    """Cut the lineage with a written table in the shared folder; survives the loss of any executor."""
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    writer = df.write
    if partitions_by:
        writer = writer.partitionBy(*partitions_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, since: int = 0, keep: tuple[DataFrame, ...] = ()) -> None:
    """Delete the scratch paths made since then, but for those that keep reads, through Hadoop's file system layer."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    read = [f for df in keep for f in df.inputFiles()]
    for path in MADE[since:]:
        if not any(f.removeprefix("file://").startswith(path.removeprefix("file://")) for f in read):
            p = hadoop.Path(path)
            p.getFileSystem(conf).delete(p, True)
            MADE.remove(path)


def crc_mod(column: Column, divisor: int) -> Column:
    """crc32 of the value written as text, modulo divisor; null behaves as the empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def hash_order(column: Column) -> Column:
    """A reproducible pseudo-random order of rows."""
    return F.xxhash64(column, F.lit("sample"))


def map_batches(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> DataFrame:
    """mapInArrow with a function of one batch; empty batches are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A text column as Python strings, nulls empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


#: Bytes of text in a range of rows, about, and ids sampled for each range's bounds.
RANGE_BYTES, SAMPLED = 24 << 20, 32


def range_bounds(df: DataFrame, column: str, text: str) -> list[int]:
    """Ascending bounds that deal a bigint column without nulls into ranges of about RANGE_BYTES of text; as many as it takes.

    The driver holds SAMPLED ids a range, that is 11 bytes for each megabyte of text."""
    rows, size = df.agg(F.count("*"), F.sum(F.octet_length(text))).first()
    ranges = -(-(size or 0) // RANGE_BYTES)
    if ranges < 2:
        return []
    found = df.select(column).sample(min(1.0, SAMPLED * ranges / rows), 20).toArrow().column(0).to_numpy()
    found = np.sort(found)
    return np.unique(found[np.linspace(0, len(found), ranges + 1)[1:-1].astype(int)]).tolist() if len(found) else []


def with_range(df: DataFrame, column: str, bounds: list[int], name: str) -> DataFrame:
    """df with the number of bounds at or below the column's value, by two short scans of a table that is no part of the plan's text."""
    if not bounds:
        return df.withColumn(name, F.lit(0))
    step = math.isqrt(len(bounds)) + 1
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    schema = pa.schema([("heads", pa.list_(pa.int64())), ("parts", pa.list_(pa.list_(pa.int64())))])
    held = df.sparkSession.createDataFrame(pa.table({"heads": [[p[-1] for p in parts if len(p) == step]], "parts": [[*parts, []]]}, schema))
    below = lambda xs: F.size(F.filter(xs, lambda b: b <= F.col(column)))
    both = df.withColumns({"__heads": held.select("heads").scalar(), "__parts": held.select("parts").scalar()})
    over = both.withColumn("__over", below(F.col("__heads")))
    return over.withColumn(name, F.col("__over") * step + below(F.element_at("__parts", F.col("__over") + 1))).drop("__heads", "__parts", "__over")
