import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
DATA = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    at = tmp_path_factory.mktemp("spark")
    made = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(at / "warehouse"))
        .config("spark.checkpoint.dir", f"file://{at}/shared")
        .getOrCreate()
    )
    made.sparkContext.setLogLevel("ERROR")
    return made


@pytest.fixture
def docs(spark):
    """Documents with nulls, empty and long texts, repeated rows and a column whose name operators might use."""

    def make(texts, ids=None):
        from pyspark.sql import functions as F

        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)]
        frame = spark.createDataFrame(rows, DOCUMENTS)
        for clash in ("key", "ids", "bucket", "fp", "score", "th", "id", "root", "count", "pii", "__n"):
            frame = frame.withColumn(clash, F.lit("clash"))
        return frame.repartition(3)

    return make


ODD = [None, "", " ", "\n", "a", "A a a a", "word " * 3000, "x" * 20000, "é😀 ñ́", "same text here for all", "same text here for all", "<|endoftext|> a<|endoftext|>", "tab\tand\x0bmore\x1cthan\x85that　end  "]
