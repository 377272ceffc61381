"""Texts from files: seg_id, path, text, one row for each file or archive member.

Everything is read by Spark, so paths may be in any file system it knows. Plain and gzip files that are
UTF-8 come through the text reader; archives and doubtful bytes through the binary one, unpacked in
Arrow batches, a row a member.
"""

from __future__ import annotations

import bz2
import gzip
import io
import re
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OUT = "path string, member string, at int, text string"
ARROW_OUT = pa.schema([("path", pa.string()), ("member", pa.string()), ("at", pa.int32()), ("text", pa.string())])
#: Bytes that a file counts as, besides its own, where files are packed into tasks: small ones come by the hundred.
#: A task has so many bytes at most, or one file: they lie in memory together.
OPEN_COST, TASK_BYTES = 16 << 10, 32 << 20
#: Rows and characters of texts that go back to Spark at once.
BATCH_ROWS, BATCH_CHARS = 2000, 4 << 20


def decoded(raw: bytes, fallback: str | None = None) -> str:
    """UTF-8; bad bytes are dropped, or the whole is read in the fallback encoding."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode(fallback) if fallback else raw.decode("utf-8", "ignore")


def plain_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole files, invalid bytes dropped."""
    return _unpacked(spark, path, lambda name, raw: [("", decoded(raw))])


def readable_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as plain_text reads them; files that cannot be read, or vanish, are passed over."""
    return _unpacked(spark, path, lambda name, raw: [("", decoded(raw))], ignoreCorruptFiles=True, ignoreMissingFiles=True)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """One row a line: large files, compressed ones too, in as many tasks as they split into."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def gzip_text(spark: SparkSession, path: str) -> DataFrame:
    return _unpacked(spark, path, lambda name, raw: [("", decoded(gzip.decompress(raw)))])


def zip_text(spark: SparkSession, path: str) -> DataFrame:
    """Members in order of the archive; UTF-8, else Latin-1."""
    return _unpacked(spark, path, lambda name, raw: _zip_members(raw))


def _zip_members(raw: bytes) -> Iterator[tuple[str, str]]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for info in z.infolist():
            if not info.is_dir():
                yield info.filename, decoded(z.read(info), "latin-1")


def europarl(spark: SparkSession, path: str, lang: str = "ro", pair: str = "ro-en") -> DataFrame:
    """The archive's file of one language; raises where there is none."""

    def members(name: str, raw: bytes) -> Iterator[tuple[str, str]]:
        with tarfile.open(fileobj=io.BytesIO(raw)) as t:
            names = [m.name for m in t.getmembers() if m.isfile()]
            fit = [n for n in names if pair in n and (n.endswith(f".{lang}") or n.endswith(f"euro.{lang}"))]
            if not fit:
                raise FileNotFoundError(f"no {lang} text of {pair} among {', '.join(names)}")
            best = next((n for n in fit if n.rpartition("/")[2] == f"europarl-v7.{pair}.{lang}"), fit[0])
            yield best, decoded(t.extractfile(best).read())

    return _unpacked(spark, path, members)


def any_text(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: .gz, .bz2, .zip, .tar.gz, .tgz or plain; what cannot be read is an empty text."""

    def members(name: str, raw: bytes) -> Iterator[tuple[str, str]]:
        try:
            if name.endswith((".tar.gz", ".tgz")):
                with tarfile.open(fileobj=io.BytesIO(raw)) as t:
                    yield from [(m.name, decoded(t.extractfile(m).read())) for m in t if m.isfile()]
            elif name.endswith(".zip"):
                yield from list(_zip_members(raw))
            else:
                opened = gzip.decompress(raw) if name.endswith(".gz") else bz2.decompress(raw) if name.endswith(".bz2") else raw
                yield "", decoded(opened)
        except (OSError, EOFError, zipfile.BadZipFile, tarfile.TarError, zlib.error, ValueError):
            yield "", ""

    return _unpacked(spark, path, members)


def _files(spark: SparkSession, path: str, **options: bool) -> DataFrame:
    """path, content of whole files.

    Spark counts each file as spark.sql.files.openCostInBytes, 4 MB by default, when it packs them into tasks, so
    that a task has a handful of small ones. The relation is made in a session of its own where that is OPEN_COST
    at most, and a task's bytes TASK_BYTES; the plan goes on in the caller's."""
    session = spark._jsparkSession
    apart = SparkSession(spark.sparkContext, session.cloneSession())
    own, conf = apart._jsparkSession.sessionState().conf(), apart._jsparkSession.conf()
    for key, value in (("openCostInBytes", min(own.filesOpenCostInBytes(), OPEN_COST)), ("maxPartitionBytes", min(own.filesMaxPartitionBytes(), TASK_BYTES))):
        conf.set(f"spark.sql.files.{key}", str(value))
    plan = apart.read.options(**options).format("binaryFile").load(path)._jdf.queryExecution().analyzed()
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, plan), spark).select("path", "content")


def _unpacked(spark: SparkSession, path: str, members: Callable[[str, bytes], Iterable[tuple[str, str]]], **options: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str, int, str]] = []
        chars = 0

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), ARROW_OUT, strict=True)], schema=ARROW_OUT)

        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                name = path.as_py()
                for at, (member, text) in enumerate(members(name, content.as_py())):
                    held.append((name, member, at, text))
                    chars += len(text)
                    if chars >= BATCH_CHARS or len(held) >= BATCH_ROWS:
                        yield batch_of()
                        held, chars = [], 0
        if held:
            yield batch_of()

    return _files(spark, path, **options).mapInArrow(run, OUT)


def joined(texts: DataFrame, by: str = "\n") -> DataFrame:
    """Members of each file as one text, in order."""
    parts = F.array_sort(F.collect_list(F.struct("at", "text")))
    return texts.groupBy("path").agg(F.array_join(F.transform(parts, lambda p: p["text"]), by).alias("text"))


def tagged_words(spark: SparkSession, path: str) -> DataFrame:
    """Files of word/tag tokens (as the Brown corpus comes), words joined by blanks."""
    words = F.trim(F.regexp_replace("text", r"\s+", " "))
    return plain_text(spark, path).withColumn("text", F.regexp_replace(words, r"/[^/ ]*+(?= |\z)", ""))


def json_lines(spark: SparkSession, path: str, field: str = "text") -> DataFrame:
    """One row a JSON line with a text; lines that are no JSON are dropped."""
    return spark.read.schema(f"`{field}` string, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path).where(f"_bad IS NULL AND `{field}` IS NOT NULL").select(F.col(field).alias("text"))


#: Wiki markup that goes, in order, with what takes its place.
WIKI = [
    (r"(?s)<!--.*?-->", ""),
    (r"(?s)<ref[^>/]*/>|<ref[^>]*>.*?</ref>", ""),
    (r"(?s)<(math|gallery|timeline|code|pre)[^>]*>.*?</\1>", ""),
    (r"\{\{[^{}]*\}\}", ""),
    (r"\{\{[^{}]*\}\}", ""),
    (r"\{\{[^{}]*\}\}", ""),
    (r"(?s)\{\|.*?\|\}", ""),
    (r"\[\[(?:[Ff]ile|[Ii]mage|[Cc]ategory|Fișier|Imagine|Categorie):[^\]]*\]\]", ""),
    (r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", "$1"),
    (r"\[https?://[^ \]]*\s?([^\]]*)\]", "$1"),
    (r"'{2,}", ""),
    (r"(?m)^=+\s*(.*?)\s*=+$", "$1"),
    (r"(?m)^[*#:;]+\s*", ""),
    (r"<[^>]+>", ""),
]


PAGE = "title string, ns int, redirect struct<_title: string>, revision struct<text: struct<_VALUE: string>>"


def wikipedia(spark: SparkSession, path: str) -> DataFrame:
    """title, text of the articles of an XML dump, compressed or not, markup stripped by built-in functions.

    The text reader cuts the dump where pages end, so that a file is read in as many tasks as it splits into; a row tag would have one task read it whole."""
    ends = spark.read.option("lineSep", "</page>").text(path)
    begun = ends.where(F.col("value").rlike(r"<page[\s>]"))
    page = F.from_xml(F.concat(F.regexp_extract("value", r"(?s)<page[\s>].*", 0), F.lit("</page>")), PAGE)
    # Generated, for conditions on columns would be pushed down and parse each page again.
    pages = begun.select(F.inline(F.array(page)))
    text = F.col("revision.text._VALUE")
    for pattern, to in WIKI:
        text = F.regexp_replace(text, pattern, to)
    return pages.where("coalesce(ns, 0) = 0 AND redirect IS NULL").select("title", F.trim(text).alias("text"))


EXTRACTORS: dict[str, Callable[..., DataFrame]] = {
    "PlainTextExtractor": plain_text,
    "WikipediaExtractor": wikipedia,
    "NLTKBrownExtractor": tagged_words,
    "NLTKGutenbergExtractor": readable_text,
    "ZipTextExtractor": zip_text,
    "GzipTextExtractor": gzip_text,
    "EuroparlExtractor": europarl,
    "OSCARExtractor": json_lines,
}


def get_extractor(name: str) -> Callable[..., DataFrame]:
    if name not in EXTRACTORS:
        raise ValueError(f"unknown extractor {name!r}; there are {', '.join(EXTRACTORS)}")
    return EXTRACTORS[name]
