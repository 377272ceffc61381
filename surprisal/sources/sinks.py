"""Texts to files, written by the executors through the file system of the folder's URI.

Plain, gzip and bz2 files hold a text each; zip and tar.gz archives up to ARCHIVE_BYTES of texts, a member
each; JSON lines are Spark's own. Names of archives come from their first member, so that a repeated attempt
writes the same files.
"""

from __future__ import annotations

import bz2
import gzip
import io
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

ARCHIVE_BYTES = 8 << 20
FORMS = ("plain", "readable", "gzip", "bz2", "zip", "tgz", "jsonl")


def _zip(members: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, raw in members:
            z.writestr(zipfile.ZipInfo(name), raw, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _tgz(members: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", mtime=0) as z, tarfile.open(fileobj=z, mode="w") as t:
        for name, raw in members:
            info = tarfile.TarInfo(name)
            info.size = len(raw)
            t.addfile(info, io.BytesIO(raw))
    return out.getvalue()


def _bz2(raw: bytes) -> bytes:
    """In blocks as large as the text needs: a larger one has the same content, and costs the time to clear its memory."""
    return bz2.compress(raw, max(1, min(9, -(-len(raw) // 90_000))))


def write_texts(texts: DataFrame, folder: str, form: str) -> None:
    """texts: name (unique, fit for a file) and text; a null text is an empty one. Readers pass over files of no bytes, so plain empty texts do not come back."""
    if form not in FORMS:
        raise ValueError(f"forms are {', '.join(FORMS)}")
    if form == "jsonl":
        texts.selectExpr("name", "coalesce(text, '') AS text").write.json(folder)
        return
    pack = {"zip": _zip, "tgz": _tgz}.get(form)
    wrap = {"gzip": lambda raw: gzip.compress(raw, mtime=0), "bz2": _bz2}.get(form, lambda raw: raw)
    suffix = {"plain": "", "readable": "", "gzip": ".gz", "bz2": ".bz2", "zip": ".zip", "tgz": ".tgz"}[form]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = fs.FileSystem.from_uri(folder)
        system.create_dir(place, recursive=True)

        def put(name: str, raw: bytes) -> int:
            with system.open_output_stream(f"{place}/{name}{suffix}", compression=None) as f:
                f.write(raw)
            return 1

        held: list[tuple[str, bytes]] = []
        size = files = 0
        for batch in batches:
            for name, text in zip(batch.column("name"), batch.column("text"), strict=True):
                name, raw = name.as_py(), (text.as_py() or "").encode()
                if not pack:
                    files += put(name, wrap(raw))
                    continue
                held.append((name, raw))
                size += len(raw)
                if size >= ARCHIVE_BYTES:
                    files += put(held[0][0], pack(held))
                    held, size = [], 0
        if held:
            files += put(held[0][0], pack(held))
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    texts.select("name", "text").mapInArrow(run, "files bigint").collect()
