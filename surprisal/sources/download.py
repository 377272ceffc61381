"""Downloads on the driver, resumed and checked by digest; digests of files and texts."""

from __future__ import annotations

import hashlib
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK, TRIES = 1 << 20, 3


def sha256_text(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def sha256_file(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def digest_key(*parts: object) -> str:
    """One digest of several parts, each followed by a bar."""
    return sha256_text("".join(f"{p}|" for p in parts))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, size, sha256 of files in any file system Spark knows."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def download(url: str, to: str | Path, sha256: str | None = None, force: bool = False, opener: Callable = urllib.request.urlopen, wait: float = 1.0) -> Path:
    """Fetch url into a file, going on where an earlier try broke off; a wrong digest removes it and raises."""
    to = Path(to)
    side, part = to.with_name(to.name + ".sha256"), to.with_name(to.name + ".part")
    if to.exists() and not force:
        known = side.read_text().split()[0] if side.exists() else sha256_file(to)
        if sha256 in (None, known):
            side.write_text(known)
            return to
    to.parent.mkdir(parents=True, exist_ok=True)
    if force:
        part.unlink(missing_ok=True)
    for attempt in range(TRIES):
        try:
            have = part.stat().st_size if part.exists() else 0
            request = urllib.request.Request(url, headers={"Range": f"bytes={have}-"} if have else {})
            with opener(request, timeout=60) as answer:
                starts = (answer.headers.get("Content-Range") or "").removeprefix("bytes ").partition("-")[0]
                resumed = have and answer.status == 206 and starts == str(have)
                with part.open("ab" if resumed else "wb") as f:
                    while block := answer.read(CHUNK):
                        f.write(block)
            break
        except urllib.error.HTTPError:
            raise
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            if attempt == TRIES - 1:
                raise
            time.sleep(wait * 2**attempt)
    found = sha256_file(part)
    if sha256 not in (None, found):
        part.unlink()
        raise ValueError(f"{url} has digest {found}, not {sha256}")
    part.replace(to)
    side.write_text(found)
    return to
