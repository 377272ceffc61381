"""Known corpora, and addresses of wiki dumps."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

DUMPS = "https://dumps.wikimedia.org"


@dataclass(frozen=True)
class CorpusSpec:
    lang: str
    name: str
    url: str | None
    format: str
    license: str
    description: str
    extractor: str
    sha256: str | None = None


#: Corpora with their public addresses (fixed values).
CORPORA = [
    CorpusSpec("en", "wikipedia", f"{DUMPS}/enwiki/latest/enwiki-latest-pages-articles.xml.bz2", "wikipedia_xml", "CC BY-SA 3.0", "All articles of the English Wikipedia", "WikipediaExtractor"),
    CorpusSpec("en", "brown", None, "nltk_brown", "Public Domain", "Tagged American English of 1961, without its tags", "NLTKBrownExtractor"),
    CorpusSpec("en", "gutenberg", None, "nltk_gutenberg", "Public Domain", "Some books out of copyright", "NLTKGutenbergExtractor"),
    CorpusSpec("en", "text8", "http://mattmahoney.net/dc/text8.zip", "text_zip", "Public Domain", "A hundred million letters and blanks of encyclopedia text", "ZipTextExtractor"),
    CorpusSpec("ro", "wikipedia", f"{DUMPS}/rowiki/latest/rowiki-latest-pages-articles.xml.bz2", "wikipedia_xml", "CC BY-SA 3.0", "All articles of the Romanian Wikipedia", "WikipediaExtractor"),
    CorpusSpec("ro", "opus", "https://object.pouta.csc.fi/OPUS-OpenSubtitles/v2024/mono/ro.txt.gz", "text_gzip", "CC0", "Lines of film subtitles in Romanian", "GzipTextExtractor"),
    CorpusSpec("ro", "europarl", "https://www.statmt.org/europarl/v7/ro-en.tgz", "parallel_corpus", "Public Domain", "Debates of the European Parliament, the Romanian half", "EuroparlExtractor"),
    CorpusSpec("ro", "oscar", None, "huggingface", "CC0", "Romanian web text; needs a login", "OSCARExtractor"),
]


def get_corpus(lang: str, name: str) -> CorpusSpec:
    for c in CORPORA:
        if (c.lang, c.name) == (lang, name):
            return c
    raise KeyError(f"no corpus {lang}/{name}; there are {', '.join(f'{c.lang}/{c.name}' for c in CORPORA)}")


def list_corpora(lang: str | None = None) -> list[tuple[str, str]]:
    return sorted((c.lang, c.name) for c in CORPORA if lang in (None, c.lang))


def corpora_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(asdict(c).values()) for c in CORPORA], "lang string, name string, url string, format string, license string, description string, extractor string, sha256 string")


def wiki_url(lang: str, snapshot: str) -> tuple[str, str]:
    """The snapshot as a date, and the dump's address; an unknown snapshot means the latest dump."""
    m = re.fullmatch(r"(\d{4})-?(\d{2})-?(\d{2})", snapshot)
    if m and snapshot.count("-") in (0, 2):
        day, label = "".join(m.groups()), "-".join(m.groups())
    else:
        day, label = "latest", snapshot
    wiki = f"{lang}wiki"
    return label, f"{DUMPS}/{wiki}/{day}/{wiki}-{day}-pages-articles.xml.bz2"
