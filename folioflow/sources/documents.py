"""Documents from elsewhere: fetched with retries into a cache, and parsed from their bytes.

Transport and parser are functions, so that nothing here depends on a network
or on a format's library; both run on the executors, in Arrow batches.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text as T

#: Gives the bytes behind an address or raises.
Transport = Callable[[str], bytes]
#: Gives (pages, outline) of a document: texts by page, and (level, title, page) in order.
Parser = Callable[[bytes], tuple[list[str], list[tuple[int, str, int]]]]

FETCHED = "url string, cache_key string, content binary, attempts int, error string"
PARSED = "doc_id string, kind string, ord int, level int, title string, page int, text string"


def fetch(urls: DataFrame, transport: Transport, attempts: int = 3, delay: float = 2.0, url_col: str = "url", cached: DataFrame | None = None) -> DataFrame:
    """(url, cache_key, content, attempts, error): each distinct address once.

    An attempt that fails is repeated after ``delay`` seconds times its number, up to
    ``attempts`` in all; then content is null and error tells why. Addresses whose key
    is in ``cached`` (cache_key) are left out, as are null and blank ones.
    """
    wanted = urls.select(F.trim(F.col(url_col)).alias("url")).filter("url <> ''").distinct().withColumn("cache_key", T.cache_key(F.col("url")))
    if cached is not None:
        wanted = wanted.join(cached.select("cache_key"), "cache_key", "left_anti").select("url", "cache_key")

    def get(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for url, key in zip(x["url"], x["cache_key"]):
                content, error, n = None, None, 0
                while content is None and n < attempts:
                    n += 1
                    try:
                        content, error = transport(url), None
                    except Exception as e:  # noqa: BLE001  (whatever the transport raises counts as a failed attempt)
                        error = f"{type(e).__name__}: {e}"
                        if n < attempts:
                            time.sleep(delay * n)
                rows.append((url, key, content, n, error))
            yield pd.DataFrame(rows, columns=["url", "cache_key", "content", "attempts", "error"])

    return wanted.mapInPandas(get, FETCHED)


def read_documents(spark: SparkSession, path: str, parser: Parser, pattern: str = "*") -> DataFrame:
    """Pages and outline of the files below ``path``, as :func:`parse`; a document is named by its file without the ending."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return parse(files.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("doc_id"), "content"), parser)


def parse(documents: DataFrame, parser: Parser) -> DataFrame:
    """Rows (doc_id, kind, ord, level, title, page, text) of documents (doc_id, content).

    kind is ``page`` (page, text), ``outline`` (ord, level, title, page) or ``error`` (text).
    Documents without content have no rows; one that can't be parsed has its error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows: list[tuple] = []
            for doc, content in zip(x["doc_id"], x["content"]):
                try:
                    pages, outline = parser(bytes(content))
                except Exception as e:  # noqa: BLE001  (a broken file must not end the job)
                    rows.append((doc, "error", 0, None, None, None, f"{type(e).__name__}: {e}"))
                    continue
                rows += [(doc, "page", k, None, None, k, t) for k, t in enumerate(pages)]
                rows += [(doc, "outline", k, level, title, page, None) for k, (level, title, page) in enumerate(outline)]
            out = pd.DataFrame(rows, columns=["doc_id", "kind", "ord", "level", "title", "page", "text"])
            yield out.astype({"ord": "Int32", "level": "Int32", "page": "Int32"})

    return documents.filter("content is not null").mapInPandas(run, PARSED)


def pages(parsed: DataFrame) -> DataFrame:
    """(doc_id, page, text) of parsed rows."""
    return parsed.filter("kind = 'page'").select("doc_id", "page", "text")


def outline(parsed: DataFrame) -> DataFrame:
    """(doc_id, ord, level, title, page) of parsed rows."""
    return parsed.filter("kind = 'outline'").select("doc_id", "ord", "level", "title", "page")


def json_parser(content: bytes) -> tuple[list[str], list[tuple[int, str, int]]]:
    """A parser of documents kept as JSON: {"pages": [...], "outline": [[level, title, page], ...]}."""
    found = json.loads(content)
    return list(found["pages"]), [(int(a), str(b), int(c)) for a, b, c in found.get("outline", [])]


def form_feed_parser(content: bytes) -> tuple[list[str], list[tuple[int, str, int]]]:
    """A parser of plain text whose pages are parted by form feeds; it has no outline."""
    return content.decode("utf-8").split("\f"), []
