"""Captured API responses and search result pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promolens.functions import text, urls
from promolens.functions.rows import posexploded
from promolens.vocabulary import Vocabulary


def useful_captures(captures: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Captured responses worth parsing.

    Columns: ``url, domain, content_type, body``. Cheap address tests come first;
    the body is read only for rows that pass them.
    """
    url = F.lower("url")
    body = F.lower("body")
    return captures.where(
        F.contains(F.col("url"), F.col("domain"))
        & F.col("content_type").contains("json")
        & text.contains_any(url, vocab.capture_url_words)
        & ~text.contains_any(url, vocab.capture_excluded_words)
        & (F.length("body") >= 100)
        & F.try_parse_json("body").isNotNull()
        & text.contains_any(body, vocab.capture_indicators)
    )


def search_hits(results: DataFrame, vocab: Vocabulary, per_query: int | None = None) -> DataFrame:
    """Addresses behind search result links (``query, html``): known sites, with a
    promotion word, first seen per query; all of them, or the first ``per_query``."""
    found = F.regexp_extract_all("html", F.lit(r"/url\?q=([^&\"]+)"), F.lit(1))

    def wanted(u: Column) -> Column:
        return text.contains_any(u, vocab.site_domains) & text.contains_any(u, vocab.search_url_words)

    firsts = F.array_distinct(F.filter(found, wanted))
    firsts = firsts if per_query is None else F.slice(firsts, 1, per_query)
    return posexploded(results, ["query"], firsts, "position", "url")


def distinct_hits(hits: DataFrame) -> DataFrame:
    """Every address once."""
    return hits.select("url").distinct()


def write_hits(hits: DataFrame, path: str) -> None:
    distinct_hits(hits).write.mode("overwrite").text(path)


def url_domain(vocab: Vocabulary) -> Column:
    return urls.site_domain(F.col("url"), vocab)
