"""Per-page features and keep-first deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siterank.functions import text, urls
from siterank.schemas import DOC_KEYWORDS


def doc_id(url: Column | str) -> Column:
    """Stable document id."""
    return F.xxhash64(text.col(url))


def out_links(links: Column | str) -> Column:
    """Distinct ids of the link targets of a page; a missing map is empty."""
    ids = F.transform(F.map_keys(text.col(links)), doc_id)
    return F.coalesce(F.array_distinct(ids), F.array().cast("array<bigint>"))


def document_features(crawl: DataFrame, keywords: list[str] = DOC_KEYWORDS) -> DataFrame:
    """One narrow row of features per crawl record: no text leaves the scan."""
    return crawl.select(
        "crawl_file",
        "crawl_domain",
        "ord",
        doc_id("url").alias("doc_id"),
        "date",
        "url",
        urls.netloc("url").alias("domain"),
        urls.keyword_count_in_url("url", keywords).alias("term_in_url"),
        text.keyword_count_in_title("title", keywords).alias("term_in_title"),
        text.word_count("content").alias("content_len"),
        text.word_count(text.join_code("code_snippets")).alias("code_len"),
        F.size(out_links("out_links")).alias("out_links_len"),
    )


def with_bodies(selected: DataFrame, crawl: DataFrame) -> DataFrame:
    """Selected pages with their texts, fetched by record once the choice is made."""
    texts = crawl.select("crawl_file", "ord", "title", "content", "code_snippets")
    return selected.join(texts, ["crawl_file", "ord"]).select(
        *selected.columns,
        text.clean_text("title").alias("title"),
        text.clean_text("content").alias("content"),
        text.join_code("code_snippets").alias("code"),
    )


def dedupe_first(df: DataFrame, key: Sequence[str], order: str | Column) -> DataFrame:
    """First row per key in ``order``, with ``url_num_appears`` further rows counted.

    Partial aggregation keeps one row per key and task, so a key with very many
    copies costs no more than any other.  Meant for narrow rows: join wide columns
    to the winners afterwards.
    """
    rest = [c for c in df.columns if c not in key]
    first = df.groupBy(*key).agg(
        F.min_by(F.struct(*rest), order).alias("_first"),
        (F.count(F.lit(1)) - 1).alias("url_num_appears"),
    )
    return first.select(*key, *[F.col(f"_first.{c}").alias(c) for c in rest], "url_num_appears")
