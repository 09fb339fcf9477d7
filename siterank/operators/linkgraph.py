"""In-link graph and per-file statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siterank.operators.features import doc_id
from siterank.operators.skew import running_sums

# Longest array of in-links in one row.
CHUNK_LINKS = 1000


def edges(crawl: DataFrame) -> DataFrame:
    """One row per link target of every record, duplicate records included.

    The anchor texts of one target are joined, each distinct text once.
    """
    return crawl.select(
        "crawl_file",
        "ord",
        F.col("url").alias("src_url"),
        F.explode("out_links").alias("dst_url", "texts"),
    ).select(
        "crawl_file",
        "ord",
        doc_id("dst_url").alias("doc_id"),
        "src_url",
        "dst_url",
        F.coalesce(F.array_join(F.array_sort(F.array_distinct("texts")), " "), F.lit("")).alias(
            "text"
        ),
    )


def in_degree(edge_rows: DataFrame, key: Sequence[str] = ("crawl_file", "doc_id")) -> DataFrame:
    """Number of in-links per target, counted before the shuffle."""
    return edge_rows.groupBy(*key).agg(F.count(F.lit(1)).alias("num_in_urls"))


def in_links(
    edge_rows: DataFrame,
    key: Sequence[str] = ("crawl_file", "doc_id"),
    order: Sequence[str] = ("src_url", "ord"),
    chunk_links: int = CHUNK_LINKS,
) -> DataFrame:
    """Source URLs and anchor texts per target, duplicates kept, in ``order``.

    A page may be linked from everywhere, so its lists come in numbered chunks of
    at most ``chunk_links`` entries and no task holds all of them.
    """
    numbered = running_sums(
        edge_rows.select(*key, *order, *[c for c in ("src_url", "text") if c not in order]),
        key,
        order,
        {"_row": F.lit(1)},
    )
    entry = F.struct("_row", "src_url", "text")
    return (
        numbered.withColumn("chunk", F.floor((F.col("_row") - 1) / chunk_links))
        .groupBy(*key, "chunk")
        .agg(F.sort_array(F.collect_list(entry)).alias("_links"))
        .select(
            *key,
            "chunk",
            F.col("_links.src_url").alias("in_urls"),
            F.col("_links.text").alias("in_texts"),
        )
    )


def enrich(
    docs: DataFrame, degrees: DataFrame, key: Sequence[str] = ("crawl_file", "doc_id")
) -> DataFrame:
    """Documents with their in-degree, 0 where nothing links to them."""
    return docs.join(degrees, list(key), "left").withColumn(
        "num_in_urls", F.coalesce("num_in_urls", F.lit(0).cast("bigint"))
    )


def feature_stats(df: DataFrame, by: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Rows, mean and sample standard deviation of the features per group."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(f).alias(f"mean_{f}") for f in features],
        *[F.stddev_samp(f).alias(f"std_{f}") for f in features],
    )


def index_stat(search_docs: DataFrame, domain: str = "crawl_domain") -> DataFrame:
    """Documents indexed per crawled domain."""
    return search_docs.groupBy(F.col(domain).alias("domain")).agg(
        F.count(F.lit(1)).alias("n_docs")
    )
