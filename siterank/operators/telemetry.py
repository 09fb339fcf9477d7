"""Impression, click and latency aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siterank.functions.urls import netloc
from siterank.operators.skew import running_sums


def domain_counts(events: DataFrame, url: str = "url", count: str = "n") -> DataFrame:
    """Events per domain of their URL; the same plan serves batch and stream."""
    return (
        events.filter(F.col(url).isNotNull() & (F.col(url) != ""))
        .groupBy(netloc(url).alias("domain"))
        .agg(F.count(F.lit(1)).alias(count))
    )


def latency_summary(queries: DataFrame, latency: str = "latency_ms") -> DataFrame:
    """Number of queries and their mean latency."""
    return queries.agg(
        F.count(F.lit(1)).alias("processed_queries"), F.avg(latency).alias("avg_latency")
    )


def latency_running_mean(
    queries: DataFrame, order: Sequence[str] = ("ts", "query_id"), latency: str = "latency_ms"
) -> DataFrame:
    """Mean latency as of every query, in ``order``, without a one-task window."""
    sums = {"_sum": F.col(latency), "_n": F.lit(1)}
    return running_sums(queries, [], order, sums).select(
        *queries.columns,
        F.col("_n").alias("processed_queries"),
        (F.col("_sum") / F.col("_n")).alias("avg_latency"),
    )


def top_k(counts: DataFrame, k: int = 3, key: str = "domain", count: str = "n") -> DataFrame:
    """The ``k`` keys with the highest counts, ties by key."""
    return counts.orderBy(F.desc(count), F.asc(key)).limit(k)


def index_totals(stat: DataFrame) -> DataFrame:
    """Documents and domains in the index."""
    return stat.agg(
        F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs_in_index"),
        F.count(F.lit(1)).alias("domains_in_index"),
    )


def _top_list(counts: DataFrame, k: int, count: str):
    """The top keys as one sorted array; it never has more than ``k`` entries."""
    entry = F.struct((-F.col(count)).alias("order"), F.col("domain"), F.col(count).alias("n"))
    return (
        top_k(counts, k, count=count)
        .agg(F.array_sort(F.collect_list(entry)).alias("top"))
        .select(F.transform("top", lambda e: F.struct(e["domain"].alias("domain"), e["n"].alias("n"))))
        .scalar()
    )


def service_summary(
    stat: DataFrame, queries: DataFrame, shown: DataFrame, clicked: DataFrame, k: int = 3
) -> DataFrame:
    """One row with totals, mean latency and the top domains of every kind."""
    return (
        index_totals(stat)
        .withColumn("top_domains", _top_list(stat, k, "n_docs"))
        .withColumn("processed_queries", queries.agg(F.count(F.lit(1))).scalar())
        .withColumn("avg_latency", F.coalesce(queries.agg(F.avg("latency_ms")).scalar(), F.lit(0.0)))
        .withColumn("top_showed_domains", _top_list(domain_counts(shown), k, "n"))
        .withColumn("top_clicked_domains", _top_list(domain_counts(clicked), k, "n"))
    )
