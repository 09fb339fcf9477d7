"""Crawl records to a search index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siterank.operators import features, linkgraph, postings, selection
from siterank.operators.skew import salted_join
from siterank.schemas import DOC_KEYWORDS, IMPORTANCE_FEATURES, SEARCH_FIELDS
from siterank.session import drop_table, materialize
from siterank.sources import index as index_tables
from siterank.sources.stats import write_index_stat
from siterank.sources.tables import read_parquet

PAGE = ["crawl_file", "doc_id"]


def scored_pages(
    crawl: DataFrame,
    keywords: list[str] = DOC_KEYWORDS,
    importance_features: Sequence[str] = IMPORTANCE_FEATURES,
) -> DataFrame:
    """Distinct pages with features, z-scores and importance; no text is carried."""
    pages = features.dedupe_first(features.document_features(crawl, keywords), PAGE, "ord")
    enriched = linkgraph.enrich(pages, linkgraph.in_degree(linkgraph.edges(crawl)))
    # Read twice, for the statistics and for the scores: keep the narrow rows.
    rated = enriched.withColumn("in_out_ratio", selection.in_out_ratio())
    return selection.zscores(materialize(rated)).withColumn(
        "importance", selection.importance(importance_features)
    )


def select_pages(crawl: DataFrame, n: int | None = 10_000, **options) -> DataFrame:
    """The ``n`` most important pages of every crawl file (None: all), then only the complete ones."""
    return selection.valid_rows(selection.top_n(scored_pages(crawl, **options), n)).withColumn(
        "features", selection.feature_vector()
    )


def with_doc_key(selected: DataFrame, run: str) -> DataFrame:
    """The same URL may be indexed again by another crawl file or run."""
    return selected.withColumn("doc_key", F.xxhash64(F.lit(run), "crawl_file", "url"))


def link_texts(selected: DataFrame, crawl: DataFrame) -> DataFrame:
    """``(doc_key, src_url, ord, text)``: the anchor texts that point to selected pages."""
    edges = linkgraph.edges(crawl)
    degrees = linkgraph.in_degree(edges).withColumnRenamed("num_in_urls", "n")
    return salted_join(
        edges.select(*PAGE, "src_url", "ord", "text"),
        selected.select(*PAGE, "doc_key"),
        PAGE,
        ["src_url", "ord"],
        counts=degrees,
    ).select("doc_key", "src_url", "ord", "text")


def posting_rows(
    docs: DataFrame, anchors: DataFrame | None = None, stem: bool = True
) -> DataFrame:
    """Postings of search documents and, in ``links_texts``, of the anchors that name them."""
    own_fields = {f: s for f, s in SEARCH_FIELDS.items() if f != "links_texts"}
    rows = postings.document_postings(postings.field_tokens(docs, own_fields, stem=stem))
    if anchors is None:
        return rows
    anchor_rows = materialize(postings.link_tokens(anchors, stem=stem))
    lengths = materialize(postings.link_lengths(anchor_rows))
    return rows.unionByName(postings.link_postings(anchor_rows, lengths))


def index_crawl(
    crawl: DataFrame,
    index_path: str,
    run: str,
    n: int | None = 10_000,
    stem: bool = True,
    stored: bool = False,
    only_new: bool = False,
    **options,
) -> None:
    """Select, analyse and write all crawl files of a frame as one run of the index.

    ``n`` pages of a crawl file are indexed at most, all of them if it is None.
    Features, links, anchors and texts are separate scans of the crawl: it is stored
    first, so that its files are unpacked, or its pages parsed, only once.  Say
    ``stored`` for a crawl that is a plain scan of a stored table already, as
    ``read_crawl`` gives it for crawl files.  With ``only_new``, pages whose crawl domain
    and URL another run has indexed already are left out after the selection.
    """
    spark = crawl.sparkSession
    kept = None if stored else materialize(crawl)
    crawl = crawl if stored else kept
    chosen = select_pages(crawl, n, **options)
    if only_new:
        chosen = index_tables.not_indexed(chosen, index_path, run)
    selected = materialize(with_doc_key(chosen, run))
    index_tables.write_search_docs(features.with_bodies(selected, crawl), index_path, run)
    docs = read_parquet(spark, index_tables.run_path(index_path, "search_docs", run), "doc_key")
    # Sorting by range reads its input twice: analyse the texts only once.
    rows = materialize(posting_rows(docs, link_texts(selected, crawl), stem))
    if kept is not None:
        drop_table(kept)
    index_tables.write_postings(rows, index_path, run)
    index_tables.write_stats(postings.term_stats(rows), index_path, "term_stats", run)
    index_tables.write_stats(postings.stored_field_stats(rows, docs), index_path, "field_stats", run)
    drop_table(rows)
    write_index_stat(
        linkgraph.index_stat(selected), index_tables.run_path(index_path, "index_stat", run)
    )
