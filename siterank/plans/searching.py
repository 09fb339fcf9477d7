"""Batches of queries to ranked, rendered hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siterank.operators import postings as postings_ops
from siterank.operators import blocksearch, queryprep, search
from siterank.operators.queryprep import Dictionaries
from siterank.operators.skew import salted_join
from siterank.schemas import SEARCH_FIELDS
from siterank.session import materialize
from siterank.sources.index import SearchIndex


def scores(
    tokens: DataFrame, index: SearchIndex, key: str = "doc_key", phrases: bool = True, **skew
) -> DataFrame:
    """BM25 of materialized clause tokens against an index."""
    terms = materialize(index.terms.join(search.vocabulary(tokens), ["field", "term"]))
    # Written so that its true size decides whether the postings have to move.
    weighed = materialize(search.weigh_clauses(tokens, terms, index.fields))
    matches = search.match_clauses(weighed, index.postings, terms, key, phrases, **skew)
    return search.bm25(matches, key)


def index_of(
    docs: DataFrame,
    tokens: DataFrame,
    fields: dict[str, bool] = SEARCH_FIELDS,
    key: str = "doc_key",
    stem: bool = True,
    phrases: bool = True,
) -> SearchIndex:
    """A one-off index of ``docs``, limited to the terms the clauses ask for.

    The texts are read and analysed once: the posting with the empty term that every
    text has brings the lengths of all documents along.
    """
    no_term = F.lit("")
    analysed = postings_ops.field_tokens(docs, fields, key, stem)
    terms = search.vocabulary(tokens)
    every_text = terms.select("field", no_term.alias("term")).distinct()
    wanted = materialize(terms.unionByName(every_text))
    rows = materialize(postings_ops.asked_postings(analysed, wanted, key, phrases))
    found = rows.filter(F.col("term") != no_term)
    return SearchIndex(
        docs=docs,
        postings=found,
        terms=postings_ops.term_stats(found),
        fields=postings_ops.field_stats(rows.filter(F.col("term") == no_term)),
    )


def many_hits(
    tokens: DataFrame, index: SearchIndex, n: int, key: str = "doc_key", phrases: bool = True
) -> DataFrame:
    """The ``n`` best of very many queries: their matches are never moved."""
    terms = materialize(index.terms.join(search.vocabulary(tokens), ["field", "term"]))
    whole = search.whole_clauses(tokens, terms, index.fields)
    return blocksearch.clause_top_hits(whole, index.postings, terms, n, key, phrases)


def hits(
    tokens: DataFrame, index: SearchIndex, n: int, key: str = "doc_key", phrases: bool = True, many: bool = False
) -> DataFrame:
    """``(query_id, rank, key, score, url, title)``: the ``n`` best, one per title.

    Twice as many are ranked first; equal titles among them give way to the best.
    ``many`` is for queries that are as many as the documents.
    """
    if many:
        ranked = materialize(many_hits(tokens, index, 2 * n, key, phrases))
    else:
        ranked = materialize(search.top_hits(scores(tokens, index, key, phrases), 2 * n, key))
    titled = search.with_columns_of(ranked, index.docs, ["url", "title"], key)
    return search.limit_per_query(search.dedupe_titles(titled), n)


def rendered(
    found: DataFrame, tokens: DataFrame, index: SearchIndex, key: str = "doc_key", stem: bool = True
) -> DataFrame:
    """Hits with snippets, which are made for these hits only.

    The terms of the queries go to the texts: a text is moved once, however many hits
    it is, and read by them where it is.
    """
    terms = index.terms.join(search.vocabulary(tokens), ["field", "term"])
    found = materialize(found)
    asked = materialize(search.with_snippet_terms(found, search.snippet_terms(tokens, terms)))
    texts = search.hit_documents(found, index.docs, ["content", "code"], key)
    return search.render_hits(search.snippets(salted_join(asked, texts, [key], ["query_id"]), stem=stem))


def run_search(
    queries: DataFrame, words: Dictionaries, index: SearchIndex, n: int = 10, stem: bool = True
) -> DataFrame:
    """``(query_id, rank, url, title, snippet)`` of ``queries(query_id, raw)``.

    Equal queries are searched once and their hits handed to all of them.
    """
    asked = search.valid_queries(queries)
    distinct = asked.select("raw").distinct().withColumn("query_id", F.xxhash64("raw"))
    clauses = queryprep.clause_rows(
        queryprep.term_clauses(queryprep.query_terms(distinct), words)
    )
    tokens = materialize(search.clause_tokens(clauses, stem=stem))
    found = hits(tokens, index, n, many=True)
    shown = materialize(rendered(found, tokens, index, stem=stem))
    return salted_join(
        asked.select("query_id", F.xxhash64("raw").alias("_asked")),
        shown.withColumnRenamed("query_id", "_asked"),
        ["_asked"],
        ["query_id"],
    ).drop("_asked")
