"""Every operator bound to the sample tables: ``name -> (spark, folder) -> DataFrame``.

All bindings read whole tables.  Nested results are flattened to strings and rounded
numbers so that another engine can compare them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siterank.functions import text, urls
from siterank.functions.html import parse_pages
from siterank.operators import (
    features,
    frontier,
    linkgraph,
    pages as page_ops,
    postings,
    queryprep,
    search,
    selection,
    telemetry,
)
from siterank.operators.skew import salted_join
from siterank.plans import indexing, searching
from siterank.session import materialize, scratch_path, ship_package
from siterank.sources import crawl as crawl_source
from siterank.sources import index as index_source
from siterank.sources import stats as stats_source
from siterank.sources.tables import read_parquet
from siterank.streaming import indexing as stream_indexing
from siterank.streaming import telemetry as stream_telemetry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# The sample pages have no documentation words in their URLs; these do occur.
PAGE_KEYWORDS = ["blog", "en", "fr", "html"]
TITLE_KEYWORDS = ["the", "and", "de", "der", "la"]


def query(fn):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return fn(ship_package(spark), sf)

    QUERIES[fn.__name__] = run
    return fn


# Tables of long texts: their rows are worth spreading over the cores.
TEXT_KEYS = {"pages": "page_id", "documents": "doc_id"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf}/{name}.parquet", TEXT_KEYS.get(name))


# --- page extraction ---------------------------------------------------------


@query
def page_titles(spark, sf):
    titles = table(spark, sf, "pages").select("page_id", page_ops.extract_title("html").alias("title"))
    return titles.filter(F.col("title").isNotNull())


@query
def page_tag_texts(spark, sf):
    texts = page_ops.extract_tag_texts("html", "p")
    return table(spark, sf, "pages").select("page_id", F.posexplode(texts).alias("pos", "text"))


@query
def page_links(spark, sf):
    return page_ops.extract_links(table(spark, sf, "pages"))


@query
def grouped_links(spark, sf):
    links = page_ops.extract_links(table(spark, sf, "pages"))
    return (
        page_ops.group_links(links)
        .select("page_id", F.explode("out_links").alias("dst", "texts"))
        .select("page_id", "dst", F.size("texts").alias("n"), F.array_join("texts", "|").alias("texts"))
    )


@query
def main_content(spark, sf):
    return parse_pages(table(spark, sf, "pages").select("page_id", "html")).select(
        "page_id", F.col("parsed.content").alias("content")
    )


@query
def content_types(spark, sf):
    """Pages a crawler would keep if servers named types by the file name."""
    path = urls.path("url")
    kind = (
        F.when(path.endswith(".html"), "text/html; charset=utf-8")
        .when(path.endswith("/"), "text/plain")
        .otherwise("application/octet-stream")
    )
    typed = table(spark, sf, "pages").select("page_id", kind.alias("content_type"))
    return page_ops.filter_content_type(typed)


@query
def header_dates(spark, sf):
    header = F.concat(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    modified = F.when(F.col("event_type") == "view", header)
    fetched = F.when(F.col("event_type") != "error", header)
    return table(spark, sf, "events").select(
        "event_id", page_ops.page_date(modified, fetched).alias("date")
    )


def page_crawl(spark: SparkSession, sf: str) -> DataFrame:
    """Crawl records of the sample pages, one crawl file per host."""
    host = urls.netloc("url")
    return page_ops.crawl_records(
        table(spark, sf, "pages"), host, F.col("page_id"), snippet_tag="b"
    ).withColumn("crawl_file", F.col("crawl_domain"))


@query
def page_records(spark, sf):
    return page_crawl(spark, sf).select(
        F.col("ord").alias("page_id"),
        "crawl_domain",
        "url",
        "title",
        text.word_count("content").alias("content_len"),
        F.size("code_snippets").alias("n_snippets"),
        F.size("out_links").alias("n_targets"),
        F.size(F.flatten(F.map_values("out_links"))).alias("n_links"),
    )


# --- URLs and frontier -------------------------------------------------------


@query
def canonical_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.canonical_url("url").alias("canonical"))


@query
def url_netloc(spark, sf):
    host = urls.netloc("url")
    return table(spark, sf, "pages").select(
        "page_id",
        host.alias("netloc"),
        urls.drop_www(host).alias("no_www"),
        urls.underscore_domain(host).alias("underscored"),
    )


@query
def url_keyword_count(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", urls.keyword_count_in_url("url", PAGE_KEYWORDS).alias("n_keywords")
    )


def page_hosts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(urls.drop_www(urls.netloc("url")).alias("domain")).distinct()


@query
def start_candidates(spark, sf):
    return frontier.start_candidates(page_hosts(spark, sf))


@query
def select_start(spark, sf):
    hosts = page_hosts(spark, sf)
    candidates = frontier.start_candidates(hosts)
    probes = candidates.select(
        "candidate",
        F.when(F.length("candidate") % 5 == 0, 200).otherwise(404).alias("status"),
        F.concat("candidate", F.lit("/home")).alias("url"),
    )
    domains = hosts.select(
        "domain",
        F.when(F.col("domain").startswith("spam"), 503).otherwise(200).alias("status"),
        F.concat(F.lit("https://"), "domain").alias("url"),
    )
    return frontier.select_start(domains, candidates, probes)


@query
def next_frontier(spark, sf):
    pages = table(spark, sf, "pages")
    links = page_ops.extract_links(pages).select(urls.netloc("src").alias("domain"), F.col("dst").alias("url"))
    url = urls.canonical_url("url")
    crawled = pages.select(urls.netloc(url).alias("domain"), url.alias("url"))
    return frontier.next_frontier(links, crawled, 5, ["in", "of", "la", "die"])


# --- features and dedupe -----------------------------------------------------


@query
def dedupe_events(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    return features.dedupe_first(events, ["user_id", "event_type"], "event_id")


@query
def dedupe_documents(spark, sf):
    """First of every set of equal texts; the text itself is not shuffled."""
    docs = table(spark, sf, "documents").select(F.sha2("text", 256).alias("digest"), "doc_id", "source")
    return features.dedupe_first(docs, ["digest"], "doc_id").drop("digest")


def first_line():
    return F.substring_index("text", "\n", 1)


@query
def title_keyword_count(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", text.keyword_count_in_title(first_line(), TITLE_KEYWORDS).alias("term_in_title")
    )


@query
def word_counts(spark, sf):
    """Words of the text and, its lines taken as snippets, words and length of the code text."""
    code = text.join_code(F.split("text", "\n"))
    return table(spark, sf, "documents").select(
        "doc_id",
        text.word_count(text.clean_text("text")).alias("content_len"),
        text.word_count(code).alias("code_len"),
        F.length(code).alias("code_chars"),
    )


@query
def out_links(spark, sf):
    return page_crawl(spark, sf).select(
        F.col("ord").alias("page_id"),
        F.size(features.out_links("out_links")).alias("out_links_len"),
        F.array_join(F.array_sort(F.map_keys("out_links")), " ").alias("targets"),
    )


# --- crawl files and index statistics ----------------------------------------


def stored_crawl(spark: SparkSession, sf: str) -> DataFrame:
    """Crawl records written to a dataset and read back."""
    path = scratch_path(spark, "crawl")
    crawl_source.write_crawl(page_crawl(spark, sf).drop("crawl_file"), path)
    return crawl_source.read_crawl(spark, path, layout="dataset")


@query
def crawl_roundtrip(spark, sf):
    return stored_crawl(spark, sf).select(
        F.col("ord").alias("page_id"),
        "crawl_domain",
        "url",
        "title",
        text.word_count("content").alias("content_len"),
        F.size(F.flatten(F.map_values("out_links"))).alias("n_links"),
    )


@query
def index_stat(spark, sf):
    return linkgraph.index_stat(stored_crawl(spark, sf))


@query
def index_stat_merge(spark, sf):
    """Two runs of different tables, written as runs and added up by the scan."""
    hosts = table(spark, sf, "pages").select(urls.netloc("url").alias("crawl_domain"))
    secure = table(spark, sf, "pages").filter(F.col("url").startswith("https:")).select(
        urls.netloc("url").alias("crawl_domain")
    )
    path = scratch_path(spark, "stat")
    stats_source.write_index_stat(linkgraph.index_stat(hosts), f"{path}/run=all")
    stats_source.write_index_stat(linkgraph.index_stat(secure), f"{path}/run=secure")
    return stats_source.merge_index_stat(
        stats_source.read_index_stat(spark, path), stats_source.read_index_stat(spark, f"{path}/none")
    )


# --- link graph --------------------------------------------------------------


def part_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as links from suppliers to parts."""
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("doc_id"),
        F.col("l_suppkey").cast("string").alias("src_url"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"),
        F.col("l_returnflag").alias("text"),
    )


@query
def in_links(spark, sf):
    rows = linkgraph.in_links(part_edges(spark, sf), ["doc_id"], ["src_url", "ord"], chunk_links=16)
    return rows.select(
        "doc_id",
        "chunk",
        F.array_join("in_urls", " ").alias("in_urls"),
        F.array_join("in_texts", " ").alias("in_texts"),
    )


def linked_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as pages: one crawl file per brand, features from their columns."""
    parts = table(spark, sf, "part").select(
        F.col("p_partkey").alias("doc_id"),
        F.col("p_brand").alias("crawl_file"),
        F.col("p_name").alias("url"),
        F.when(F.col("p_size") != 13, F.col("p_size").cast("bigint")).alias("date"),
        F.length("p_type").alias("term_in_url"),
        (F.col("p_size") % 3).alias("term_in_title"),
        F.col("p_size").alias("content_len"),
        F.length("p_name").alias("code_len"),
        (F.col("p_size") % 7).alias("out_links_len"),
    )
    degrees = linkgraph.in_degree(part_edges(spark, sf), ["doc_id"])
    return linkgraph.enrich(parts, degrees, ["doc_id"]).withColumn(
        "in_out_ratio", selection.in_out_ratio()
    )


@query
def enriched(spark, sf):
    return linked_parts(spark, sf).select("doc_id", "num_in_urls", "out_links_len")


@query
def in_out_ratio(spark, sf):
    return linked_parts(spark, sf).select("doc_id", "in_out_ratio")


NORMALIZED = selection.NORMALIZED_FEATURES


@query
def feature_stats(spark, sf):
    stats = linkgraph.feature_stats(linked_parts(spark, sf), ["crawl_file"], NORMALIZED)
    return stats.select(
        "crawl_file",
        "n",
        *[F.round(f"{kind}_{f}", 6).alias(f"{kind}_{f}") for f in NORMALIZED for kind in ("mean", "std")],
    )


@query
def document_stats(spark, sf):
    """Text statistics per language and source; a group of one has no deviation."""
    docs = table(spark, sf, "documents").select(
        "lang", "source", text.word_count("text").alias("content_len"), F.col("n_chars").alias("chars")
    )
    stats = linkgraph.feature_stats(docs, ["lang", "source"], ["content_len", "chars"])
    return stats.select(
        "lang",
        "source",
        "n",
        *[F.round(f"{k}_{f}", 5).alias(f"{k}_{f}") for f in ("content_len", "chars") for k in ("mean", "std")],
    )


def rated_parts(spark: SparkSession, sf: str) -> DataFrame:
    rated = selection.zscores(materialize(linked_parts(spark, sf)))
    # Nine digits before ranking: engines add up in different orders.
    return rated.withColumn("importance", F.round(selection.importance(), 9))


@query
def zscores(spark, sf):
    return rated_parts(spark, sf).select(
        "doc_id",
        *[F.round(f"normalized_{f}", 6).alias(f"normalized_{f}") for f in NORMALIZED],
        F.round("importance", 6).alias("importance"),
    )


@query
def top_n_selected(spark, sf):
    top = selection.valid_rows(selection.top_n(rated_parts(spark, sf), 20, tie=["url", "doc_id"]))
    return top.select("crawl_file", "rank", "doc_id", F.round("importance", 6).alias("importance"))


@query
def feature_vector(spark, sf):
    vector = rated_parts(spark, sf).select("doc_id", selection.feature_vector().alias("v"))
    return vector.select(
        "doc_id", *[F.round(F.get("v", F.lit(i)).cast("double"), 3).alias(f"f{i}") for i in range(11)]
    )


@query
def selected_pages(spark, sf):
    """The whole selection over crawl records: features, links, z-scores, top 3 per site."""
    crawl = stored_crawl(spark, sf)
    scored = indexing.scored_pages(crawl, PAGE_KEYWORDS, ["content_len"]).withColumn(
        "importance", F.round("importance", 9)
    )
    return selection.top_n(scored, 3).select(
        "crawl_file",
        "rank",
        "url",
        "url_num_appears",
        "term_in_url",
        "term_in_title",
        "content_len",
        "code_len",
        "out_links_len",
        "num_in_urls",
        "in_out_ratio",
        F.round("importance", 6).alias("importance"),
    )


def document_crawl(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as crawl records: a source is a site, every page links to two others."""

    def page(doc_id):
        return F.concat(F.lit("https://"), "source", F.lit(".example.org/docs/"), doc_id.cast("string"))

    doc = F.col("doc_id")
    half, root = page(doc - doc % 40 + doc % 20), page(doc % 20)
    one, two = F.struct(half, F.array("lang")), F.struct(root, F.array(F.lit("home"), "lang"))
    return table(spark, sf, "documents").select(
        F.col("source").alias("crawl_file"),
        F.col("source").alias("crawl_domain"),
        doc.alias("ord"),
        doc.alias("date"),
        page(doc).alias("url"),
        first_line().alias("title"),
        F.col("text").alias("content"),
        F.filter(F.split("text", "\n"), lambda line: line.contains("(")).alias("code_snippets"),
        F.map_from_entries(F.when(half == root, F.array(two)).otherwise(F.array(one, two))).alias("out_links"),
    )


@query
def selected_documents(spark, sf):
    """The whole selection over the documents: in-links, z-scores, top 25 per source."""
    scored = indexing.scored_pages(
        document_crawl(spark, sf), ["docs", *TITLE_KEYWORDS], ["content_len", "num_in_urls"]
    ).withColumn("importance", F.round("importance", 9))
    return selection.top_n(scored, 25).select(
        "crawl_file",
        "rank",
        "url",
        "term_in_url",
        "term_in_title",
        "content_len",
        "code_len",
        "out_links_len",
        "num_in_urls",
        "in_out_ratio",
        F.round("importance", 6).alias("importance"),
    )


def index_documents(spark: SparkSession, sf: str) -> str:
    """All documents to a stored search index, no limit per source; returns its path."""
    path = scratch_path(spark, "index")
    indexing.index_crawl(
        document_crawl(spark, sf), path, "all", n=None, importance_features=["content_len", "num_in_urls"]
    )
    return path


@query
def indexed_document_stats(spark, sf):
    """Document frequencies of the anchor texts in a stored index of all documents."""
    index = index_source.read_index(spark, index_documents(spark, sf))
    return index.terms.filter("field = 'links_texts'").select("term", "df")


# --- postings and search -----------------------------------------------------

TEXT_FIELD = {"text": False}


def document_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return postings.field_tokens(table(spark, sf, "documents"), TEXT_FIELD, "doc_id")


@query
def document_postings(spark, sf):
    rows = postings.document_postings(document_tokens(spark, sf), "doc_id")
    return rows.select(
        "doc_id", "term", "tf", F.array_join("positions", " ").alias("positions"), "field_len"
    )


@query
def postings_stats(spark, sf):
    rows = postings.document_postings(document_tokens(spark, sf), "doc_id")
    return postings.term_stats(rows).select("term", "df")


@query
def field_stats(spark, sf):
    return postings.field_stats(document_tokens(spark, sf)).select(
        "n_docs", "total_len", F.round(F.col("total_len") / F.col("n_docs"), 6).alias("mean_len")
    )


def benchmark_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark text, whole, as a query."""
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("raw"))


def bare_clauses(queries: DataFrame) -> DataFrame:
    """Sub-terms of every query term, without dictionary expansion."""
    terms = queryprep.query_terms(search.valid_queries(queries))
    forms = terms.select("query_id", "pos", F.posexplode(queryprep.subterms("term")).alias("i", "text"))
    return forms.select(
        "query_id",
        (F.col("pos") * 8 + F.col("i")).alias("seq"),
        F.lit(None).cast("string").alias("field"),
        "text",
        F.lit(1.0).alias("boost"),
    )


def benchmark_tokens(spark: SparkSession, sf: str, fields=TEXT_FIELD, stem: bool = False) -> DataFrame:
    clauses = bare_clauses(benchmark_queries(spark, sf))
    return materialize(search.clause_tokens(clauses, fields, stem))


@query
def bm25_topn(spark, sf):
    tokens = benchmark_tokens(spark, sf)
    index = searching.index_of(table(spark, sf, "documents"), tokens, TEXT_FIELD, "doc_id", stem=False, phrases=False)
    found = searching.scores(tokens, index, "doc_id", phrases=False)
    return search.top_hits(found, 10, "doc_id").select("query_id", "rank", "doc_id", "score")


@query
def bm25_topn_blocks(spark, sf):
    """The rows of ``bm25_topn``, joining only the postings of document ranges that can
    hold one of the ten best (block maxima and a threshold, exact)."""
    tokens = benchmark_tokens(spark, sf)
    index = searching.index_of(table(spark, sf, "documents"), tokens, TEXT_FIELD, "doc_id", stem=False, phrases=False)
    terms = materialize(index.terms)
    weighed = materialize(search.weigh_clauses(tokens, terms, index.fields))
    found = search.block_top_hits(weighed, index.postings, 10, "doc_id")
    return found.select("query_id", "rank", "doc_id", "score")


@query
def phrase_match(spark, sf):
    """Documents with a whole benchmark text, word by word."""
    clauses = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.lit(0).alias("seq"),
        F.lit("text").alias("field"),
        "text",
        F.lit(1.0).alias("boost"),
    )
    tokens = materialize(search.clause_tokens(clauses, TEXT_FIELD, stem=False))
    index = searching.index_of(table(spark, sf, "documents"), tokens, TEXT_FIELD, "doc_id", stem=False)
    terms = materialize(index.terms)
    weighed = materialize(search.weigh_clauses(tokens, terms, index.fields))
    return search.match_clauses(weighed, index.postings, terms, "doc_id").select(
        "query_id", "doc_id", "freq"
    )


PAGE_FIELDS = {"url": False, "title": False}


@query
def fielded_search(spark, sf):
    """Sites searched for by host (a phrase in the URL) and by every word of their titles."""
    pages = table(spark, sf, "pages").select(
        "page_id", "url", page_ops.extract_title("html").alias("title")
    )
    words = pages.select(urls.netloc("url").alias("site"), F.explode(text.tokens_default("title")).alias("word"))
    sites = words.groupBy("site").agg(F.sort_array(F.collect_set("word")).alias("words"))

    def clause(seq, field, value, boost):
        return F.struct(
            F.lit(seq).cast("int").alias("seq") if isinstance(seq, int) else seq.alias("seq"),
            F.lit(field).cast("string").alias("field"),
            value.alias("text"),
            F.lit(boost).alias("boost"),
        )

    def word_clauses(boost, field, offset):
        return F.transform("words", lambda word, i: clause(2 * i + offset, field, word, boost))

    clauses = sites.select(
        F.col("site").alias("query_id"),
        F.inline(
            F.concat(
                F.array(clause(0, "url", F.col("site"), 4.0)),
                word_clauses(2.0, "title", 1),
                word_clauses(1.0, None, 2),
            )
        ),
    )
    tokens = materialize(search.clause_tokens(clauses, PAGE_FIELDS, stem=False))
    index = searching.index_of(pages, tokens, PAGE_FIELDS, "page_id", stem=False)
    found = searching.scores(tokens, index, "page_id")
    return search.top_hits(found, 10, "page_id").select(
        F.col("query_id").alias("site"), "rank", "page_id", "score"
    )


def titled_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their first line as title, which copies share."""
    return table(spark, sf, "documents").select(
        "doc_id",
        "text",
        first_line().alias("title"),
        F.concat(F.lit("https://"), "source", F.lit(".example.org/"), "doc_id").alias("url"),
        F.col("text").alias("content"),
        F.lit("").alias("code"),
    )


@query
def search_titles_deduped(spark, sf):
    tokens = benchmark_tokens(spark, sf)
    docs = titled_documents(spark, sf)
    index = searching.index_of(docs, tokens, TEXT_FIELD, "doc_id", stem=False, phrases=False)
    return searching.hits(tokens, index, 10, "doc_id", phrases=False).select(
        "query_id", "rank", "doc_id", "title", "score"
    )


CONTENT_FIELD = {"content": True}


def content_search(spark: SparkSession, sf: str, stem: bool):
    tokens = benchmark_tokens(spark, sf, CONTENT_FIELD, stem)
    index = searching.index_of(titled_documents(spark, sf), tokens, CONTENT_FIELD, "doc_id", stem, phrases=False)
    return tokens, index, searching.hits(tokens, index, 10, "doc_id", phrases=False)


@query
def search_snippets(spark, sf):
    tokens, index, found = content_search(spark, sf, stem=False)
    return searching.rendered(found, tokens, index, "doc_id", stem=False)


@query
def stemmed_search(spark, sf):
    _, _, found = content_search(spark, sf, stem=True)
    return found.select("query_id", "rank", "doc_id", "title", "score")


@query
def indexed_page_search(spark, sf):
    """Crawl records to a stored index, then every user turn searched in it."""
    path = scratch_path(spark, "index")
    indexing.index_crawl(
        stored_crawl(spark, sf).withColumn("date", F.col("ord")),
        path,
        "all",
        keywords=PAGE_KEYWORDS,
        importance_features=["content_len"],
    )
    queries = user_queries(spark, sf)
    return searching.run_search(queries, sample_dictionaries(spark), index_source.read_index(spark, path))


# --- query expansion ---------------------------------------------------------


def sample_dictionaries(spark: SparkSession) -> queryprep.Dictionaries:
    """Small own dictionaries over words that occur in the sample turns."""
    return queryprep.Dictionaries(
        lang_sites=spark.createDataFrame(
            [("in", "docs.in.example"), ("in", "in.example.org"), ("que", "que.example.net"), ("der", "der.example.com")],
            "term string, site string",
        ),
        code_terms=spark.createDataFrame([("la",), ("is",), ("ver",)], "term string"),
        unique_sites=spark.createDataFrame(
            [("la", "lasite"), ("the", "thesite"), ("the", "another"), ("que", "never")],
            "term string, site string",
        ),
    )


def user_queries(spark: SparkSession, sf: str) -> DataFrame:
    """User turns as query strings: blanks as ``+``, line ends as escapes."""
    turns = table(spark, sf, "conversations").filter("role = 'user'")
    raw = F.replace(F.replace("text", F.lit(" "), F.lit("+")), F.lit("\n"), F.lit("%0A"))
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), raw.alias("raw"))


@query
def query_decode(spark, sf):
    return user_queries(spark, sf).select("query_id", queryprep.decode_query("raw").alias("in_query"))


@query
def query_terms(spark, sf):
    return queryprep.query_terms(user_queries(spark, sf))


@query
def query_subterms(spark, sf):
    return queryprep.query_terms(user_queries(spark, sf)).select(
        "query_id", "pos", F.array_join(queryprep.subterms("term"), " ").alias("subterms")
    )


@query
def query_expand(spark, sf):
    return queryprep.expanded_queries(user_queries(spark, sf), sample_dictionaries(spark)).select(
        "query_id", "expanded_query", "query_len"
    )


@query
def query_clauses(spark, sf):
    terms = queryprep.query_terms(user_queries(spark, sf))
    return queryprep.clause_rows(queryprep.term_clauses(terms, sample_dictionaries(spark)))


# --- telemetry ---------------------------------------------------------------


def page_events(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """Events of a kind with the URL of the page they belong to."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    n_pages = pages.agg(F.count(F.lit(1))).scalar()
    events = table(spark, sf, "events").filter(F.col("event_type") == kind)
    seen = events.withColumn("page_id", F.pmod("user_id", n_pages))
    return salted_join(seen, pages, ["page_id"], ["event_id"]).select(
        "event_id", "ts", "user_id", "value", "url"
    )


def query_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as served queries; whole numbers, so that every engine adds up the same."""
    return table(spark, sf, "events").select(
        F.col("event_id").alias("query_id"),
        "ts",
        F.round(F.col("value") * 100).cast("bigint").alias("latency_ms"),
    )


@query
def impressions_by_domain(spark, sf):
    return telemetry.domain_counts(page_events(spark, sf, "view"))


@query
def clicks_by_domain(spark, sf):
    return telemetry.domain_counts(page_events(spark, sf, "click"))


@query
def top_domains(spark, sf):
    return telemetry.top_k(telemetry.domain_counts(page_events(spark, sf, "view")), 3)


@query
def latency_summary(spark, sf):
    return telemetry.latency_summary(query_log(spark, sf)).select(
        "processed_queries", F.round("avg_latency", 6).alias("avg_latency")
    )


@query
def latency_running_mean(spark, sf):
    return telemetry.latency_running_mean(query_log(spark, sf)).select(
        "query_id", "processed_queries", "avg_latency"
    )


def host_stat(spark: SparkSession, sf: str) -> DataFrame:
    return linkgraph.index_stat(
        table(spark, sf, "pages").select(urls.netloc("url").alias("crawl_domain"))
    )


@query
def index_totals(spark, sf):
    return telemetry.index_totals(host_stat(spark, sf))


@query
def service_summary(spark, sf):
    summary = telemetry.service_summary(
        host_stat(spark, sf),
        query_log(spark, sf),
        page_events(spark, sf, "view"),
        page_events(spark, sf, "click"),
    )

    def listed(column: str):
        entries = F.transform(column, lambda e: F.concat(e["domain"], F.lit("="), e["n"].cast("string")))
        return F.array_join(entries, " ").alias(column)

    return summary.select(
        "docs_in_index",
        "domains_in_index",
        listed("top_domains"),
        "processed_queries",
        F.round("avg_latency", 6).alias("avg_latency"),
        listed("top_showed_domains"),
        listed("top_clicked_domains"),
    )


# --- streams -----------------------------------------------------------------


@query
def stream_clicks(spark, sf):
    """Clicks per domain, counted by a stream that reads the table file by file."""
    path = scratch_path(spark, "clicks")
    page_events(spark, sf, "click").select("ts", "url").write.json(path)
    clicks = stats_source.read_clicks(spark, path, streaming=True)
    return stream_telemetry.run_domain_counts(clicks)


@query
def stream_index(spark, sf):
    """Pages per host indexed by a stream of crawl records."""
    crawl_path, index_path = scratch_path(spark, "crawl"), scratch_path(spark, "index")
    crawl_source.write_crawl(
        page_crawl(spark, sf).drop("crawl_file").withColumn("date", F.col("ord")), crawl_path
    )
    stream_indexing.run_index_stream(
        spark, crawl_path, index_path, keywords=PAGE_KEYWORDS, importance_features=["content_len"]
    )
    return stats_source.read_index_stat(spark, f"{index_path}/index_stat")
