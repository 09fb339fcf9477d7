"""Analysed tokens, positional postings and collection statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siterank.functions import text
from siterank.functions.stemming import stem_tokens
from siterank.operators.skew import running_sums, salted_join
from siterank.schemas import SEARCH_FIELDS

# Positions of a term in one posting row span at most this many tokens.
CHUNK_TOKENS = 65_536


def analyzed(c: Column | str, stemmed: bool) -> Column:
    """Tokens of a text by position; a token of 40 bytes or more leaves a null."""
    tokens = F.transform(
        text.alnum_tokens(c), lambda t: F.when(F.octet_length(t) < text.MAX_TOKEN_BYTES, t)
    )
    return stem_tokens(tokens) if stemmed else tokens


def field_tokens(
    docs: DataFrame,
    fields: dict[str, bool],
    key: str = "doc_key",
    stem: bool = True,
) -> DataFrame:
    """``(key, field, tokens, field_len)``: one row per document and field."""
    entries = [
        F.struct(
            F.lit(field).alias("field"),
            analyzed(F.coalesce(field, F.lit("")), stem and stemmed).alias("tokens"),
        )
        for field, stemmed in fields.items()
    ]
    return docs.select(key, F.inline(F.array(*entries))).withColumn(
        "field_len", F.size(F.array_compact("tokens")).cast("bigint")
    )


def document_postings(tokens: DataFrame, key: str = "doc_key") -> DataFrame:
    """``(key, field, field_len, term, tf, positions, chunk, is_first)`` of ``field_tokens``.

    All tokens of a text are in one row, so its postings are made inside the row by
    sorting them: no shuffle at all, and no array is longer than the one it is from.
    """
    places = F.filter(
        F.transform("tokens", lambda t, i: F.struct(t.alias("term"), i.alias("pos"))),
        lambda e: e["term"].isNotNull(),
    )

    def starts_run(entry, i):
        other_term = F.get("_sorted", i - 1)["term"] != entry["term"]
        return F.when((i == 0) | other_term, i)

    def run_of(start, j):
        end = F.coalesce(F.get("_starts", j + 1), F.size("_sorted"))
        return F.slice("_sorted", start + 1, end - start)

    def posting(run):
        return F.struct(
            F.get(run, F.lit(0))["term"].alias("term"),
            F.size(run).cast("bigint").alias("tf"),
            F.transform(run, lambda e: e["pos"].cast("bigint")).alias("positions"),
        )

    return _one_chunk(
        tokens.withColumn("_sorted", F.sort_array(places))
        .withColumn("_starts", F.array_compact(F.transform("_sorted", starts_run)))
        .select(key, "field", "field_len", F.inline(F.transform(F.transform("_starts", run_of), posting)))
    )


def _one_chunk(postings: DataFrame) -> DataFrame:
    """Postings of whole texts: the only chunk, and the first, of their term."""
    return postings.withColumn("chunk", F.lit(0)).withColumn("is_first", F.lit(True))


def asked_postings(
    tokens: DataFrame, wanted: DataFrame, key: str = "doc_key", positions: bool = True
) -> DataFrame:
    """Postings of the ``(field, term)`` pairs of ``wanted`` only.

    Tokens nobody asks for are dropped before anything is grouped or shuffled; those
    of a text meet in its task first, so a frequent term is not a large group.  The
    empty term stands for the text itself and brings its length along.
    """
    rows = tokens.select(
        key,
        "field",
        "field_len",
        F.posexplode(F.concat(F.array(F.lit("")), "tokens")).alias("pos", "term"),
    ).filter("term is not null")
    places = [F.sort_array(F.collect_list(F.col("pos").cast("bigint"))).alias("positions")]
    return _one_chunk(
        salted_join(rows, wanted, ["field", "term"], [key], "left_semi")
        .groupBy("field", "term", key)
        .agg(
            F.count(F.lit(1)).alias("tf"),
            F.any_value("field_len").alias("field_len"),
            *(places if positions else []),
        )
    )


def link_tokens(link_texts: DataFrame, key: str = "doc_key", stem: bool = True) -> DataFrame:
    """Token rows of the field ``links_texts`` from ``(key, src_url, ord, text)`` rows.

    The anchor texts of a page form one text in ``(src_url, ord)`` order.  It is
    never put together: a running sum gives every anchor text its first position,
    so a page that is linked from everywhere is spread over many tasks.
    """
    field = "links_texts"
    analyzed_texts = link_texts.select(
        key, "src_url", "ord", analyzed("text", stem and SEARCH_FIELDS[field]).alias("tokens")
    )
    placed = running_sums(
        analyzed_texts, [key], ["src_url", "ord"], {"_end": F.size("tokens").cast("bigint")}
    )
    return placed.select(
        key,
        F.lit(field).alias("field"),
        (F.col("_end") - F.size("tokens")).alias("_start"),
        F.posexplode("tokens").alias("_i", "term"),
    ).filter("term is not null").select(
        key, "field", "term", (F.col("_start") + F.col("_i")).alias("pos")
    )


def link_postings(
    rows: DataFrame,
    lengths: DataFrame,
    key: str = "doc_key",
    chunk_tokens: int = CHUNK_TOKENS,
) -> DataFrame:
    """The same columns from the token rows of anchor texts and their lengths per page.

    A page with very many in-links has its positions in chunks of bounded size.
    """
    chunks = (
        rows.withColumn("chunk", F.floor(F.col("pos") / chunk_tokens).cast("int"))
        .groupBy("field", "term", key, "chunk")
        .agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))
    )
    # One row per chunk: few even for the most linked page.
    of_page = Window.partitionBy(key, "term")
    marked = chunks.withColumn("is_first", F.col("chunk") == F.min("chunk").over(of_page))
    return salted_join(marked, lengths, [key], ["term", "chunk"])


def link_lengths(rows: DataFrame, key: str = "doc_key") -> DataFrame:
    """Tokens of all anchor texts per page."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("field_len"))


def term_stats(postings: DataFrame) -> DataFrame:
    """Document frequency per field and term, counted before the shuffle."""
    return postings.groupBy("field", "term").agg(F.count_if("is_first").alias("df"))


def field_stats(tokens: DataFrame) -> DataFrame:
    """Documents and total tokens per field; averages follow once runs are added up."""
    return tokens.groupBy("field").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("field_len").alias("total_len")
    )


def stored_field_stats(postings: DataFrame, docs: DataFrame) -> DataFrame:
    """The same from written tables, without analysing the texts again."""
    n_docs = docs.agg(F.count(F.lit(1))).scalar()
    return (
        postings.groupBy("field")
        .agg(F.sum("tf").alias("total_len"))
        .select("field", n_docs.alias("n_docs"), "total_len")
    )
