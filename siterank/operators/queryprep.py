"""Query expansion: raw queries into weighted, fielded clauses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siterank.functions import text
from siterank.schemas import CODE_BOOST, TITLE_BOOST, URL_BOOST

CLAUSE = "struct<field:string,text:string,boost:double>"


@dataclass
class Dictionaries:
    """Expansion tables.

    ``lang_sites(term, site)``, ``code_terms(term)``, ``unique_sites(term, site)``.
    They are joined without a hint: Spark broadcasts them when they are small.
    """

    lang_sites: DataFrame
    code_terms: DataFrame
    unique_sites: DataFrame


def decode_query(raw: Column | str) -> Column:
    """``+`` and percent escapes resolved; broken escapes stay as they are."""
    raw = text.col(raw)
    return F.coalesce(F.try_url_decode(raw), F.replace(raw, F.lit("+"), F.lit(" ")))


def decoded_terms(raw: Column | str) -> Column:
    """Lower-cased words of the decoded query."""
    return text.words(F.lower(decode_query(raw)))


def query_terms(queries: DataFrame, raw: str = "raw") -> DataFrame:
    """``(query_id, pos, term)`` in query order."""
    return queries.select("query_id", F.posexplode(decoded_terms(raw)).alias("pos", "term"))


def subterms(term: Column | str) -> Column:
    """Joined form and parts of a term with non-letters, else the term itself.

    At most three cuts are made, so the last part may keep its separators; repeats
    stay, empty strings do not.
    """
    parts = F.split(text.col(term), text.NON_ALNUM, 4)
    joined = F.array(F.array_join(parts, ""))
    split_up = F.concat(joined, F.filter(parts, lambda p: F.length(p) > 1))
    forms = F.when(F.size(parts) > 1, split_up).otherwise(F.array(text.col(term)))
    return F.filter(forms, lambda f: f != "")


def _sites(table: DataFrame, name: str) -> DataFrame:
    """One row per dictionary term with its sorted sites."""
    return table.groupBy("term").agg(F.array_sort(F.collect_set("site")).alias(name))


def _clause(field: str | None, value: Column, boost: float) -> Column:
    return F.struct(F.lit(field).alias("field"), value.alias("text"), F.lit(boost).alias("boost"))


def _site_clauses(sites: Column) -> Column:
    pairs = F.transform(
        sites, lambda s: F.array(_clause("url", s, URL_BOOST), _clause("title", s, TITLE_BOOST))
    )
    return F.coalesce(F.flatten(pairs), F.array().cast(f"array<{CLAUSE}>"))


def language_sites(terms: DataFrame, lang_sites: DataFrame) -> DataFrame:
    """``(query_id, pos, lang)``: distinct sites of a term's sub-terms, sorted."""
    return (
        terms.select("query_id", "pos", F.explode(subterms("term")).alias("term"))
        .join(_sites(lang_sites, "sites"), "term")
        .groupBy("query_id", "pos")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sites")))).alias("lang"))
    )


def term_clauses(terms: DataFrame, words: Dictionaries) -> DataFrame:
    """``(query_id, pos, clauses)``: sub-terms and expansions of every term, in order.

    Code terms and unique keywords count only where no language was recognised.
    """
    code = words.code_terms.select("term").distinct().withColumn("is_code", F.lit(True))
    joined = (
        terms.join(language_sites(terms, words.lang_sites), ["query_id", "pos"], "left")
        .join(code, "term", "left")
        .join(_sites(words.unique_sites, "unique"), "term", "left")
    )
    none = F.array().cast(f"array<{CLAUSE}>")
    term = F.col("term")
    own = F.transform(subterms(term), lambda s: _clause(None, s, 1.0)).cast(f"array<{CLAUSE}>")
    language = F.concat(F.array(_clause("title", term, TITLE_BOOST)), _site_clauses(F.col("lang")))
    keyword = F.concat(
        F.when(F.col("is_code"), F.array(_clause("code", term, CODE_BOOST))).otherwise(none),
        _site_clauses(F.col("unique")),
    )
    return joined.select(
        "query_id",
        "pos",
        F.concat(own, F.when(F.col("lang").isNotNull(), language).otherwise(keyword)).alias(
            "clauses"
        ),
    )


def clause_rows(term_rows: DataFrame) -> DataFrame:
    """``(query_id, seq, field, text, boost)`` with ``seq`` in query order."""
    ordered = term_rows.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "clauses"))).alias("terms")
    )
    flat = F.flatten(F.transform("terms", lambda t: t["clauses"]))
    return ordered.select("query_id", F.posexplode(flat).alias("seq", "clause")).select(
        "query_id", "seq", "clause.*"
    )


def _clause_text(clause: Column) -> Column:
    boost = F.regexp_replace(clause["boost"].cast("string"), r"\.0$", "")
    fielded = F.concat(clause["field"], F.lit(":"), clause["text"], F.lit("^"), boost)
    return F.coalesce(fielded, clause["text"])


def expanded_queries(queries: DataFrame, words: Dictionaries, raw: str = "raw") -> DataFrame:
    """``(query_id, in_query, expanded_query, query_len)``."""
    rendered = (
        term_clauses(query_terms(queries, raw), words)
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "clauses"))).alias("terms"))
        .select(
            "query_id",
            F.array_join(
                F.transform(F.flatten(F.transform("terms", lambda t: t["clauses"])), _clause_text),
                " ",
            ).alias("expanded_query"),
        )
    )
    return queries.join(rendered, "query_id", "left").select(
        "query_id",
        decode_query(raw).alias("in_query"),
        F.coalesce("expanded_query", F.lit("")).alias("expanded_query"),
        F.size(decoded_terms(raw)).alias("query_len"),
    )
