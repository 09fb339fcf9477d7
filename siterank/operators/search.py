"""Batch search: many queries against the postings in one join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siterank.functions import text
from siterank.functions.snippet import snippet_udf
from siterank.functions.stemming import stem_tokens
from siterank.operators.postings import analyzed
from siterank.operators.skew import rank_by_group, salted_join
from siterank.schemas import SEARCH_FIELDS
from siterank.session import broadcast_limit, estimated_bytes, materialize
from siterank.sources.index import term_bucket

# Fixed values of the ranking formula.
BM25_K1 = 1.2
BM25_B = 0.75
# Matches of clauses in documents that one task adds up.
MATCH_ROWS = 1_000_000


def valid_queries(queries: DataFrame, raw: str = "raw") -> DataFrame:
    """Queries with some text."""
    return queries.filter(F.col(raw).isNotNull() & (F.col(raw) != ""))


def expand_default_fields(
    clauses: DataFrame, fields: Sequence[str] = tuple(SEARCH_FIELDS)
) -> DataFrame:
    """A clause without a field is tried in every searched field."""
    own = F.array(F.col("field"))
    all_fields = F.array(*[F.lit(f) for f in fields])
    return clauses.withColumn(
        "field", F.explode(F.when(F.col("field").isNull(), all_fields).otherwise(own))
    )


def clause_tokens(
    clauses: DataFrame,
    fields: dict[str, bool] = SEARCH_FIELDS,
    stem: bool = True,
) -> DataFrame:
    """``(query_id, clause, field, i, term, n_tokens, weight)`` of fielded, boosted clauses.

    ``clause`` numbers the clauses of a query.  Repeated clauses of a query add up their boosts.  A text of several tokens is a
    phrase: token ``i`` must stand ``i`` places after the first.
    """
    field_number = F.array_position(F.array(*[F.lit(f) for f in fields]), F.col("field"))
    # The rows of a query and text are brought together before they are multiplied by the
    # fields, and the text is analysed once for all of them.
    together = clauses.repartition("query_id", "text")
    merged = (
        expand_default_fields(together, list(fields))
        .groupBy("query_id", "field", "text")
        .agg(F.min("seq").alias("seq"), F.sum("boost").alias("weight"))
        .withColumn("clause", F.col("seq").cast("bigint") * len(fields) + field_number)
        .groupBy("query_id", "text")
        .agg(F.collect_list(F.struct("clause", "field", "weight")).alias("_clauses"))
        .withColumn("tokens", analyzed("text", stemmed=False))
    )
    stemmed_fields = [f for f, stemmed in fields.items() if stemmed and stem]
    stems = F.col("tokens")
    if stemmed_fields:
        merged = merged.withColumn("_stems", stem_tokens("tokens"))
        stems = F.when(F.col("field").isin(stemmed_fields), F.col("_stems")).otherwise(stems)
    merged = merged.select(*merged.columns, F.inline("_clauses")).withColumn("tokens", stems)
    return merged.select(
        "query_id",
        "clause",
        "field",
        F.size(F.array_compact("tokens")).alias("n_tokens"),
        "weight",
        F.posexplode("tokens").alias("i", "term"),
    ).filter("term is not null")


def vocabulary(tokens: DataFrame) -> DataFrame:
    """Distinct ``(field, term)`` of the clauses."""
    return tokens.select("field", "term").distinct()


def whole_clauses(tokens: DataFrame, terms: DataFrame, fields: DataFrame) -> DataFrame:
    """``(query_id, clause, field, n_tokens, gain, mean_len, found)``: a row per clause, its ``(i, term)`` in ``found``.

    ``gain`` is boost times idf of the whole clause, as BM25 uses it.  ``terms``
    holds ``(field, term, df)``, ``fields`` one ``(field, n_docs, total_len)`` row
    per searched field.  Clauses with a token that occurs nowhere drop out.
    """
    n, df = F.col("n_docs"), F.col("df")
    per_token = (
        tokens.join(terms, ["field", "term"])
        .join(F.broadcast(fields), "field")  # one row per searched field
        .withColumn("idf", F.ln(1 + (n - df + 0.5) / (df + 0.5)))
    )
    return (
        per_token.groupBy("query_id", "clause")
        .agg(
            F.any_value("field").alias("field"),
            F.any_value("n_tokens").alias("n_tokens"),
            (F.any_value("weight") * F.sum("idf") * (BM25_K1 + 1)).alias("gain"),
            F.any_value(F.col("total_len") / n).alias("mean_len"),
            F.collect_list(F.struct("i", "term")).alias("found"),
        )
        .filter(F.size("found") == F.col("n_tokens"))
    )


def weigh_clauses(tokens: DataFrame, terms: DataFrame, fields: DataFrame) -> DataFrame:
    """``(query_id, clause, field, i, term, n_tokens, gain, mean_len)`` of ``whole_clauses``."""
    whole = whole_clauses(tokens, terms, fields)
    return whole.select("query_id", "clause", "field", "n_tokens", "gain", "mean_len", F.inline("found"))


def match_clauses(
    weighed: DataFrame,
    postings: DataFrame,
    terms: DataFrame,
    key: str = "doc_key",
    phrases: bool = True,
    summed: bool = True,
    **skew,
) -> DataFrame:
    """``(query_id, key, clause, freq, gain, norm)``: matches of clauses in documents.

    Clauses within the broadcast limit meet postings that were brought together by
    document before: each posting of an asked term moves once, and what clauses make
    of it is summed up where it is.  The matches are counted before, and as many tasks
    are made that each has about ``MATCH_ROWS`` of them, however large the index is.
    For more clauses, frequent terms are split by document; ``terms`` tells how frequent
    they are.  Stored postings have a ``bucket`` per term: the clauses carry the same, so
    only the asked buckets are read.  A caller that brings matches together by document
    itself says ``summed=False``: a match may then be several rows, to be added up by ``freq``.
    """
    on = ["field", "term"]
    if "bucket" in postings.columns:
        weighed = weighed.withColumn("bucket", term_bucket("term"))
        terms = terms.withColumn("bucket", term_bucket("term"))
        on = ["field", "bucket", "term"]
    length = (1 - BM25_B) + BM25_B * F.col("field_len") / F.col("mean_len")
    clause, facts = ["query_id", key, "clause"], ["gain", "norm"]
    kept = [F.any_value(c).alias(c) for c in facts]
    limit = skew.get("broadcast_bytes")
    limit = broadcast_limit(postings.sparkSession) if limit is None else limit
    few = estimated_bytes(weighed) <= limit
    skew["counts"] = terms.select(*on, F.col("df").alias("n"))

    singles = weighed.filter("n_tokens = 1")
    if few:
        # A document's postings of a term, one per chunk, are added up before clauses multiply them.
        asked = F.broadcast(singles.select(*on).distinct())
        by_document = (
            postings.join(asked, on, "left_semi")
            .repartition(match_tasks(singles, terms, on), key)
            .groupBy(*on, key)
            .agg(F.sum("tf").alias("freq"), F.any_value("field_len").alias("field_len"))
        )
        single = by_document.join(F.broadcast(singles), on).withColumn("norm", BM25_K1 * length)
        single = single.select(*clause, "freq", *facts)
    else:
        # The postings of a term in a document are few rows, one per chunk: bring all
        # clauses of a query and document together at once.
        joined = salted_join(postings, singles, on, [key], **skew).withColumn("norm", BM25_K1 * length)
        single = joined.select(*clause, F.col("tf").alias("freq"), *facts)
        if summed:
            single = single.repartition("query_id", key).groupBy(*clause).agg(F.sum("freq").alias("freq"), *kept)
    if not phrases:
        return single
    # A phrase starts where all of its tokens agree on the place of the first.  Only the
    # documents of its rarest token are looked up for the others: no list of a frequent
    # token is multiplied by the phrases it stands in.  The postings of a clause and
    # document meet in one row; a document that lacks one of the tokens drops out, and
    # the others intersect the start places of their tokens inside the row.
    candidates = salted_join(
        postings.filter("is_first").select(*on, key),
        materialize(rarest_tokens(weighed.filter("n_tokens > 1"), terms, on)),
        on,
        [key],
        **skew,
    )
    # Written so that its true size decides whether the postings have to move.
    wanted = materialize(
        candidates.select("query_id", "clause", F.col(key).alias("_key"), "n_tokens", "gain", "mean_len", F.inline("_tokens"))
    )
    vocabulary_of = weighed.filter("n_tokens > 1").select(*on).distinct()
    held = salted_join(postings, vocabulary_of, on, [key], "left_semi", **skew).select(*on, key, "field_len", "positions")
    # If the documents to look up are few enough, the postings of all others stay where they are.
    looked_up = materialize(wanted.select(F.col("_key").alias("_doc")).distinct())
    if estimated_bytes(looked_up) <= limit:
        held = held.join(F.broadcast(looked_up), F.col(key).eqNullSafe(F.col("_doc")), "left_semi")
    same = [F.col("_field") == F.col("field"), F.col("_term") == F.col("term"), F.col("_key").eqNullSafe(F.col(key))]
    phrase = (
        held.join(wanted, same)
        .withColumn("norm", BM25_K1 * length)
        .groupBy(*clause)
        .agg(
            F.collect_list(F.struct("i", "positions")).alias("_places"),
            F.any_value("n_tokens").alias("n_tokens"),
            *kept,
        )
        .filter(F.size(F.array_distinct(F.transform("_places", lambda x: x["i"]))) == F.col("n_tokens"))
        .withColumn("freq", phrase_count(F.col("_places"), F.col("n_tokens")))
        .filter("freq > 0")
        .select(*clause, "freq", *facts)
    )
    return single.unionByName(phrase)


def match_tasks(clauses: DataFrame, terms: DataFrame, on: Sequence[str], rows: int = MATCH_ROWS) -> int:
    """Tasks that have about ``rows`` matches each: a clause has one per document of its term."""
    matches = clauses.join(terms.select(*on, "df"), list(on)).agg(F.sum("df")).first()[0]
    return max(1, -(-int(matches or 0) // rows))


def rarest_tokens(clauses: DataFrame, terms: DataFrame, on: Sequence[str]) -> DataFrame:
    """A row per clause: its rarest token as ``on`` and all of them in ``_tokens``."""
    token = F.struct(*[F.col(c) for c in on])
    return (
        clauses.join(terms.select(*on, "df"), list(on), "left")
        .groupBy("query_id", "clause")
        .agg(
            F.min_by(token, F.struct(F.coalesce("df", F.lit(0)), "i")).alias("_rarest"),
            F.collect_list(F.struct("i", F.col("field").alias("_field"), F.col("term").alias("_term"))).alias("_tokens"),
            *[F.any_value(c).alias(c) for c in ("n_tokens", "gain", "mean_len")],
        )
        .select("query_id", "clause", "_rarest.*", "_tokens", "n_tokens", "gain", "mean_len")
    )


def phrase_count(places, n_tokens):
    """Places where token ``i`` stands ``i`` after the first, for every token of a phrase.

    ``places`` holds ``(i, positions)`` of one document, several rows of a token where
    its positions were stored in chunks.
    """

    def starts(i):
        of_token = F.filter(places, lambda x: x["i"] == i)
        return F.flatten(F.transform(of_token, lambda x: F.transform(x["positions"], lambda p: p - i)))

    per_token = F.transform(F.sequence(F.lit(0), n_tokens - 1), starts)
    rarest_first = F.array_sort(per_token, lambda a, b: F.size(a) - F.size(b))
    common = F.aggregate(F.slice(rarest_first, 2, n_tokens), F.get(rarest_first, 0), lambda acc, x: F.array_intersect(acc, x))
    return F.size(common).cast("bigint")


def _range_scores(singles: DataFrame, placed: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """BM25 of single-token clauses in the given ``(query_id, _range)`` only.

    Clauses and ranges within the broadcast limit meet the postings of the asked ranges
    by document, as in ``match_clauses``: matches are never moved.
    """
    length = (1 - BM25_B) + BM25_B * F.col("field_len") / F.col("mean_len")
    on, clause = ["field", "term"], ["query_id", key, "clause"]
    ranges = materialize(ranges.select("query_id", "_range"))
    if max(estimated_bytes(singles), estimated_bytes(ranges)) <= broadcast_limit(placed.sparkSession):
        held = placed.join(F.broadcast(ranges.select("_range").distinct()), "_range", "left_semi")
        found = held.groupBy(*on).agg(F.count(F.lit(1)).alias("df"))
        by_document = (
            held.repartition(match_tasks(singles, found, on), key)
            .groupBy(*on, key, "_range")
            .agg(F.sum("tf").alias("freq"), F.any_value("field_len").alias("field_len"))
        )
        rows = by_document.join(F.broadcast(singles), on).join(F.broadcast(ranges), ["query_id", "_range"])
        return bm25(rows.select(*clause, "freq", "gain", (BM25_K1 * length).alias("norm")), key)
    clauses = singles.join(ranges, "query_id")
    rows = placed.drop("mean_len").join(clauses, [*on, "_range"])
    matches = rows.groupBy(*clause).agg(
        F.sum("tf").alias("freq"), F.any_value("gain").alias("gain"), F.any_value(BM25_K1 * length).alias("norm")
    )
    return bm25(matches, key)


def block_ranges(
    weighed: DataFrame, postings: DataFrame, n: int, key: str = "doc_key", range_docs: int = 4096, seed_ranges: int = 2
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(placed postings, ranges to read, all bounded ranges)`` for ``block_top_hits``.

    Documents fall into ranges of ``range_docs`` keys (null keys into one of their
    own).  Every term keeps, per range, the largest saturation ``tf / (tf + norm)`` of
    its postings, so a query bounds the score of any document in a range by the sum of
    gain times that maximum over its clauses.  The exact scores in each query's
    ``seed_ranges`` best-bounded ranges give a threshold, the n-th of them; ranges
    bounded below it cannot hold a result.  Bounds keep a margin for rounding.
    """
    singles = weighed.filter("n_tokens = 1")
    means = singles.select("field", "mean_len").distinct()  # one row per searched field
    block = F.coalesce(F.floor(F.col(key) / range_docs), F.lit(-(1 << 62))).cast("long")
    length = (1 - BM25_B) + BM25_B * F.col("field_len") / F.col("mean_len")
    placed = postings.join(F.broadcast(means), "field").select(
        "field", "term", key, "tf", "field_len", "mean_len", block.alias("_range"),
        (F.col("tf") / (F.col("tf") + BM25_K1 * length)).alias("_sat"),
    )
    best = placed.groupBy("field", "term", "_range").agg(F.max("_sat").alias("_sat"))
    bounds = (
        singles.join(best, ["field", "term"])
        .groupBy("query_id", "_range")
        .agg(F.sum(F.col("gain") * F.col("_sat")).alias("_bound"))
    )
    by_bound = Window.partitionBy("query_id").orderBy(F.desc("_bound"), "_range")
    seeds = bounds.withColumn("_r", F.row_number().over(by_bound)).filter(F.col("_r") <= seed_ranges)
    nth = Window.partitionBy("query_id").orderBy(F.desc("score"))
    thresholds = (
        _range_scores(singles, placed, seeds, key)
        .withColumn("_r", F.row_number().over(nth))
        .filter(F.col("_r") == n)
        .select("query_id", F.col("score").alias("_least"))
    )
    margin = F.abs(F.col("_least")) * 1e-9 + 1e-9
    kept = bounds.join(thresholds, "query_id", "left").filter(
        F.col("_least").isNull() | (F.col("_bound") >= F.col("_least") - margin)
    )
    return placed, kept, bounds


def block_top_hits(
    weighed: DataFrame, postings: DataFrame, n: int, key: str = "doc_key", range_docs: int = 4096, seed_ranges: int = 2
) -> DataFrame:
    """The ``n`` best documents per query by single-token clauses, exactly as
    ``top_hits(bm25(match_clauses(..., phrases=False)))``, joining only the postings
    of ranges that can hold one of them (see ``block_ranges``)."""
    placed, kept, _ = block_ranges(weighed, postings, n, key, range_docs, seed_ranges)
    return top_hits(_range_scores(weighed.filter("n_tokens = 1"), placed, kept, key), n, key)


def bm25(matches: DataFrame, key: str = "doc_key") -> DataFrame:
    """``(query_id, key, score)``: boosted BM25, summed over the clauses."""
    freq = F.col("freq")
    part = F.col("gain") * freq / (freq + F.col("norm"))
    return matches.groupBy("query_id", key).agg(F.round(F.sum(part), 9).alias("score"))


def top_hits(scores: DataFrame, n: int, key: str = "doc_key") -> DataFrame:
    """The ``n`` best documents per query, ties by key."""
    return rank_by_group(scores, ["query_id"], [F.desc("score"), F.asc(key)], n, [key])


def hit_documents(hits: DataFrame, docs: DataFrame, columns: Sequence[str], key: str = "doc_key") -> DataFrame:
    """Stored columns, without documents that nobody hit if the hits are within the broadcast limit.

    They are dropped at the scan and their texts never move.
    """
    stored = docs.select(key, *columns)
    if estimated_bytes(hits) <= broadcast_limit(hits.sparkSession):
        stored = stored.join(F.broadcast(hits.select(key).distinct()), key, "left_semi")
    return stored


def with_columns_of(
    hits: DataFrame, docs: DataFrame, columns: Sequence[str], key: str = "doc_key", **skew
) -> DataFrame:
    """Look up stored columns of the hits; a document many queries hit is no hot spot."""
    return salted_join(hits, hit_documents(hits, docs, columns, key), [key], ["query_id"], **skew)


def dedupe_titles(hits: DataFrame) -> DataFrame:
    """Best hit per query and title, among the hits given."""
    per_title = Window.partitionBy("query_id", "title").orderBy("rank")
    return (
        hits.withColumn("_nth", F.row_number().over(per_title)).filter("_nth = 1").drop("_nth")
    )


def limit_per_query(hits: DataFrame, n: int) -> DataFrame:
    """Number the remaining hits of a query afresh and keep the first ``n``."""
    per_query = Window.partitionBy("query_id").orderBy("rank")
    return hits.withColumn("rank", F.row_number().over(per_query)).filter(F.col("rank") <= n)


def snippet_terms(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """``(query_id, field, terms)``: the weight of a query's terms per field, rarer ones more."""
    return (
        tokens.join(terms, ["field", "term"])
        .groupBy("query_id", "field")
        .agg(
            F.collect_set(F.struct("term", (1 / (1 + F.col("df"))).alias("weight"))).alias("terms")
        )
    )


def with_snippet_terms(hits: DataFrame, terms: DataFrame) -> DataFrame:
    """Add the weighted terms of the query for the content and the code, as ``snippets`` takes them."""
    for field in ("content", "code"):
        of_field = terms.filter(F.col("field") == field).select(
            "query_id", F.col("terms").alias(f"_{field}_terms")
        )
        hits = hits.join(of_field, "query_id", "left")
    return hits


def snippets(hits: DataFrame, fields: dict[str, bool] = SEARCH_FIELDS, stem: bool = True) -> DataFrame:
    """Add ``snippet`` to the final hits, from the content or else from the code."""
    for field in ("content", "code"):
        best = snippet_udf(stem and fields[field])(field, f"_{field}_terms")
        hits = hits.withColumn(f"_{field}_snippet", best)
    return hits.withColumn(
        "snippet", F.coalesce(F.nullif("_content_snippet", F.lit("")), "_code_snippet")
    ).drop("_content_terms", "_code_terms", "_content_snippet", "_code_snippet")


def render_hits(hits: DataFrame) -> DataFrame:
    """The columns shown to a user."""
    return hits.select("query_id", "rank", "url", "title", "snippet")
