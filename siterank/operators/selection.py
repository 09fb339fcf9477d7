"""Normalisation and selection of the most important pages of every site."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siterank.operators.linkgraph import feature_stats
from siterank.operators.skew import rank_by_group, salted_join
from siterank.schemas import IMPORTANCE_FEATURES, NORMALIZED_FEATURES
from siterank.session import materialize


def in_out_ratio(num_in: str = "num_in_urls", num_out: str = "out_links_len") -> Column:
    """Whole-number ratio of in-links to out-links, both plus one."""
    return F.expr(f"({num_in} + 1) div ({num_out} + 1)")


def zscores(
    df: DataFrame,
    by: Sequence[str] = ("crawl_file",),
    features: Sequence[str] = NORMALIZED_FEATURES,
    spread: Sequence[str] = ("doc_id",),
    **skew,
) -> DataFrame:
    """Add ``normalized_*`` per group; null where a feature does not vary.

    The statistics are aggregated before the shuffle and joined back; a group with
    very many rows is split over tasks, its one row of statistics repeated.
    """
    # One row per group, written so that its true size decides how it is joined.
    stats = materialize(feature_stats(df, by, features))
    joined = salted_join(
        df, stats.drop("n"), by, spread, counts=stats.select(*by, "n"), **skew
    )
    return joined.select(
        *df.columns,
        *[
            F.try_divide(F.col(f) - F.col(f"mean_{f}"), F.col(f"std_{f}")).alias(f"normalized_{f}")
            for f in features
        ],
    )


def importance(features: Sequence[str] = IMPORTANCE_FEATURES) -> Column:
    """Sum of z-scores, null when one of them is."""
    return reduce(lambda a, b: a + b, [F.col(f"normalized_{f}") for f in features])


def top_n(
    df: DataFrame,
    n: int | None,
    by: Sequence[str] = ("crawl_file",),
    score: str = "importance",
    tie: Sequence[str] = ("url",),
) -> DataFrame:
    """The ``n`` best rows per group, all of them if ``n`` is None; rows without a score come last."""
    return rank_by_group(
        df, by, [F.col(score).desc_nulls_last(), *[F.col(t).asc() for t in tie]], n, tie
    )


def valid_rows(df: DataFrame) -> DataFrame:
    """Drop selected pages without id, date or URL (after the limit, not before)."""
    return df.dropna(subset=["doc_id", "date", "url"])


def feature_vector(features: Sequence[str] = NORMALIZED_FEATURES) -> Column:
    """Raw features, in/out ratio and z-scores as 32-bit floats, null as 0."""
    names = [*features, "in_out_ratio", *[f"normalized_{f}" for f in features]]
    return F.array(*[F.coalesce(F.col(c).cast("float"), F.lit(0.0).cast("float")) for c in names])
