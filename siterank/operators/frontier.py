"""Start URLs and crawl frontier: the network-free part of crawling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siterank.functions import urls
from siterank.operators.skew import rank_by_group
from siterank.schemas import DOC_KEYWORDS


def start_candidates(
    seeds: DataFrame,
    keywords: list[str] = DOC_KEYWORDS,
    domain: str = "domain",
    scheme: Column | None = None,
) -> DataFrame:
    """``(domain, ord, candidate)``: two start URLs per keyword, in probing order."""
    origin = F.lit("https") if scheme is None else scheme
    host = F.col(domain)
    tries = F.flatten(
        F.array(
            *[
                F.array(
                    F.concat(origin, F.lit(f"://{word}."), host),
                    F.concat(origin, F.lit("://"), host, F.lit(f"/{word}")),
                )
                for word in keywords
            ]
        )
    )
    return seeds.select(domain, F.posexplode(tries).alias("ord", "candidate"))


def select_start(
    domains: DataFrame, candidates: DataFrame, probes: DataFrame, domain: str = "domain"
) -> DataFrame:
    """``(domain, start_url)`` of the domains that answered.

    ``domains(domain, status, url)`` is the probe of the domain itself and
    ``probes(candidate, status, url)`` the probe of every candidate.  The first
    candidate with status 200 wins, else the URL of the domain itself.
    """
    ok = probes.filter("status = 200").select("candidate", F.col("url").alias("found_url"))
    first = (
        candidates.join(ok, "candidate")
        .groupBy(domain)
        .agg(F.min_by("found_url", "ord").alias("found_url"))
    )
    return (
        domains.filter("status = 200")
        .join(first, domain, "left")
        .select(domain, F.coalesce("found_url", "url").alias("start_url"))
    )


def next_frontier(
    links: DataFrame,
    crawled: DataFrame,
    n: int,
    keywords: list[str] = DOC_KEYWORDS,
    domain: str = "domain",
) -> DataFrame:
    """``(domain, url, priority, rank)``: the ``n`` best new URLs per domain.

    ``links(domain, url)`` are discovered links, ``crawled(domain, url)`` what has
    been fetched.  Links are made distinct before anything else is joined, so a
    target that every page links to is one row from then on.
    """
    fresh = (
        links.select(domain, "url")
        .distinct()
        .join(crawled.select(domain, "url").distinct(), [domain, "url"], "left_anti")
        .withColumn("priority", urls.keyword_count_in_url("url", keywords))
    )
    return rank_by_group(fresh, [domain], [F.desc("priority"), F.asc("url")], n, ["url"])
