"""Query expansion on hand-worked cases."""

import pytest

from siterank.operators import queryprep


@pytest.fixture(scope="module")
def words(spark):
    return queryprep.Dictionaries(
        spark.createDataFrame([("python", "docs.python.org"), ("nodejs", "nodejs.org")], "term string, site string"),
        spark.createDataFrame([("lambda",), ("proxy_pass",)], "term string"),
        spark.createDataFrame([("lambda", "python"), ("proxy_pass", "nginx")], "term string, site string"),
    )


def test_subterms(spark):
    cases = {
        "node.js": ["nodejs", "node", "js"],
        "c++": ["c"],
        "a-b-c-d-e.f": ["abcd-e.f", "d-e.f"],
        "$variable": ["variable", "variable"],
        "++": [],
        "proxy_pass": ["proxypass", "proxy", "pass"],
        "plain": ["plain"],
        "über-größe": ["übergröße", "über", "größe"],
    }
    df = spark.createDataFrame([(t,) for t in cases], "term string")
    got = {r.term: r.s for r in df.select("term", queryprep.subterms("term").alias("s")).collect()}
    assert got == cases


def test_expansion(spark, words):
    cases = {
        "Python+lambda": (
            "python title:python^2 url:docs.python.org^4 title:docs.python.org^2 "
            "lambda code:lambda^1.5 url:python^4 title:python^2",
            2,
        ),
        "node.js%20%20proxy_pass": (
            "nodejs node js title:node.js^2 url:nodejs.org^4 title:nodejs.org^2 "
            "proxypass proxy pass code:proxy_pass^1.5 url:nginx^4 title:nginx^2",
            2,
        ),
        "100% sure": ("100 100 sure", 2),
        "": ("", 0),
    }
    df = spark.createDataFrame(list(enumerate(cases)), "query_id long, raw string")
    got = {r.query_id: r for r in queryprep.expanded_queries(df, words).collect()}
    assert [(got[i].expanded_query, got[i].query_len) for i in range(len(cases))] == list(cases.values())
    assert got[1].in_query == "node.js  proxy_pass" and got[2].in_query == "100% sure"


def test_clause_rows_keep_order(spark, words):
    df = spark.createDataFrame([(7, "x lambda")], "query_id long, raw string")
    rows = queryprep.clause_rows(queryprep.term_clauses(queryprep.query_terms(df), words)).orderBy("seq").collect()
    assert [(r.seq, r.field, r.text, r.boost) for r in rows] == [
        (0, None, "x", 1.0),
        (1, None, "lambda", 1.0),
        (2, "code", "lambda", 1.5),
        (3, "url", "python", 4.0),
        (4, "title", "python", 2.0),
    ]
