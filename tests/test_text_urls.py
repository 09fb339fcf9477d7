"""Text and URL expressions on hand-worked cases."""

import pytest
from pyspark.sql import functions as F

from siterank.functions import text, urls
from siterank.functions.stemming import stem, stem_tokens
from siterank.operators import features
from siterank.schemas import DOC_KEYWORDS


def values(spark, inputs, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, c string")
    rows = df.select("i", *[c.alias(f"v{k}") for k, c in enumerate(columns)]).orderBy("i").collect()
    return [r[1] if len(columns) == 1 else tuple(r[1:]) for r in rows]


def test_keyword_count_in_url(spark):
    cases = {
        "https://docs.x.com/docs/guide/#faq": 4,
        "https://x.com/how-to/": 0,
        "https://how-to.x.com/": 1,
        "https://Docs.x.com/Docs": 0,
        "https://docs:1/user_guide": 1,
        "https://x.com/?docs=guide": 0,
        "https://x.com/a;docs": 0,
    }
    got = values(spark, cases, urls.keyword_count_in_url("c", DOC_KEYWORDS))
    assert got == list(cases.values())


def test_netloc_never_raises(spark):
    cases = {
        "https://a.com/x": "a.com",
        "http://h?x": "h",
        "//h2/y": "h2",
        "not a url": "",
        "http://[bad/": "[bad",
        "mailto:x@y": "",
        "https://u:p@host:80#f": "u:p@host:80",
    }
    assert values(spark, cases, urls.netloc("c")) == list(cases.values())


def test_domain_keys(spark):
    got = values(
        spark, [" WWW.A.www.b.com ", "www.x.org", "wwwx.org"], urls.underscore_domain("c"), urls.drop_www("c")
    )
    assert got == [("a_b_com", " WWW.A.www.b.com "), ("x_org", "x.org"), ("wwwx_org", "wwwx.org")]


def test_canonical_url(spark):
    cases = {
        "HTTP://Www.Example.com": "http://www.example.com/",
        "http://a.com/b?z=1&a=2&a=1#frag": "http://a.com/b?a=1&a=2&z=1",
        "http://a.com/x y/%7euser": "http://a.com/x%20y/~user",
        "http://a.com/ä": "http://a.com/%C3%A4",
        "http://a.com/%e4%b8%ad%2f": "http://a.com/%E4%B8%AD%2F",
        "http://a.com/p?q=a b&r": "http://a.com/p?q=a+b&r=",
        "http://a.com/p?q=~*": "http://a.com/p?q=~%2A",
        "http://a.com:/p": "http://a.com/p",
        "http://a.com/a,b;c=(d)": "http://a.com/a,b;c=(d)",
        "http://a.com/100%": "http://a.com/100%",
    }
    assert values(spark, cases, urls.canonical_url("c")) == list(cases.values())


def test_resolve_url(spark):
    base = F.lit("https://a.com/docs/guide/page.html?q=1#top")
    cases = {
        "http://b.org/x": "http://b.org/x",
        "//c.net/y": "https://c.net/y",
        "/root": "https://a.com/root",
        "next.html": "https://a.com/docs/guide/next.html",
        "../up/./x?y=1#z": "https://a.com/docs/up/x?y=1#z",
        "../../../../x": "https://a.com/x",
        "..": "https://a.com/docs/",
        "?q=2": "https://a.com/docs/guide/page.html?q=2",
        "#sec": "https://a.com/docs/guide/page.html?q=1#sec",
        " \n/t ": "https://a.com/t",
        "mailto:x@y": "mailto:x@y",
    }
    assert values(spark, cases, urls.resolve_url(base, F.col("c"))) == list(cases.values())


def test_in_domain(spark):
    got = values(spark, ["a.com", "docs.A.com", "xa.com", "a.com.b"], urls.in_domain("c", F.lit("a.com")))
    assert got == [True, True, False, False]


@pytest.mark.parametrize("space", [" ", "\n", " ", " ", "\x1c", "　"])
def test_white_space_is_pythons(spark, space):
    got = values(spark, [f"{space}a{space}{space}b{space}"], text.strip("c"), text.word_count("c"))
    assert got == [(f"a{space}{space}b", 2)]


def test_word_counts_and_tokens(spark):
    df = spark.createDataFrame([("",), (None,), ("Ab c_d é-Ü " + "x" * 40,)], "c string")
    rows = df.select(
        text.word_count("c").alias("n"), text.tokens_default("c").alias("t"), text.clean_text("c").alias("s")
    ).collect()
    assert [r.n for r in rows] == [0, 0, 4]
    assert rows[2].t == ["ab", "c", "d", "é", "ü"] and rows[1].s == ""


def test_title_keywords_are_distinct(spark):
    got = values(
        spark,
        ["The Guide: guide GUIDE faq", "", "user_guide how-to"],
        text.keyword_count_in_title("c", DOC_KEYWORDS),
    )
    assert got == [2, 0, 2]


def test_code_and_links(spark):
    df = spark.createDataFrame(
        [([" f() ", "a b"], {"u": ["x"], "v": []}), (None, None)],
        "code array<string>, links map<string,array<string>>",
    )
    rows = df.select(text.join_code("code").alias("c"), F.size(features.out_links("links")).alias("n")).collect()
    assert [tuple(r) for r in rows] == [("f()\na b", 2), ("", 0)]


STEMS = {
    "documentation": "document", "functions": "function", "classes": "class", "running": "run",
    "hopping": "hop", "hoping": "hope", "cries": "cri", "ties": "tie", "gas": "gas", "kiwis": "kiwi",
    "agreed": "agre", "luxuriated": "luxuri", "happy": "happi", "by": "by", "say": "say",
    "relational": "relat", "rational": "ration", "generously": "generous", "communism": "communism",
    "consistency": "consist", "knightly": "knight", "dying": "die", "news": "news", "flying": "fli",
    "youth": "youth", "exceeding": "exceed", "apology": "apolog",
}


def test_stems(spark):
    assert {w: stem(w) for w in STEMS} == STEMS
    df = spark.createDataFrame([(0, list(STEMS)), (1, []), (2, None), (3, [None, "docs"])], "i int, t array<string>")
    rows = df.select("i", stem_tokens("t").alias("s")).orderBy("i").collect()
    assert [r.s for r in rows] == [list(STEMS.values()), [], None, [None, "doc"]]
