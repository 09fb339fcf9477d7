"""Page extraction, crawl datasets and the frontier."""

import gzip
import json
import time

import pytest
from pyspark.sql import functions as F

from siterank.functions import html
from siterank.functions.html import parse_page
from siterank.operators import features, frontier, pages
from siterank.session import materialize
from siterank.sources import crawl as crawl_source

HTML = """<html><head><title> T &amp; U </title></head><body>
<nav><a href="/nav">see
 docs</a></nav><article><h1>Head</h1><p>One <code> a <b>x</b> c </code><p>two
lines<script>skip()</script></article>
<a href="https://docs.a.com/p?b=2&amp;a=1#top">to <i>docs</i></a><a href='/nav'>again</a>
<a href="http://other.org/">out</a><a href="/file.pdf">pdf</a><a>no link</a><footer>foot</footer></body></html>"""


def test_parse_page():
    page = parse_page(HTML)
    assert page["title"] == " T & U " and page["snippets"] == ["a", "c"]
    assert page["content"] == "Head\nOne a x c\ntwo\nlines"
    assert [link["href"] for link in page["links"]][:2] == ["/nav", "https://docs.a.com/p?b=2&a=1#top"]
    assert parse_page("<p>only body") ["content"] == "only body"
    assert parse_page(None)["title"] is None


def test_crawl_records(spark):
    rows = [
        (1, "http://www.a.com/Start?x", HTML, "text/html; charset=utf-8", "Wed, 21 Oct 2015 07:28:00 GMT", None),
        (2, "http://a.com/none", "<p>no title", "text/html", None, None),
        (3, "http://a.com/pdf", HTML, "application/pdf", None, None),
        (4, "http://a.com/bad-date", "<title>x</title>", "text/html", "yesterday", "Wed, 21 Oct 2015 07:28:00 GMT"),
        (5, "http://a.com/date", "<title>x</title>", "text/html", "", "Wed, 21 Oct 2015 07:28:00 GMT"),
    ]
    df = spark.createDataFrame(
        rows, "id long, url string, html string, content_type string, last_modified string, date_header string"
    )
    got = {r.ord: r for r in pages.crawl_records(df, F.lit("a.com"), F.col("id")).collect()}
    assert sorted(got) == [1, 4, 5]  # no title and wrong type give no record
    first = got[1]
    assert (first.url, first.title, first.date) == ("http://www.a.com/Start?x=", "T & U", 1445412480)
    assert first.code_snippets == ["a", "c"]
    assert first.out_links == {
        "http://www.a.com/nav": ["see docs", "again"],
        "https://docs.a.com/p?a=1&b=2": ["to docs top"],
    }
    assert got[4].date is None and got[5].date == 1445412480
    assert pages.crawl_records(df, F.lit("a.com"), F.col("id"), require_title=False).count() == 4


def test_expressions_agree_with_the_parser(spark):
    df = spark.createDataFrame([(1, "http://a.com/", HTML)], "page_id long, url string, html string")
    links = pages.extract_links(df, domain=F.lit("a.com"))
    assert sorted((r.dst, r.text) for r in links.collect()) == [
        ("http://a.com/nav", "again"),
        ("http://a.com/nav", "see docs"),
        ("https://docs.a.com/p?amp%3Ba=1&b=2", "to docs top"),  # entities stay in this form
    ]
    grouped = pages.group_links(links).collect()[0].out_links
    assert grouped["http://a.com/nav"] == ["again", "see docs"]
    row = df.select(pages.extract_title("html").alias("t"), pages.extract_tag_texts("html").alias("c")).first()
    assert row.t == "T &amp; U" and row.c == ["a"]


def test_crawl_dataset_roundtrip(spark, tmp_path):
    df = spark.createDataFrame(
        [(i, f"http://{d}/{i}", "<title>t</title><a href='/x'>y</a>", d) for i, d in enumerate(["a.com"] * 5 + ["b.org"])],
        "id long, url string, html string, domain string",
    )
    records = pages.crawl_records(df, F.col("domain"), F.col("id"))
    path = str(tmp_path / "crawl")
    crawl_source.write_crawl(records, path)
    back = crawl_source.read_crawl(spark, path, layout="dataset")
    key = lambda r: r.ord
    want = sorted(records.collect(), key=key)
    got = sorted(back.select(*records.columns).collect(), key=key)
    assert got == want
    assert {r.crawl_file for r in back.collect()} == {"a.com", "b.org"}


def test_seeds_and_start_urls(spark, tmp_path):
    (tmp_path / "seeds.txt").write_text("a.com\n\n  b.org \n")
    seeds = crawl_source.read_seeds(spark, str(tmp_path / "seeds.txt"))
    candidates = frontier.start_candidates(seeds)
    assert candidates.count() == 2 * 46
    first = candidates.filter("domain = 'a.com'").orderBy("ord").limit(2).collect()
    assert [r.candidate for r in first] == ["https://doc.a.com", "https://a.com/doc"]
    probes = spark.createDataFrame(
        [("https://doc.a.com", 404, "x"), ("https://a.com/guide", 200, "https://a.com/guide/"), ("https://docs.a.com", 200, "https://docs.a.com/")],
        "candidate string, status int, url string",
    )
    domains = spark.createDataFrame(
        [("a.com", 200, "https://a.com/"), ("b.org", 200, "https://b.org/home"), ("c.net", 503, "https://c.net")],
        "domain string, status int, url string",
    )
    got = frontier.select_start(domains, candidates, probes).collect()
    assert {(r.domain, r.start_url) for r in got} == {("a.com", "https://docs.a.com/"), ("b.org", "https://b.org/home")}


def test_next_frontier(spark):
    links = spark.createDataFrame(
        [("a.com", f"https://a.com/{p}") for p in ["x", "docs", "docs", "seen", "docs/guide", "y"]],
        "domain string, url string",
    )
    crawled = spark.createDataFrame([("a.com", "https://a.com/seen")], "domain string, url string")
    got = frontier.next_frontier(links, crawled, 3).orderBy("rank").collect()
    assert [(r.url[14:], r.priority) for r in got] == [("docs/guide", 2), ("docs", 1), ("x", 0)]


@pytest.mark.parametrize(
    "page, content",
    [
        ("<html><head><title>t</title><body><p>hello world</p></body></html>", "hello world"),
        ("<title>t</title><p>para", "para"),
        ("<body><form><p>all of it</p></form></body>", "all of it"),
        ("<body><nav><a href='/x'>x</a><article><p>the text</p></article>", "the text"),
        ("<body><nav>menu<header>top</header><main>body text</main>", "body text"),
        ("<p>before</p><![foo[ x ]]><p>after</p>", None),
    ],
)
def test_content_of_untidy_pages(page, content):
    found = html.parse_page(page)["content"]
    assert found == content if content is not None else found.startswith("before")


def test_unclosed_tags_cost_linear_time():
    start = time.perf_counter()
    html.parse_page("<b><i>x" * 100_000)
    assert time.perf_counter() - start < 10


def test_crawl_files_keep_their_order_when_parallelism_changes(spark, tmp_path):
    for f in range(6):
        with gzip.open(tmp_path / f"site{f}_com.crawl.gz", "wt") as out:
            for i in range(9):
                record = {"url": f"http://site{f}.com/{i}", "date": 1, "title": f"t{i}", "content": f"text {f} {i}", "code_snippets": [], "out_links": {}}
                out.write(json.dumps(record) + "\n")
    option = "spark.sql.leafNodeDefaultParallelism"
    try:
        spark.conf.set(option, "1")
        crawl = crawl_source.read_crawl(spark, str(tmp_path), layout="files")
        selected = features.document_features(crawl).select("crawl_file", "ord", "url")
        selected = materialize(selected)
        spark.conf.set(option, "8")
        found = features.with_bodies(selected, crawl).select("url", "content").collect()
    finally:
        spark.conf.unset(option)
    assert sorted(tuple(r) for r in found) == sorted((f"http://site{f}.com/{i}", f"text {f} {i}") for f in range(6) for i in range(9))
    in_file = crawl.orderBy("crawl_file", "ord").select("crawl_domain", "url").collect()
    assert [tuple(r) for r in in_file] == [(f"site{f}.com", f"http://site{f}.com/{i}") for f in range(6) for i in range(9)]


def test_pages_are_parsed_in_slices_of_bounded_bytes():
    import pyarrow as pa

    from siterank.functions.html import page_slices

    html = ["a" * 30, None, "b" * 80, "", "c" * 500, "é" * 20]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(html)], names=["page_id", "html"])
    slices = [s.column(1).to_pylist() for s in page_slices(batch, 1, size=100)]
    assert slices == [html[:2], html[2:4], html[4:5], html[5:]]
    assert [s.num_rows for s in page_slices(batch.slice(0, 0), 1)] == [0]
