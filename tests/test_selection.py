"""Selection pipeline on a hand-worked crawl file."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from siterank.operators import linkgraph
from siterank.plans import indexing
from siterank.sources import crawl as crawl_source

A = "https://a.com/"
RECORDS = [
    dict(date=100, url=A + "docs/x", title="Guide X", content="one two three", code_snippets=["f()"],
         out_links={A + "docs/y": ["Y", "Y"], A + "z": ["Z z"]}),
    dict(date=200, url=A + "docs/y", title="Y", content="one", code_snippets=[],
         out_links={A + "docs/x": ["back"]}),
    dict(date=None, url=A + "z", title="Z", content="", code_snippets=["a b", "c"], out_links={}),
    dict(date=300, url=A + "docs/x", title="Guide X", content="other", code_snippets=[],
         out_links={A + "z": ["again"]}),
]


@pytest.fixture
def crawl_dir(tmp_path):
    folder = tmp_path / "a_com"
    folder.mkdir()
    with gzip.open(folder / "a_com.crawl.gz", "wt") as f:
        f.writelines(json.dumps(r) + "\n" for r in RECORDS)
    (folder / "a_com.log").write_text("not a crawl file")
    return str(tmp_path)


def test_read_crawl(spark, crawl_dir):
    df = crawl_source.read_crawl(spark, crawl_dir)
    rows = df.orderBy("ord").collect()
    assert [r.url for r in rows] == [r["url"] for r in RECORDS]
    assert {r.crawl_domain for r in rows} == {"a.com"}
    one = crawl_source.read_crawl(spark, crawl_dir + "/a_com/a_com.crawl.gz")
    assert one.count() == 4
    assert rows[0].out_links == RECORDS[0]["out_links"]


def test_features_and_scores(spark, crawl_dir):
    crawl = crawl_source.read_crawl(spark, crawl_dir)
    rows = {r.url: r for r in indexing.scored_pages(crawl).collect()}
    x, y, z = rows[A + "docs/x"], rows[A + "docs/y"], rows[A + "z"]
    got = [
        (r.url_num_appears, r.term_in_url, r.term_in_title, r.content_len, r.code_len,
         r.out_links_len, r.num_in_urls, r.in_out_ratio)
        for r in (x, y, z)
    ]
    assert got == [(1, 1, 1, 3, 1, 2, 1, 0), (0, 1, 0, 1, 0, 1, 1, 1), (0, 0, 0, 0, 3, 0, 2, 3)]
    assert x.normalized_term_in_url == pytest.approx(0.577350, abs=1e-6)
    assert x.normalized_code_len == pytest.approx(-0.218218, abs=1e-6)
    assert z.normalized_num_in_urls == pytest.approx(1.154701, abs=1e-6)
    assert [r.importance for r in (x, y, z)] == pytest.approx([2.604922, -1.091089, -1.513833], abs=1e-6)


def test_in_links_in_chunks(spark, crawl_dir):
    edges = linkgraph.edges(crawl_source.read_crawl(spark, crawl_dir))
    rows = linkgraph.in_links(edges).collect()
    z = [r for r in rows if len(r.in_urls) == 2]
    assert [r.in_texts for r in z] == [["Z z", "again"]]
    assert sorted(t for r in rows for t in r.in_texts) == ["Y", "Z z", "again", "back"]
    chunked = linkgraph.in_links(edges, chunk_links=1).collect()
    assert len(chunked) == 4 and {len(r.in_urls) for r in chunked} == {1}


def test_top_n_then_validation(spark, crawl_dir, tmp_path):
    crawl = crawl_source.read_crawl(spark, crawl_dir)
    assert [r.url for r in indexing.select_pages(crawl, 2).orderBy("rank").collect()] == [
        A + "docs/x",
        A + "docs/y",
    ]
    assert indexing.select_pages(crawl, 3).count() == 2  # the third has no date


def test_index_run_and_rerun(spark, crawl_dir, tmp_path):
    from siterank.sources.index import read_index
    from siterank.sources.stats import read_index_stat

    crawl = crawl_source.read_crawl(spark, crawl_dir)
    path = str(tmp_path / "index")
    indexing.index_crawl(crawl, path, "first", 3)
    stat = read_index_stat(spark, path + "/index_stat")
    assert [tuple(r) for r in stat.collect()] == [("a.com", 2)]
    index = read_index(spark, path)
    docs = index.docs.filter(F.col("url") == A + "docs/x").collect()
    assert docs[0].content == "one two three" and docs[0].code == "f()"
    assert docs[0].features[:6] == [1, 1, 3, 1, 1, 0]
    links = index.postings.filter("field = 'links_texts'").collect()
    assert sorted((r.term, r.tf, tuple(r.positions), r.field_len) for r in links) == [
        ("back", 1, (0,), 1),
        ("y", 1, (0,), 1),
    ]
    indexing.index_crawl(crawl, path, "first", 3)  # a replay replaces its run
    assert read_index_stat(spark, path + "/index_stat").collect()[0].n_docs == 2
    indexing.index_crawl(crawl, path, "second", 3)  # another run is appended
    assert read_index_stat(spark, path + "/index_stat").collect()[0].n_docs == 4
    assert read_index(spark, path).docs.count() == 4
    indexing.index_crawl(crawl, path, "third", 3, stored=True, only_new=True)  # nothing is new
    assert read_index(spark, path).docs.count() == 4
    indexing.index_crawl(crawl, str(tmp_path / "other"), "first", 3, only_new=True)
    assert read_index(spark, str(tmp_path / "other")).docs.count() == 2


def test_constant_feature_makes_importance_null(spark, tmp_path):
    path = tmp_path / "b_org.crawl.gz"
    with gzip.open(path, "wt") as f:
        for i in (2, 1, 3):
            f.write(json.dumps(dict(date=i, url=f"https://b.org/{i}", title="t", content="w " * i)) + "\n")
    crawl = crawl_source.read_crawl(spark, str(path))
    rows = indexing.select_pages(crawl, 2).orderBy("rank").collect()
    assert [(r.url, r.importance, r.out_links_len) for r in rows] == [
        ("https://b.org/1", None, 0),
        ("https://b.org/2", None, 0),
    ]


def test_stream_in_one_batch_and_in_three(spark, tmp_path):
    from siterank.sources.index import read_index
    from siterank.sources.stats import read_index_stat
    from siterank.streaming.indexing import start_index_stream

    def record(domain, i, page, words, link):
        url = f"https://{domain}/docs/{page}"
        links = {f"https://{domain}/docs/{link}": [f"to {link}"]}
        return dict(date=i, url=url, title=f"T{page}", content="w " * words, code_snippets=["c " * (i % 3)],
                    out_links=links, crawl_domain=domain, ord=i)

    a = [record("a.com", i, i % 5, 1 + i % 5, (i + 1) % 4) for i in range(9)]
    b = [record("b.org", i, i, 2 * i + 1, i // 2) for i in range(4)]
    parts = [a[:4] + b[:1], a[4:6], a[6:] + b[1:]]

    def indexed(name, batches):
        crawl, index = tmp_path / name / "crawl", str(tmp_path / name / "index")
        for k, batch in enumerate(batches):
            for r in batch:
                folder = crawl / f"crawl_domain={r['crawl_domain']}"
                folder.mkdir(parents=True, exist_ok=True)
                with open(folder / f"{k}.json", "a") as f:
                    f.write(json.dumps({c: v for c, v in r.items() if c != "crawl_domain"}) + "\n")
            start_index_stream(spark, str(crawl), index, str(tmp_path / name / "log"), True, n=3,
                               importance_features=["content_len"]).awaitTermination()
        found = read_index(spark, index)
        docs = found.docs.select("crawl_domain", "url", "content", "features").collect()
        posted = found.postings.join(found.docs.select("doc_key", "url"), "doc_key")
        posted = posted.select("url", "field", "term", "tf", "positions", "field_len").collect()
        stat = read_index_stat(spark, index + "/index_stat").collect()
        return [sorted(map(repr, x)) for x in (docs, posted, found.terms.collect(), found.fields.collect(), stat)]

    one = indexed("one", [a + b])
    assert len(one[0]) == 6
    assert indexed("three", parts) == one
