"""Tables in the shared folder."""

from pathlib import Path

from siterank.plans import indexing
from siterank.session import materialize, scratch_path
from siterank.sources.index import read_index


def test_shuffle_files_of_a_written_table_are_deleted(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return blocks.getAllFiles().size()

    before = files()
    table = materialize(spark.range(1000).repartition(7, "id"))
    assert files() <= before
    assert table.count() == 1000 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_tables_of_a_run_go_once_it_is_written(spark, monkeypatch):
    """The crawl and the postings in between are deleted; the index and a crawl of the caller stay."""
    schema = (
        "crawl_file string, crawl_domain string, ord long, date long, url string, title string, content string,"
        " code_snippets array<string>, out_links map<string,array<string>>"
    )
    rows = [("a", "a", i, i, f"https://a/{i}", "T", "some words", ["c"], {"https://a/0": ["zero"]}) for i in range(9)]
    crawl, path, dropped, drop = materialize(spark.createDataFrame(rows, schema)), scratch_path(spark, "index"), [], indexing.drop_table

    def folder(df):
        return Path(df.inputFiles()[0].replace("file://", "")).parent

    monkeypatch.setattr(indexing, "drop_table", lambda df: dropped.append(folder(df)) or drop(df))
    indexing.index_crawl(crawl, path, "all", importance_features=["content_len"])
    assert len(dropped) == 2 and not any(d.exists() for d in dropped) and folder(crawl).exists()
    index = read_index(spark, path)
    assert index.docs.count() == 9 and index.postings.filter("field = 'links_texts' and term = 'zero'").count() == 1
    indexing.index_crawl(crawl, path, "more", stored=True, importance_features=["content_len"])
    assert len(dropped) == 3 and folder(crawl).exists() and read_index(spark, path).docs.count() == 18
