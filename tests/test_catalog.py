"""Every bound query against its SQL on the smallest sample tables."""

import math
import os

import duckdb
import pytest

from siterank import catalog
from siterank.catalog import QUERIES
from siterank.catalog_sql import SQL

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no sample tables")
NO_SQL = {"search_snippets", "stemmed_search", "indexed_page_search"}


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{FOLDER}/{file}'")
    return con


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def test_every_query_has_sql_or_is_known_not_to():
    assert set(QUERIES) - set(SQL) == NO_SQL
    assert not set(SQL) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, tables, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = [tuple(map(cell, r)) for r in df.select(*columns).collect()]
    want = tables.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    assert sorted(map(repr, got)) == sorted(repr(tuple(map(cell, r))) for r in want)


@pytest.mark.parametrize("name", sorted(NO_SQL))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_index_of_documents_has_all_of_them(spark, tmp_path):
    """A source of more pages than the default limit per crawl file is indexed whole."""
    n = 10_040
    docs = [(i, f"Title {i % 7}\nsome words (x)", ("en", "fr")[i % 2], "big" if i < n else "small", 20) for i in range(n + 60)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(map(tuple, QUERIES["indexed_document_stats"](spark, str(tmp_path)).select("term", "df").collect()))
    assert got == sorted(con.execute(f"SELECT term, df FROM ({SQL['indexed_document_stats']})").fetchall())
    index = catalog.index_source.read_index(spark, catalog.index_documents(spark, str(tmp_path)))
    assert index.docs.count() == len(docs)
