"""The search index: plain parquet tables, one folder per run.

A run is written with overwrite into its own folder, so appending is a new run and
a replayed run replaces itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siterank.session import released_shuffles

STORED_COLUMNS = ["doc_key", "doc_id", "date", "url", "title", "content", "code", "features"]

TABLES = ["search_docs", "postings", "term_stats", "field_stats", "index_stat"]

#: Postings are stored in this many folders per field, by a hash of the term.  Every
#: run of an index must use the same number: readers compute the bucket of a term.
POSTING_BUCKETS = 64


def term_bucket(term: Column | str, buckets: int = POSTING_BUCKETS) -> Column:
    """The folder of a term's postings; searches carry it so that Spark prunes the others."""
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


@dataclass
class SearchIndex:
    """``docs`` (stored columns), ``postings``, ``terms`` and ``fields`` statistics."""

    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    fields: DataFrame


def run_path(index_path: str, table: str, run: str) -> str:
    return f"{index_path}/{table}/run={run}"


def write_search_docs(docs: DataFrame, index_path: str, run: str) -> None:
    """Stored columns of the search documents; link texts are searched, not stored."""
    columns = [c for c in [*STORED_COLUMNS, "crawl_domain"] if c in docs.columns]
    docs.select(*columns).write.mode("overwrite").parquet(run_path(index_path, "search_docs", run))


def hadoop_folder(spark: SparkSession, path: str):
    """A folder and the store it is in."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_runs(spark: SparkSession, index_path: str, runs: list[str]) -> None:
    """Remove runs that another takes the place of, as far as they are there."""
    for table in TABLES:
        for run in runs:
            folder, store = hadoop_folder(spark, run_path(index_path, table, run))
            store.delete(folder, True)


def not_indexed(pages: DataFrame, index_path: str, run: str) -> DataFrame:
    """Pages that no other run has under the same crawl domain and URL."""
    spark = pages.sparkSession
    folder, store = hadoop_folder(spark, f"{index_path}/search_docs")
    if not store.exists(folder) or not len(store.listStatus(folder)):
        return pages
    known = spark.read.parquet(f"{index_path}/search_docs").filter(F.col("run").cast("string") != run)
    return pages.join(known.select("crawl_domain", "url"), ["crawl_domain", "url"], "left_anti")


def write_postings(postings: DataFrame, index_path: str, run: str, key: str = "doc_key") -> None:
    """Postings in term order, in folders by field and term bucket.

    A search joins on the bucket too, so Spark reads only the folders of the asked
    terms (dynamic partition pruning).  A task writes a range of buckets and terms,
    few files each; the document is part of the range, so a frequent term fills
    several files of its bucket.
    """
    order = ["field", "bucket", "term", key]
    placed = postings.withColumn("bucket", term_bucket("term")).repartitionByRange(*order).sortWithinPartitions(*order)
    with released_shuffles(postings.sparkSession):
        placed.write.mode("overwrite").partitionBy("field", "bucket").parquet(run_path(index_path, "postings", run))


def write_stats(stats: DataFrame, index_path: str, table: str, run: str) -> None:
    stats.write.mode("overwrite").parquet(run_path(index_path, table, run))


def read_index(spark: SparkSession, index_path: str) -> SearchIndex:
    """All runs of an index, statistics added up."""

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{index_path}/{name}")

    return SearchIndex(
        docs=table("search_docs"),
        postings=table("postings"),
        terms=table("term_stats").groupBy("field", "term").agg(F.sum("df").alias("df")),
        fields=table("field_stats")
        .groupBy("field")
        .agg(F.sum("n_docs").alias("n_docs"), F.sum("total_len").alias("total_len")),
    )
