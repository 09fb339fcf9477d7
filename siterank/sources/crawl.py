"""Crawl files, crawl datasets and seed lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siterank.functions.text import strip
from siterank.schemas import CRAWL_DATASET, CRAWL_RECORD
from siterank.session import materialize

CRAWL_SUFFIX = ".crawl.gz"


def domain_of_file(file_name: Column) -> Column:
    """``a_com.crawl.gz`` -> ``a.com``."""
    return F.replace(F.substring_index(file_name, ".", 1), F.lit("_"), F.lit("."))


def read_crawl(spark: SparkSession, path: str, layout: str = "files") -> DataFrame:
    """Crawl records with ``crawl_file``, ``crawl_domain`` and their order ``ord``.

    ``layout="files"``: one ``*.crawl.gz`` file, or all of them below a folder.  They are
    read once and stored: a number of a row depends on how Spark packs the files into
    partitions, so it must not be made anew by a later scan.
    ``layout="dataset"``: what ``write_crawl`` wrote; the domain is the file.
    """
    if layout == "dataset":
        df = spark.read.schema(CRAWL_DATASET).json(path)
        return df.withColumn("crawl_file", F.col("crawl_domain"))
    reader = spark.read.schema(CRAWL_RECORD)
    if not path.endswith(CRAWL_SUFFIX):
        reader = reader.option("recursiveFileLookup", "true").option(
            "pathGlobFilter", f"*{CRAWL_SUFFIX}"
        )
    scan = reader.json(path).withColumn("_file", F.col("_metadata"))
    return materialize(with_input_order(with_crawl_domain(scan)))


def with_crawl_domain(df: DataFrame) -> DataFrame:
    """File and domain of every record of a fresh scan."""
    return df.withColumn("crawl_file", F.col("_file.file_path")).withColumn(
        "crawl_domain", domain_of_file(F.col("_file.file_name"))
    ).drop("_file")


def with_input_order(df: DataFrame) -> DataFrame:
    """Order within a file: a gzip file is never split, so ids rise line by line.

    The ids hold for one scan only; store the result before it is joined with itself.
    """
    return df.withColumn("ord", F.monotonically_increasing_id())


def write_crawl(records: DataFrame, path: str) -> None:
    """Append records as gzipped JSON lines, one folder per crawled domain.

    The rebalance hint gathers small domains into few files and splits large ones.
    """
    (
        records.hint("rebalance", "crawl_domain")
        .write.mode("append")
        .option("compression", "gzip")
        .partitionBy("crawl_domain")
        .json(path)
    )


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """``(domain)``: one per non-empty line."""
    return spark.read.text(path).select(strip("value").alias("domain")).filter("domain <> ''")
