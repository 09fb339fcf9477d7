"""Index statistics and click records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siterank.schemas import CLICK, INDEX_STAT


def merge_index_stat(old: DataFrame, new: DataFrame) -> DataFrame:
    """Documents per domain of both, added up."""
    return (
        old.unionByName(new).groupBy("domain").agg(F.sum("n_docs").cast("bigint").alias("n_docs"))
    )


def write_index_stat(stat: DataFrame, path: str) -> None:
    """One run's documents per domain; replaying the run replaces them."""
    stat.select("domain", "n_docs").write.mode("overwrite").json(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system it names."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath)


def read_index_stat(spark: SparkSession, path: str) -> DataFrame:
    """``(domain, n_docs)`` over all runs below ``path``; empty when there is none."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], INDEX_STAT)
    runs = spark.read.schema(INDEX_STAT).option("recursiveFileLookup", "true").json(path)
    return runs.groupBy("domain").agg(F.sum("n_docs").cast("bigint").alias("n_docs"))


def valid_clicks(clicks: DataFrame) -> DataFrame:
    """Clicks that name a URL."""
    return clicks.filter(F.col("url").isNotNull() & (F.col("url") != ""))


def read_clicks(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Click posts from JSON-lines files, as a batch or as a stream."""
    reader = spark.readStream if streaming else spark.read
    return valid_clicks(reader.schema(CLICK).json(path))
