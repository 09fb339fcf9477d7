"""Parquet tables as input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Below this size per core a table is small enough to be moved at no real cost.
SPREAD_BYTES_PER_CORE = 16 * 1024 * 1024


def path_bytes(spark: SparkSession, path: str) -> int:
    """Length of the files below a path, on whatever file system it names."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(jpath).getLength()


def read_parquet(
    spark: SparkSession, path: str, spread_by: str | None = None, schema: StructType | None = None
) -> DataFrame:
    """A parquet table, for work that is heavy per row spread over the cores.

    A file of one row group is one task however many cores there are.  Only a table
    that is small for the number of cores is shuffled by ``spread_by``; a large scan
    has tasks enough and is left as it is.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if spread_by is None or path_bytes(spark, path) > cores * SPREAD_BYTES_PER_CORE:
        return df
    return df.repartition(cores, spread_by)
