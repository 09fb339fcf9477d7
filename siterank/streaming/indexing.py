"""Incremental indexing: every micro-batch of crawl records renews the crawl files it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siterank.plans.indexing import index_crawl
from siterank.schemas import CRAWL_DATASET
from siterank.session import materialize, scratch_path
from siterank.sources.index import drop_runs


def connected_batches(spark: SparkSession, records_path: str, batch_id: int) -> list[int]:
    """Batches up to this one that share crawl files with it, directly or through others."""
    stored = spark.read.parquet(records_path).filter(F.col("batch") <= batch_id)
    held = materialize(stored.select("batch", "crawl_file").distinct())
    found, more = [], [batch_id]
    while len(more) > len(found):
        found = more
        files = held.filter(F.col("batch").isin(found)).select("crawl_file").distinct()
        near = held.join(files, "crawl_file", "left_semi").select("batch").distinct()
        more = sorted({batch_id, *(r["batch"] for r in near.collect())})
    return found


def start_index_stream(
    spark: SparkSession,
    crawl_path: str,
    index_path: str,
    checkpoint: str,
    available_now: bool = False,
    **options,
) -> StreamingQuery:
    """Index crawl records as they are written to a crawl dataset.

    All records are kept in a table beside the index, a folder per batch.  A batch selects
    anew among all records of the crawl files it touches, so the index is that of one
    batch with all records.  A run of the index is replaced as a whole: the run of a batch
    takes in the runs it shares crawl files with, and these are removed.  What they are
    follows from the stored records, so a batch that is run again after a failure does
    the same again.  An index belongs to one checkpoint.
    """

    def index_batch(records: DataFrame, batch_id: int) -> None:
        session, records_path = records.sparkSession, f"{index_path}/crawl_records"
        crawl = records.withColumn("crawl_file", F.col("crawl_domain"))
        crawl.write.mode("overwrite").parquet(f"{records_path}/batch={batch_id}")
        batches = connected_batches(session, records_path, batch_id)
        paths = [f"{records_path}/batch={b}" for b in batches]
        crawl = session.read.schema(crawl.schema).parquet(*paths)
        drop_runs(session, index_path, [f"batch-{b}" for b in batches if b != batch_id])
        index_crawl(crawl, index_path, f"batch-{batch_id}", **{**options, "stored": True})

    records = spark.readStream.schema(CRAWL_DATASET).json(crawl_path)
    writer = records.writeStream.option("checkpointLocation", checkpoint).foreachBatch(index_batch)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def run_index_stream(spark: SparkSession, crawl_path: str, index_path: str, **options) -> None:
    """Index all records there are now."""
    start_index_stream(
        spark, crawl_path, index_path, scratch_path(spark, "stream"), True, **options
    ).awaitTermination()
