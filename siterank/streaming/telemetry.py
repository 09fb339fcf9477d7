"""Continuous counts over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from siterank.operators.telemetry import domain_counts
from siterank.session import scratch_path


def start_domain_counts(
    events: DataFrame, table_path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Keep ``(domain, n)`` per micro-batch in ``table_path/batch=N``.

    The state has one counter per domain, so no watermark is needed.  Every batch
    writes the domains it changed; a batch that is run again replaces its folder.
    """

    def store(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{table_path}/batch={batch_id}")

    writer = (
        domain_counts(events)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(store)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def latest_counts(counts: DataFrame) -> DataFrame:
    """Current ``(domain, n)`` from the stored changes: counters only grow."""
    return counts.groupBy("domain").agg({"n": "max"}).withColumnRenamed("max(n)", "n")


def run_domain_counts(events: DataFrame) -> DataFrame:
    """Count everything a stream has now and return the result."""
    spark = events.sparkSession
    path = scratch_path(spark, "stream-counts")
    start_domain_counts(events, path, scratch_path(spark, "stream"), True).awaitTermination()
    return latest_counts(spark.read.parquet(path))
