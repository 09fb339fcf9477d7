"""Telemetry in batch and as streams."""

import json

from siterank.operators import telemetry
from siterank.session import scratch_path
from siterank.sources import stats
from siterank.streaming import telemetry as stream_telemetry

SHOWN = ["https://a.com/1", "https://a.com/2", "http://b.org/x"]


def frame(spark, urls):
    return spark.createDataFrame([(u,) for u in urls], "url string")


def test_domain_counts(spark):
    got = telemetry.domain_counts(frame(spark, SHOWN + ["", None, "http://h?x"])).collect()
    assert {(r.domain, r.n) for r in got} == {("a.com", 2), ("b.org", 1), ("h", 1)}


def test_latencies(spark):
    queries = spark.createDataFrame(
        [(i, i, v) for i, v in enumerate([10.0, 20.0, 60.0])], "ts long, query_id long, latency_ms double"
    ).repartition(3)
    rows = telemetry.latency_running_mean(queries).orderBy("query_id").collect()
    assert [(r.processed_queries, r.avg_latency) for r in rows] == [(1, 10), (2, 15), (3, 30)]
    assert tuple(telemetry.latency_summary(queries).first()) == (3, 30.0)


def test_summary_and_missing_stat(spark, tmp_path):
    empty = stats.read_index_stat(spark, str(tmp_path / "none"))
    assert empty.count() == 0
    stat = spark.createDataFrame([("a.com", 3), ("b.org", 5)], "domain string, n_docs long")
    merged = stats.merge_index_stat(stats.merge_index_stat(empty, stat), stat.filter("domain = 'a.com'"))
    queries = spark.createDataFrame([(1.0,), (3.0,)], "latency_ms double")
    row = telemetry.service_summary(merged, queries, frame(spark, SHOWN), frame(spark, [])).first()
    assert (row.docs_in_index, row.domains_in_index, row.processed_queries, row.avg_latency) == (11, 2, 2, 2.0)
    assert [tuple(e) for e in row.top_domains] == [("a.com", 6), ("b.org", 5)]
    assert [tuple(e) for e in row.top_showed_domains] == [("a.com", 2), ("b.org", 1)]
    assert row.top_clicked_domains == []


def test_click_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "clicks"
    folder.mkdir()
    counts, checkpoint = str(tmp_path / "counts"), scratch_path(spark, "stream")

    def post(name, urls):
        lines = [json.dumps({"url": u} if u is not None else {}) for u in urls]
        (folder / name).write_text("\n".join(lines))

    def run():
        clicks = stats.read_clicks(spark, str(folder), streaming=True)
        stream_telemetry.start_domain_counts(clicks, counts, checkpoint, True).awaitTermination()
        latest = stream_telemetry.latest_counts(spark.read.parquet(counts)).collect()
        batch = telemetry.domain_counts(stats.read_clicks(spark, str(folder))).collect()
        assert {tuple(r) for r in latest} == {tuple(r) for r in batch}
        return {tuple(r) for r in latest}

    post("1.json", [*SHOWN, "", None])
    assert run() == {("a.com", 2), ("b.org", 1)}
    post("2.json", ["https://a.com/3"])  # a restarted stream goes on from its state
    assert run() == {("a.com", 3), ("b.org", 1)}
