"""What a task of the suffix-array dedup holds at once does not grow with its batches."""

import random
import tracemalloc

import numpy as np

from siterank.llm import suffixes


def test_tasks_work_on_small_slices(spark, monkeypatch, tmp_path):
    r = random.Random(3)
    word = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    shared = [" ".join(r.choice(word) for _ in range(110)) for _ in range(1000)]
    # Every passage stands in three texts, cut or with a changed end: fragments that differ.
    texts = [f"{i} {shared[i % 1000][i % 7 :]} {r.random()}" for i in range(3000)]
    log, anchors, starts, per_slice = str(tmp_path / "log"), suffixes.anchors, suffixes.repeated_starts, suffixes.per_slice

    def note(kind, n):
        with open(log, "a") as f:
            f.write(f"{kind} {n}\n")

    def noted_anchors(data, offsets, length):
        note("anchors", len(data))
        return anchors(data, offsets, length)

    def noted_starts(groups, length):
        note("sorted", sum(len(f) for g in groups for f in g))
        return starts(groups, length)

    def noted_slices(batch, *most):
        note("rows", batch.num_rows)
        return per_slice(batch, *most)

    monkeypatch.setattr(suffixes, "anchors", noted_anchors)
    monkeypatch.setattr(suffixes, "repeated_starts", noted_starts)
    monkeypatch.setattr(suffixes, "per_slice", noted_slices)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    out = suffixes.deduplicate(rows)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    assert out.count() == 3000 and out.filter("n_removed > 0").count() == 3000
    most = {"anchors": 0, "sorted": 0, "rows": 0}
    for line in open(log):
        kind, n = line.split()
        most[kind] = max(most[kind], int(n))
    assert 0 < most["rows"] <= 1000
    assert 0 < most["anchors"] <= 1 << 19
    # Groups are whole: the last one may pass the bound.
    assert 0 < most["sorted"] <= (1 << 20) + 32_000


def test_suffix_arrays_take_few_bytes_per_symbol():
    r = np.random.default_rng(5)
    fragments = [bytes(r.integers(97, 105, 1000, np.uint8)) for _ in range(400)]
    groups = [[f, f[10:]] for f in fragments]
    tracemalloc.start()
    found = suffixes.repeated_starts(groups, 400)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [len(x) for x in found[0]] == [591, 591]
    assert peak < 85 * sum(len(f) for g in groups for f in g)
