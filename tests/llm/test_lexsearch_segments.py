"""Segments of the block search: bounds, skipping and the merge of all segments."""

import random

import numpy as np

from siterank.llm import lexsearch
from siterank.session import settings_of
from tests.llm.test_round3_operators import brute_search


def test_bounds_hold_and_no_best_document_is_skipped():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 30, 150)
    codes = np.concatenate([rng.choice(80, s, replace=False) for s in sizes])
    codes = np.concatenate([codes, np.arange(80)])
    sizes = np.append(sizes, 80)
    cs = (10 ** rng.uniform(0, 6, len(codes))).astype(np.int64)
    segment = lexsearch.Segment(sizes, [str(i) for i in range(80)], codes, cs, 4, 3)
    dense = np.zeros((len(sizes), 80), np.int64)
    dense[np.repeat(np.arange(len(sizes)), sizes), codes] = cs
    skipped = 0
    for _ in range(40):
        ts = rng.choice(80, 6, replace=False)
        qs = rng.integers(1, 4, 6)
        exact = dense[:, ts] @ qs
        blocks, bound = segment.bounds(ts, qs)
        for b, most in zip(blocks, bound):
            members = segment.doc[segment.start[b] : segment.start[b] + segment.size[b]]
            assert len(members) <= 4 and exact[members].max() <= most
        docs, scores = segment.best(ts, qs, 5, 2)
        skipped += (exact > 0).sum() - len(docs)
        assert (exact[docs] == scores).all()
        assert sorted(scores)[-5:] == sorted(exact)[-5:]
    assert skipped > 0


def test_search_over_many_segments_and_rows_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexsearch, "SEGMENT", 40)
    monkeypatch.setattr(lexsearch, "ITEMS", 2)
    monkeypatch.setattr(lexsearch, "ASKED_BITS", 3)
    rng = random.Random(4)
    words = [f"W{i}" for i in range(30)] + ["é", "日本", "x\x7fy", "_a"]
    docs = [(i % 140 if i % 9 else None, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(160)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 8)))) for i in range(9)] + [(9, ""), (10, "w1")]
    d = spark.createDataFrame(docs, "doc_id int, text string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    with settings_of(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "16"}):
        got = [tuple(r) for r in lexsearch.search(d, q, k=4, block_docs=3, top=2, seed_blocks=1).collect()]
        contrib = lexsearch.weights(d, q)
        rows = lexsearch.segments(contrib, 40).collect()
    assert sorted(got, key=lambda r: (r[0], r[1])) == brute_search(docs, items, 4)
    assert len(rows) > 20 and all(sum(r.sizes) == len(r.codes) == len(r.cs) and len(r.sizes) == len(r.doc_ids) for r in rows)
    assert sum(len(r.codes) for r in rows) == contrib.count()


def test_search_without_documents_or_items(spark):
    docs = spark.createDataFrame([(1, None), (2, "..."), (3, "")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexsearch.search(docs, items).count() == 0
    assert lexsearch.search(items.toDF("doc_id", "text"), items.limit(0)).count() == 0
