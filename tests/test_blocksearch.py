"""Search by pairs of blocks against the plain join of clauses and postings."""

import numpy as np
import pyarrow as pa
import pytest

from siterank.functions import snippet
from siterank.operators import blocksearch, search
from siterank.plans import searching
from siterank.session import materialize
from tests.test_search import FIELDS, tokens_of


@pytest.mark.parametrize("matches, clauses", [(1 << 20, 1 << 14), (300, 40)])
def test_blocked_top_hits_equal_top_hits(spark, monkeypatch, matches, clauses):
    """Frequent and rare terms, phrases, ties, a null key; few rows are handed on."""
    rows = [(k, "", f"common words of the w{k % 7} " + "x " * (k % 5) + f"r{k % 90}", "") for k in range(400)]
    rows += [(None, "", "common r5 words", ""), (1000, "", "the king of the hill", ""), (1001, "", "", "")]
    many = materialize(spark.createDataFrame(rows, "doc_key long, title string, content string, code string"))
    asked = [(q, "content", t, 1 + q % 3) for q in range(60) for t in ("common", "words", f"w{q % 7}", f"r{q}", "of the")]
    tokens = tokens_of(spark, [*asked, (100, "content", "king of the", 1), (101, "content", "nowhere", 1), (102, "content", "common", 0)])
    index = searching.index_of(many, tokens, FIELDS, stem=False)
    terms = materialize(index.terms)
    weighed = materialize(search.weigh_clauses(tokens, terms, index.fields))
    plain = search.bm25(search.match_clauses(weighed, index.postings, terms))
    want = sorted(map(tuple, search.top_hits(plain, 5).collect()), key=str)
    handed, block_hits = [], blocksearch.block_hits
    monkeypatch.setattr(blocksearch, "DOCUMENT_TASKS", 3)
    monkeypatch.setattr(blocksearch, "block_hits", lambda *a: handed.append(materialize(block_hits(*a))) or handed[0])
    got = blocksearch.blocked_top_hits(weighed, index.postings, terms, 5, block_matches=matches, block_clauses=clauses)
    assert sorted(map(tuple, got.collect()), key=str) == want and len(want) == 60 * 5 + 1 + 5
    # The plain join hands on every pair of a query and a document it matches.
    assert plain.count() > 20_000 and handed[0].count() <= 62 * 5 * 3


def test_run_search_never_moves_matches(spark, monkeypatch):
    """The plan of many queries does not add up matches by query and document."""
    many = spark.createDataFrame([(1, "", "common", ""), (2, "", "common w", "")], "doc_key long, title string, content string, code string")
    tokens = tokens_of(spark, [(1, "content", "common", 1), (2, "content", "w", 1)])
    index = searching.index_of(many, tokens, FIELDS, stem=False)
    monkeypatch.setattr(search, "bm25", None)
    got = searching.many_hits(tokens, index, 5).select("query_id", "rank", "doc_key").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1), (1, 2, 2), (2, 1, 2)]


@pytest.mark.parametrize("limits", [{}, {"HELD_MATCHES": 50, "FREQUENT": 2}, {"HELD_CELLS": 1}])
def test_pairs_of_blocks_equal_every_score(monkeypatch, limits):
    """The best of several blocks of documents, with ties, a null key, and gains of zero and less."""
    for name, value in limits.items():
        monkeypatch.setattr(blocksearch, name, value)
    rng = np.random.default_rng(4)
    queries, n_docs, n_kinds, n = np.arange(100, 170), 90, 40, 7
    asked = [np.sort(rng.choice(n_kinds + 5, rng.integers(1, 30), replace=False)) for _ in queries]
    gains = [rng.integers(1, 4, len(a)) / 2 - (1.0 if q % 10 == 0 else 0.0) for q, a in zip(queries, asked)]
    first = np.append(0, np.cumsum([len(a) for a in asked]))
    block = blocksearch.QueryBlock(queries, first, np.concatenate(asked), np.concatenate(gains), n)
    met = []
    for number in range(4):
        part = rng.integers(0, 3, (n_kinds, n_docs)) * (rng.random((n_kinds, 1)) > rng.random((n_kinds, n_docs))) / 4
        keys = np.arange(n_docs) * 4 + number
        null = np.zeros(n_docs, bool)
        null[0] = number == 0
        kind, at = np.nonzero(part)
        kinds, starts = np.unique(kind, return_index=True)
        lists = (n_docs, kinds, np.append(starts, len(kind)), at.astype(np.int32), part[kind, at])
        for lo, scores, matched in blocksearch.pair_scores(block, lists):
            block.meet(keys, null, scores, matched, lo)
        met.append((part, keys, null))
    got = sorted(map(str, block.hits("doc").to_pylist()))
    want = []
    for query, a, g in zip(queries.tolist(), asked, gains):
        here = a < n_kinds
        rows = []
        for part, keys, null in met:
            score, found = g[here] @ part[a[here]], (part[a[here]] > 0).any(axis=0)
            rows += [(-s, not x, k) for s, k, x in zip(score[found].tolist(), keys[found].tolist(), null[found].tolist())]
        want += [{"query_id": query, "doc": k if known else None, "score": -s} for s, known, k in sorted(rows)[:n]]
    assert got == sorted(map(str, want)) and len(got) > 400


def test_block_of_documents_is_sent_to_few_blocks_of_queries(spark):
    """30,000 clauses are one block: every block of documents goes to the workers once, not per 200 queries."""
    gains = spark.range(30_000).selectExpr("id div 75 as query_id", "id % 75 as _kind", "1D as gain")
    assert blocksearch.query_blocks(gains, blocksearch.BLOCK_CLAUSES).count() == 1


@pytest.mark.parametrize("stemmed", [True, False])
def test_snippets_of_many_hits_read_a_text_once(monkeypatch, stemmed):
    rng = np.random.default_rng(3)
    words = ["the", "Kings", "king", "hill", "<b>", "&", "x_y", "ÀÉ", "running", "İ", "\n", ".", "a" * 160]
    texts = [None, "", "...", *[" ".join(rng.choice(words, rng.integers(1, 200))) for _ in range(20)]]
    asked = ["the", "king", "kings", "hill", "àé", "run", "running", "x", "i̇", "zz", "a" * 160]
    rows = [(texts[rng.integers(len(texts))], rng.choice(asked, rng.integers(0, 6), replace=False).tolist()) for _ in range(400)]
    terms = [[{"term": t, "weight": 1 / (1 + rng.integers(1, 5))} for t in ts] if ts else None for _, ts in rows]
    want = [snippet.best_snippet(t or "", {e["term"]: e["weight"] for e in ts or []}, stemmed) for (t, _), ts in zip(rows, terms)]
    read, cut = [], snippet.Stretches
    monkeypatch.setattr(snippet, "Stretches", lambda text, *a: read.append(text) or cut(text, *a))
    kind = pa.list_(pa.struct([("term", pa.string()), ("weight", pa.float64())]))
    got = snippet.best_snippets(pa.array([t for t, _ in rows], pa.string()), pa.array(terms, kind), stemmed)
    assert got.to_pylist() == want and sum(map(bool, want)) > 100
    assert len(read) == len({t or "" for t, _ in rows}) < 25


def test_matches_add_up_in_their_block(spark):
    """Rows of one match, one per chunk of its postings, are added up where the block is made."""
    matches = spark.createDataFrame(
        [(7, 1, 2, 1.0), (7, 1, 3, 1.0), (7, None, 1, 3.0), (8, 1, 1, 1.0)], "_kind long, doc long, freq long, norm double"
    )
    row = blocksearch.document_blocks(matches, "doc", 1).first()
    assert np.frombuffer(row["_docs"], np.int64).tolist() == [0, 1] and row["_null"]
    assert np.frombuffer(row["_starts"], np.int64).tolist() == [0, 2, 3]
    assert np.frombuffer(row["_part"]).tolist() == [0.25, 5 / 6, 0.5]
    clauses = spark.createDataFrame([(7, "f", "a"), (8, "f", "a"), (8, "f", "b")], "query_id long, field string, term string")
    terms = spark.createDataFrame([("f", "a", 100), ("f", "b", 10)], "field string, term string, df long")
    assert blocksearch.expected_blocks(clauses, terms, 20) == 6  # 100 matches of the one, 10 of the phrase


def test_a_text_is_analysed_once_for_all_fields(spark):
    clauses = spark.createDataFrame(
        [(1, 0, None, "running", 1.0), (1, 1, "title", "running", 2.0), (1, 2, "other", "running", 4.0), (1, 3, None, "x-y", 1.0)],
        "query_id long, seq int, field string, text string, boost double",
    )
    tokens = search.clause_tokens(clauses, {"title": True, "content": True, "code": False})
    plan = tokens._jdf.queryExecution().optimizedPlan().toString()
    # The fields of a text are listed after it is cut into tokens and stemmed.
    assert plan.index("Generate inline") < plan.index("ArrowEvalPython") < plan.index("collect_list")
    got = {(r["field"], r["i"], r["term"]): (r["clause"], r["n_tokens"], r["weight"]) for r in tokens.collect()}
    assert got[("title", 0, "run")] == (1, 1, 3.0) and got[("content", 0, "run")] == (2, 1, 1.0)
    assert got[("code", 0, "running")] == (3, 1, 1.0) and got[("other", 0, "running")] == (6, 1, 4.0)
    assert {k for k in got if k[2] in "xy"} == {(f, i, t) for f in ("title", "content", "code") for i, t in enumerate("xy")}
