"""Batch search against brute force and on hand-worked cases."""

import math
import re

import pytest
from pyspark.sql import functions as F

from siterank.functions.snippet import best_snippet
from siterank.operators import postings, search
from siterank.operators.queryprep import Dictionaries
from siterank.plans import indexing, searching
from siterank.session import materialize
from siterank.sources.index import SearchIndex

TEXTS = {
    1: ("Alpha", "the quick brown fox jumps over the lazy dog"),
    2: ("Beta", "the dog barks and the dog runs"),
    3: ("Beta", "quick quick fox, the brown fox"),
    4: ("Gamma", "nothing to see"),
    5: ("Delta", ""),
}
FIELDS = {"title": False, "content": False}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, f"https://x.org/{k}", t, c, "") for k, (t, c) in TEXTS.items()]
    return materialize(
        spark.createDataFrame(rows, "doc_key long, url string, title string, content string, code string")
    )


def tokens_of(spark, clauses, fields=FIELDS, stem=False):
    df = spark.createDataFrame(
        [(q, i, f, t, float(b)) for i, (q, f, t, b) in enumerate(clauses)],
        "query_id long, seq int, field string, text string, boost double",
    )
    return materialize(search.clause_tokens(df, fields, stem))


def brute_force(clauses):
    """BM25 of all clauses for all documents."""
    split = {(k, f): re.findall(r"\w+", v[i].lower()) for k, v in TEXTS.items() for i, f in enumerate(FIELDS)}
    n = len(TEXTS)
    scores = {}
    for q, field, phrase, boost in clauses:
        want = re.findall(r"\w+", phrase.lower())
        for f in [field] if field else FIELDS:
            idf = 0.0
            for term in want:
                df = sum(term in split[k, f] for k in TEXTS)
                idf += math.log(1 + (n - df + 0.5) / (df + 0.5))
            mean = sum(len(split[k, f]) for k in TEXTS) / n
            for k in TEXTS:
                words = split[k, f]
                tf = sum(words[i : i + len(want)] == want for i in range(len(words)))
                if tf:
                    part = boost * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))
                    scores[q, k] = scores.get((q, k), 0.0) + part
    return scores


CLAUSES = [
    (1, None, "dog", 1),
    (1, None, "dog", 1),  # repeated: twice the weight
    (1, "title", "beta", 2),
    (2, "content", "brown fox", 4),
    (2, None, "quick", 1),
    (3, None, "missing", 1),
    (3, "content", "the missing", 1),
]


@pytest.mark.parametrize("skew", [{}, {"broadcast_bytes": -1, "share": 0.05, "min_rows": 1}])
def test_bm25_equals_brute_force(spark, docs, skew):
    tokens = tokens_of(spark, CLAUSES)
    index = searching.index_of(docs, tokens, FIELDS, stem=False)
    got = {(r.query_id, r.doc_key): r.score for r in searching.scores(tokens, index, **skew).collect()}
    want = brute_force(CLAUSES)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)


def test_phrases_and_chunks(spark, docs):
    """A phrase is found wherever the chunks of a long text end."""
    tokens = tokens_of(spark, [(1, "content", "brown fox", 1), (2, "content", "quick quick", 1), (3, "content", "the", 1)])
    analysed = postings.field_tokens(docs, {"content": False}, stem=False)
    places = analysed.select("doc_key", "field", F.posexplode("tokens").alias("pos", "term"))
    lengths = postings.link_lengths(places)
    rows = materialize(postings.link_postings(places, lengths, chunk_tokens=2))
    assert rows.agg(F.max("chunk")).first()[0] > 2
    terms = materialize(postings.term_stats(rows))
    assert terms.filter("term = 'the'").first().df == 3
    weighed = materialize(search.weigh_clauses(tokens, terms, postings.field_stats(analysed)))
    got = search.match_clauses(weighed, rows, terms).collect()
    assert {(r.query_id, r.doc_key, r.freq) for r in got} == {
        (1, 1, 1), (1, 3, 1), (2, 3, 1), (3, 1, 2), (3, 2, 2), (3, 3, 1),
    }


def test_long_tokens_leave_a_gap(spark):
    docs = spark.createDataFrame([(1, f"aa {'x' * 40} bb cc")], "doc_key long, content string")
    analysed = postings.field_tokens(docs, {"content": False}, stem=False)
    rows = postings.document_postings(analysed).orderBy("term").collect()
    assert [(r.positions, r.term, r.field_len) for r in rows] == [([0], "aa", 3), ([2], "bb", 3), ([3], "cc", 3)]


def test_link_postings_equal_the_postings_of_the_joined_text(spark):
    texts = {1: ["see docs", "docs", "home docs see"], 2: ["home"], 3: [""]}
    anchors = spark.createDataFrame(
        [(k, f"https://x/{i}", i, t) for k, ts in texts.items() for i, t in enumerate(ts)],
        "doc_key long, src_url string, ord long, text string",
    ).repartition(3)
    joined = spark.createDataFrame([(k, " ".join(ts)) for k, ts in texts.items()], "doc_key long, links_texts string")
    analysed = postings.field_tokens(joined, {"links_texts": True})
    want = postings.document_postings(analysed)
    rows = postings.link_tokens(anchors)
    got = postings.link_postings(rows, postings.link_lengths(rows)).select(want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {(r.term, r.df) for r in postings.term_stats(want).collect()} == {("see", 1), ("doc", 1), ("home", 2)}


def ranked(spark, titles):
    return spark.createDataFrame(
        [(1, i + 1, t) for i, t in enumerate(titles)], "query_id long, rank int, title string"
    )


@pytest.mark.parametrize("titles, want", [("AABC", ["A", "B"]), ("AAAA", ["A"])])
def test_title_dedupe(spark, titles, want):
    hits = search.limit_per_query(search.dedupe_titles(ranked(spark, titles)), 2)
    assert [r.title for r in hits.orderBy("rank").collect()] == want


def test_stemmed_search_finds_other_forms(spark, docs):
    fields = {"content": True}
    tokens = tokens_of(spark, [(1, "content", "dogs jumping", 1), (2, "content", "barked", 1)], fields, stem=True)
    index = searching.index_of(docs, tokens, fields, stem=True)
    got = {(r.query_id, r.doc_key) for r in searching.scores(tokens, index).collect()}
    assert got == {(2, 2)}  # "dogs jumping" is a phrase, "dog" and "jumps" are apart


def test_snippet():
    words = {"fox": 0.5, "dog": 0.2}
    assert best_snippet("A <fox> & a dog.", words, False) == "A &lt;<b>fox</b>&gt; &amp; a <b>dog</b>"
    assert best_snippet("nothing", words, False) == ""
    text = "dog " + "x " * 100 + "fox end"
    assert best_snippet(text, words, False).endswith("<b>fox</b> end")
    assert len(best_snippet("fox " * 100, words, False).replace("<b>", "").replace("</b>", "")) <= 150
    assert best_snippet("Foxes", {"fox": 1.0}, True) == "<b>Foxes</b>"


def test_run_search(spark, docs):
    """Whole path: equal queries share a search, empty ones drop, titles are unique."""
    rows = indexing.posting_rows(docs)
    stored = materialize(rows)
    index = SearchIndex(docs, stored, postings.term_stats(stored), postings.stored_field_stats(stored, docs))
    none = spark.createDataFrame([], "term string, site string")
    words = Dictionaries(none, none.select("term"), none)
    queries = spark.createDataFrame(
        [(1, "Dog"), (2, "Dog"), (3, ""), (4, None), (5, "quick+foxes"), (6, "unknownword")], "query_id long, raw string"
    )
    got = searching.run_search(queries, words, index, 10).orderBy("query_id", "rank").collect()
    by_query = {q: [r.title for r in got if r.query_id == q] for q in (1, 2, 3, 4, 5, 6)}
    assert by_query[1] == by_query[2] == ["Beta", "Alpha"]
    assert by_query[5] == ["Beta", "Alpha"] and not by_query[3] and not by_query[4] and not by_query[6]
    assert got[0].snippet == "the <b>dog</b> barks and the <b>dog</b> runs"


def test_texts_of_documents_nobody_hit_do_not_move(spark, tmp_path):
    spark.range(2000).selectExpr("id AS doc_key", "repeat('x', 500) AS content").write.parquet(str(tmp_path / "docs"))
    spark.range(20).selectExpr("id AS query_id", "id * 7 AS doc_key").write.parquet(str(tmp_path / "hits"))
    docs, hits = (spark.read.parquet(str(tmp_path / n)) for n in ("docs", "hits"))
    found = search.with_columns_of(hits, docs, ["content"])
    assert found.count() == 20
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "BroadcastHashJoin" in plan


def scan_files(plan):
    """``(files read, partition filters)`` of every parquet scan of an executed plan."""
    found, leaves = [], plan.collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.nodeName().startswith("Scan parquet"):
            metrics = leaf.metrics()
            found.append((metrics.apply("numFiles").value(), leaf.toString()))
    return found


@pytest.mark.parametrize("skew", [{}, {"broadcast_bytes": -1, "share": 0.05, "min_rows": 1}])
def test_stored_postings_are_pruned_by_bucket(spark, tmp_path, skew):
    """Only the folders of asked term buckets are read, and the matches stay the same."""
    from siterank.sources import index as index_tables

    words = [f"w{i}" for i in range(300)]
    rows = [(k, "", " ".join(words[(k * 7 + j * 13) % 300] for j in range(40)), "") for k in range(600)]
    rows += [(1000 + k, "", "common " * 5 + "rare", "") for k in range(50)]  # a frequent term
    many = materialize(spark.createDataFrame(rows, "doc_key long, title string, content string, code string"))
    stored = materialize(postings.document_postings(postings.field_tokens(many, FIELDS, stem=False)))
    index_tables.write_postings(stored, str(tmp_path), "r1")
    on_disk = spark.read.parquet(str(tmp_path / "postings"))
    all_files = len(on_disk.inputFiles())
    assert on_disk.select("field", "bucket").distinct().count() > 50
    assert on_disk.filter("term = 'common'").select(F.input_file_name()).distinct().count() >= 1
    tokens = tokens_of(spark, [(1, "content", "w5", 1), (2, "content", "common rare", 1), (3, "content", "w7 w9", 2)])
    terms = materialize(postings.term_stats(stored))
    weighed = materialize(search.weigh_clauses(tokens, terms, postings.field_stats(postings.field_tokens(many, FIELDS, stem=False))))
    want = {tuple(r) for r in search.match_clauses(weighed, stored, terms, **skew).collect()}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = search.match_clauses(weighed, on_disk, terms, **skew)
        got = {tuple(r) for r in found.collect()}
        scans = scan_files(found._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == want and len(got) > 50
    postings_scans = [(n, s) for n, s in scans if "bucket" in s]
    assert postings_scans and all("dynamicpruningexpression" in s for _, s in postings_scans)
    assert all(0 < n <= all_files // 10 for n, _ in postings_scans)


def test_block_top_hits_equal_top_hits_and_skip_ranges(spark):
    filler = [f"f{i}" for i in range(50)]
    rows = [
        (k, "", " ".join(filler[(k + j) % 50] for j in range(30)) + (" w1" if k % 7 == 0 else "") + (" w2" if k % 11 == 0 else ""), "")
        for k in range(3000)
    ]
    rows += [(5000 + k, "", "w1 w1 w1 w1 w2", "") for k in range(8)]
    rows += [(None, "", "w1 w2 w3", ""), (6000, "", "", ""), (6001, "", "w3 w3 w3 w1", ""), (6002, "", "w3 w3 w3 w1", "")]
    many = materialize(spark.createDataFrame(rows, "doc_key long, title string, content string, code string"))
    tokens = tokens_of(spark, [(1, "content", "w1", 1), (1, "content", "w2", 1), (2, "content", "w3", 2), (3, "content", "f4 f5", 1), (4, "content", "w2", 1)])
    index = searching.index_of(many, tokens, FIELDS, stem=False, phrases=False)
    terms = materialize(index.terms)
    weighed = materialize(search.weigh_clauses(tokens, terms, index.fields))
    want = search.top_hits(search.bm25(search.match_clauses(weighed, index.postings, terms, phrases=False)), 5)
    got = search.block_top_hits(weighed, index.postings, 5, range_docs=100)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    _, kept, bounds = search.block_ranges(weighed, index.postings, 5, range_docs=100)
    assert 0 < kept.count() < bounds.count() / 2


def test_tasks_grow_with_matches(spark, monkeypatch):
    """No task adds up more matches than its share, and the shares change no result."""
    rows = [(k, "", "common words " + f"w{k % 5}", "") for k in range(200)] + [(None, "", "common w1", "")]
    many = materialize(spark.createDataFrame(rows, "doc_key long, title string, content string, code string"))
    tokens = tokens_of(spark, [(q, "content", t, 1) for q in range(10) for t in ("common", "words", f"w{q % 5}")])
    index = searching.index_of(many, tokens, FIELDS, stem=False, phrases=False)
    terms = materialize(index.terms)
    weighed = materialize(search.weigh_clauses(tokens, terms, index.fields))
    assert search.match_tasks(weighed, terms, ["field", "term"], rows=100) == 45  # 10 * (201 + 200) + 10 * 40 + 2

    def matches():
        return search.match_clauses(weighed, index.postings, terms, phrases=False)

    want = sorted(map(tuple, matches().collect()), key=str)
    tasks = search.match_tasks
    monkeypatch.setattr(search, "match_tasks", lambda *a: tasks(*a, rows=100))
    assert matches().rdd.getNumPartitions() == 45
    assert sorted(map(tuple, matches().collect()), key=str) == want and len(want) == 4412


@pytest.mark.parametrize("skew", [{}, {"broadcast_bytes": -1, "share": 0.05, "min_rows": 1}])
def test_phrases_look_up_only_documents_of_their_rarest_token(spark, skew):
    """Frequent tokens are not multiplied by the phrases they stand in; null keys match."""
    rows = [(k, "", "of the of the", "") for k in range(300)]
    rows += [(1000, "", "king of the hill of the king of the", ""), (None, "", "the king of the", ""), (1001, "", "of king the", "")]
    many = materialize(spark.createDataFrame(rows, "doc_key long, title string, content string, code string"))
    tokens = tokens_of(spark, [(q, "content", "king of the", 1) for q in range(20)] + [(20, "content", "of the of", 1)])
    index = searching.index_of(many, tokens, FIELDS, stem=False)
    terms = materialize(index.terms)
    weighed = materialize(search.weigh_clauses(tokens, terms, index.fields))
    rarest = search.rarest_tokens(weighed, terms, ["field", "term"])
    assert {(r["query_id"], r["term"]) for r in rarest.collect()} == {(q, "king") for q in range(20)} | {(20, "of")}
    got = {(r["query_id"], r["doc_key"]): r["freq"] for r in search.match_clauses(weighed, index.postings, terms, **skew).collect()}
    assert got == {(q, k): n for q in range(20) for k, n in ((1000, 2), (None, 1))} | {(20, k): 1 for k in range(300)}
