"""Batch search of very many queries: blocks of queries meet blocks of documents.

Nearly every query matches nearly every document on some frequent word, so the matches
grow as queries times documents and must never be moved.  Every different clause is
matched once, whatever the number of queries that hold it.  Its matches are packed into
blocks of documents, the clauses into blocks of queries, and a Cartesian product, which
shuffles nothing, brings every pair of blocks together.  A task adds up the scores of
its pairs and hands on the ``n`` best documents per query only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siterank.operators.search import match_clauses, top_hits
from siterank.operators.skew import salted_join
from siterank.session import materialize, released_shuffles

# Matches of clauses in a block of documents, and clauses in a block of queries.
BLOCK_MATCHES = 1 << 20
BLOCK_CLAUSES = 1 << 18
# The document blocks are dealt to at most this many tasks per block of queries, and to no
# more than it takes to have this many tasks per core: a task drops what its own hits beat.
DOCUMENT_TASKS = 8
TASKS_PER_CORE = 4
# A clause in more than one of so many documents of a block is a row of a matrix.
FREQUENT = 8
# Queries whose scores a task holds at once, their scores, and their matches outside the matrix.
HELD_QUERIES = 64
HELD_CELLS = 1 << 20
HELD_MATCHES = 1 << 20
QUERY_ARRAYS = [("_queries", np.int64), ("_first", np.int64), ("_asked", np.int64), ("_gains", float)]


def different_clauses(whole: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(query_id, clause, field, i, term, n_tokens, gain, mean_len)`` of every different
    clause, numbered in ``query_id``, and ``(query_id, _kind, gain)`` of the queries."""
    whole = materialize(whole.select("query_id", "field", "n_tokens", "gain", "mean_len", F.array_sort("found").alias("_tokens")))
    same = ["field", "_tokens"]
    kinds = whole.groupBy(*same).agg(*[F.any_value(c).alias(c) for c in ("n_tokens", "mean_len")])
    # Written at once, so the numbers do not change.
    kinds = materialize(kinds.withColumn("_kind", F.monotonically_increasing_id()))
    gains = salted_join(whole, kinds.select("_kind", *same), same, ["query_id"])
    clauses = kinds.select(
        F.col("_kind").alias("query_id"),
        F.lit(0).alias("clause"),
        "field",
        "n_tokens",
        F.lit(1.0).alias("gain"),
        "mean_len",
        F.inline("_tokens"),
    )
    return materialize(clauses), gains.groupBy("query_id", "_kind").agg(F.sum("gain").alias("gain"))


def expected_blocks(clauses: DataFrame, terms: DataFrame, rows: int) -> int:
    """Blocks that have about ``rows`` matches each; a phrase counts as the rarest of its tokens."""
    least = clauses.join(terms.select("field", "term", "df"), ["field", "term"]).groupBy("query_id").agg(F.min("df").alias("df"))
    with released_shuffles(clauses.sparkSession):
        matches = least.agg(F.sum("df")).first()[0]
    return max(1, -(-int(matches or 0) // rows))


def document_blocks(matches: DataFrame, key: str, blocks: int) -> DataFrame:
    """``(_docs, _null, _kinds, _starts, _at, _part)`` of ``(_kind, key, freq, norm)``: documents in
    order, a null first, and the list of documents and parts of every kind, as packed arrays.

    The rows of a match are added up where its block is made: matches are moved once.
    """

    def pack(table: pa.Table) -> pa.Table:
        null = table["_key"].is_null().to_numpy()
        keys = table["_key"].fill_null(0).to_numpy()
        docs = np.unique(keys[~null])
        at = np.where(null, 0, np.searchsorted(docs, keys) + int(null.any())).astype(np.int32)
        docs = np.concatenate([np.zeros(int(null.any()), np.int64), docs])
        kind = table["_kind"].to_numpy()
        order = np.lexsort([at, kind])
        kind, at = kind[order], at[order]
        own = np.flatnonzero(np.append(True, (np.diff(kind) != 0) | (np.diff(at) != 0)))
        freq = np.add.reduceat(table["freq"].to_numpy()[order], own)
        part = freq / (freq + table["norm"].to_numpy()[order][own])
        kinds, starts = np.unique(kind[own], return_index=True)
        arrays = [kinds, np.append(starts, len(own)).astype(np.int64), at[own], part]
        packed = [docs.tobytes(), bool(null.any()), *[a.tobytes() for a in arrays]]
        return pa.table({name: [value] for name, value in zip(("_docs", "_null", "_kinds", "_starts", "_at", "_part"), packed)})

    placed = matches.select(
        F.pmod(F.xxhash64(key), F.lit(blocks)).alias("_block"), "_kind", F.col(key).cast("long").alias("_key"), "freq", "norm"
    )
    schema = "_docs binary, _null boolean, _kinds binary, _starts binary, _at binary, _part binary"
    return placed.groupBy("_block").applyInArrow(pack, schema)


def query_blocks(gains: DataFrame, rows: int) -> DataFrame:
    """``(_block, _queries, _first, _asked, _gains)``: the clauses of every query as packed arrays."""
    blocks = max(1, -(-gains.count() // rows))

    def pack(table: pa.Table) -> pa.Table:
        query = table["query_id"].to_numpy()
        order = np.lexsort([table["_kind"].to_numpy(), query])
        queries, first = np.unique(query[order], return_index=True)
        arrays = [
            queries,
            np.append(first, len(order)).astype(np.int64),
            table["_kind"].to_numpy()[order],
            table["gain"].to_numpy()[order],
        ]
        packed = [table["_block"][0].as_py(), *[a.tobytes() for a in arrays]]
        return pa.table({name: [value] for name, value in zip(("_block", "_queries", "_first", "_asked", "_gains"), packed)})

    placed = gains.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    schema = "_block long, _queries binary, _first binary, _asked binary, _gains binary"
    # A partition per block, about: each meets every partition of document blocks.
    return materialize(placed.groupBy("_block").applyInArrow(pack, schema)).repartitionByRange(blocks, "_block")


class QueryBlock:
    """The clauses of a block of queries and the ``n`` best documents each has met, best first:
    scores * 10 ** 9 (no hit: -inf), keys and which of them are null."""

    def __init__(self, queries: np.ndarray, first: np.ndarray, asked: np.ndarray, gains: np.ndarray, n: int):
        self.queries, self.first, self.gains, self.n = queries, first, gains, n
        # Queries share most of their clauses: each is looked up once in a block of documents.
        self.kinds, self.kind = np.unique(asked, return_inverse=True)
        self.scores = np.full((len(queries), n), -np.inf)
        self.keys = np.zeros((len(queries), n), np.int64)
        self.null = np.zeros((len(queries), n), bool)

    def meet(self, keys: np.ndarray, null: np.ndarray, scores: np.ndarray, matched: np.ndarray, lo: int) -> None:
        """Take the documents that can be among the best of the queries from ``lo`` on, by scores per query and document."""
        hi = lo + len(scores)
        # Scores are compared rounded; those a rounding below the n-th best are looked at.
        least = self.scores[lo:hi, -1] / 1e9 - 2e-9
        fewer = np.flatnonzero(least == -np.inf)
        if len(fewer) and scores.shape[1] > self.n:
            some = np.where(matched[fewer], scores[fewer], -np.inf)
            least[fewer] = np.partition(some, -self.n, axis=1)[:, -self.n] - 2e-9
        query, place = np.nonzero((scores >= least[:, None]) & matched)
        if not len(query):
            return
        found = scores[query, place]
        found = np.copysign(np.floor(np.abs(found) * 1e9 + 0.5), found)
        rows = np.unique(query)
        had = self.scores[lo + rows] > -np.inf
        owner = np.concatenate([np.repeat(rows, had.sum(axis=1)), query])
        found = np.concatenate([self.scores[lo + rows][had], found])
        key = np.concatenate([self.keys[lo + rows][had], keys[place]])
        none = np.concatenate([self.null[lo + rows][had], null[place]])
        order = np.lexsort([key, ~none, -found, owner])
        owner = owner[order]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        best = rank < self.n
        order, at = order[best], (lo + owner[best], rank[best])
        self.scores[lo + rows] = -np.inf
        self.scores[at], self.keys[at], self.null[at] = found[order], key[order], none[order]

    def hits(self, key: str) -> pa.RecordBatch:
        held = self.scores > -np.inf
        columns = [
            pa.array(np.repeat(self.queries, held.sum(axis=1))),
            pa.array(self.keys[held], mask=self.null[held]),
            pa.array(self.scores[held] / 1e9),
        ]
        return pa.RecordBatch.from_arrays(columns, ["query_id", key, "score"])


def pair_scores(block: QueryBlock, docs: tuple) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first query, scores, matched)`` of a pair of blocks, a few queries by all documents at a time.

    Clauses in more than a share of the documents are summed up as a matrix product, the
    matches of the others are added one by one.
    """
    n_docs, kinds, starts, at, part = docs
    spot = np.minimum(np.searchsorted(kinds, block.kinds), len(kinds) - 1)
    size = np.where(kinds[spot] == block.kinds, np.diff(starts)[spot], 0)
    start = starts[spot]
    frequent = np.flatnonzero(size * FREQUENT > n_docs)
    row = np.full(len(size), -1)
    row[frequent] = np.arange(len(frequent))
    dense = np.zeros((len(frequent), n_docs))
    for r, k in enumerate(frequent.tolist()):
        held = slice(start[k], start[k] + size[k])
        dense[r, at[held]] = part[held]
    single = np.where(row[block.kind] < 0, size[block.kind], 0)
    work = np.append(0, np.cumsum(single))[block.first]

    def summed(lo: int, hi: int, gains: np.ndarray, matrix: np.ndarray, parts: np.ndarray | None) -> np.ndarray:
        c = slice(block.first[lo], block.first[hi])
        kind, gain = block.kind[c], gains[c]
        owner = np.repeat(np.arange(hi - lo), np.diff(block.first[lo : hi + 1]))
        often = row[kind] >= 0
        factor = np.zeros((hi - lo, len(frequent)))
        factor[owner[often], row[kind[often]]] = gain[often]
        out = factor @ matrix
        rare = np.flatnonzero(single[c])
        n = size[kind[rare]]
        # Places of the matches of all these clauses, one list after the other.
        end = np.cumsum(n)
        place = np.arange(n.sum()) + np.repeat(start[kind[rare]] - (end - n), n)
        value = np.repeat(gain[rare], n)
        np.add.at(out.reshape(-1), at[place] + np.repeat(owner[rare] * n_docs, n), value if parts is None else value * parts[place])
        return out

    lo = 0
    while lo < len(block.queries):
        # Bounded by queries, cells and matches, but a query at least.
        hi = int(np.searchsorted(work, work[lo] + HELD_MATCHES, "right")) - 1
        hi = max(lo + 1, min(hi, lo + HELD_QUERIES, lo + HELD_CELLS // max(1, n_docs), len(block.queries)))
        scores = summed(lo, hi, block.gains, dense, part)
        matched = scores > 0
        if not (block.gains[block.first[lo] : block.first[hi]] > 0).all():
            matched = summed(lo, hi, np.ones(len(block.gains)), (dense > 0).astype(float), None) > 0
        yield lo, scores, matched
        lo = hi


def block_hits(pairs: DataFrame, n: int, key: str) -> DataFrame:
    """``(query_id, key, score)``: the ``n`` best documents per query among those its task has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task has few blocks of queries; they stay while blocks of documents pass by.
        blocks: dict[int, QueryBlock] = {}
        for batch in batches:
            for i in range(batch.num_rows):

                def array(name, kind, batch=batch, i=i):
                    return np.frombuffer(batch.column(name)[i].as_buffer(), kind)

                number = batch.column("_block")[i].as_py()
                if number not in blocks:
                    packed = [array(name, kind).copy() for name, kind in QUERY_ARRAYS]
                    blocks[number] = QueryBlock(*packed, n)
                docs = array("_docs", np.int64)
                null = np.zeros(len(docs), bool)
                null[:1] = batch.column("_null")[i].as_py()
                lists = (len(docs), array("_kinds", np.int64), array("_starts", np.int64), array("_at", np.int32), array("_part", float))
                for lo, scores, matched in pair_scores(blocks[number], lists):
                    blocks[number].meet(docs, null, scores, matched, lo)
        for block in blocks.values():
            yield block.hits(key)

    return pairs.mapInArrow(run, f"query_id long, {key} long, score double")


def blocked_top_hits(
    weighed: DataFrame,
    postings: DataFrame,
    terms: DataFrame,
    n: int,
    key: str = "doc_key",
    phrases: bool = True,
    block_matches: int = BLOCK_MATCHES,
    block_clauses: int = BLOCK_CLAUSES,
) -> DataFrame:
    """``clause_top_hits`` of ``weigh_clauses``."""
    whole = weighed.groupBy("query_id", "clause").agg(
        *[F.any_value(c).alias(c) for c in ("field", "n_tokens", "gain", "mean_len")],
        F.collect_list(F.struct("i", "term")).alias("found"),
    )
    return clause_top_hits(whole, postings, terms, n, key, phrases, block_matches, block_clauses)


def clause_top_hits(
    whole: DataFrame,
    postings: DataFrame,
    terms: DataFrame,
    n: int,
    key: str = "doc_key",
    phrases: bool = True,
    block_matches: int = BLOCK_MATCHES,
    block_clauses: int = BLOCK_CLAUSES,
) -> DataFrame:
    """The ``n`` best documents per query of ``whole_clauses``, exactly as ``top_hits(bm25(match_clauses(...)))``.

    ``query_id`` and ``key`` are longs and ``query_id`` is not null.  What is moved and
    written grows with the postings of the asked terms, the clauses and ``n`` hits per
    query and task, of which there are at most ``DOCUMENT_TASKS`` per query; time grows
    with queries times documents.
    """
    clauses, gains = different_clauses(whole)
    matches = match_clauses(clauses, postings, terms, key, phrases, summed=False)
    matches = matches.select(F.col("query_id").alias("_kind"), key, "freq", "norm")
    docs = materialize(document_blocks(matches, key, expected_blocks(clauses, terms, block_matches)))
    queries = query_blocks(materialize(gains), block_clauses)
    tasks = -(-TASKS_PER_CORE * docs.sparkSession.sparkContext.defaultParallelism // max(1, queries.count()))
    docs = docs.repartition(max(1, min(DOCUMENT_TASKS, docs.count(), tasks)))
    # Blocks of documents pass by one after the other; a task keeps its blocks of queries, and these are few.
    pairs = docs.crossJoin(queries.hint("shuffle_replicate_nl"))
    # The pairs are met once; the ranking samples nothing, but its input must not be made twice.
    return top_hits(materialize(block_hits(pairs, n, key)), n, key)
