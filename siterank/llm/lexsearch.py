"""Ranked lexical search with per-term geometric blocks and exact block skipping.

Scoring (fixed values of the contract): terms are the maximal runs of
``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]`` with only A-Z lower-cased.  ``N`` counts
documents with a term, ``L`` all their terms, ``n`` a document's terms, ``df`` the
documents holding a term, ``tf`` its count in the document.  A term weighs
``w = floor(1000 * ln((2N + 2) / (2df + 1)))``, a document's length norm is
``m = 25 + (75 * n * N) div L``, and an item scores a document by the sum over the
item's terms (repeats included) of ``w * ((10^9 * tf) div (1000 * tf + 8 * m))``.

The index: documents with terms in common are put next to each other (ordered by two
MinHash values of their term sets) and cut into segments, one row each.  In a segment
each term's posting list is cut into blocks of at most ``block_docs`` neighbouring
documents.  A block keeps a summary vector, the coordinatewise maximum of its
documents' contribution vectors: exact for the block's own term, for the ``top``
largest coordinates of every document, and for the rest bounded by the largest
coordinate a document left out.  So the dot product of an item with a summary bounds
the score of every document in the block.

A search takes a threshold from the exact scores of the documents in each item's
best-bounded ``seed_blocks`` blocks of a segment (its 10th best score, or 1 when fewer
than 10 score above 0), skips every block whose bound is below it, and scores the
documents of the rest exactly.  A document that can be among the first ``k`` of its
segment scores at least the threshold, so its blocks are never skipped, and the best
of all segments are among those of each: the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siterank.llm.setjoin import mixed, per_slice, powers
from siterank.llm.suffixes import lists, ranges
from siterank.llm.tables import utf8
from siterank.operators.skew import salted_join
from siterank.session import materialize, settings_of

#: The term pattern and the letters that are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same for bytes of UTF-8: those of a term, and every byte in lower case.
IN_TERM = np.array([x >= 128 or chr(x).isalnum() for x in range(256)])
LOWERED = np.array([x + 32 * (65 <= x <= 90) for x in range(256)], np.uint8)
#: Bits that tell which terms are asked, and the postings and items of one row.
ASKED_BITS = 20
SEGMENT, ITEMS = 1 << 17, 256


def div(a: Column, b: Column) -> Column:
    """64-bit integer division, rounding down for the non-negative numbers here."""
    return F.call_function("div", a, b)


def terms(text: Column | str) -> Column:
    """The terms of a text in order; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), 0)


def term_hashes(data: np.ndarray, offsets: np.ndarray):
    """Hash, first byte and end of every term in lower-cased bytes of many texts, and where those of each text begin."""
    inside = IN_TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets[:-1]] = True
    starts = np.flatnonzero(inside & (~np.concatenate([[False], inside[:-1]]) | edge[:-1]))
    ends = np.flatnonzero(inside & (~np.concatenate([inside[1:], [False]]) | edge[1:])) + 1
    up, down = powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * up[:-1])])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def asked_bits(items: DataFrame) -> np.ndarray:
    """Which hashes terms of the items have: ``2 ** ASKED_BITS`` flags, however many the items are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in per_slice(whole):
                data, offsets = utf8(batch.column(0))
                hashes = term_hashes(LOWERED[data], offsets)[0] >> np.uint64(64 - ASKED_BITS)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(hashes).astype(np.int64))], ["bit"])

    flags = np.zeros(1 << ASKED_BITS, bool)
    flags[[r[0] for r in items.select("text").mapInArrow(run, "bit long").distinct().collect()]] = True
    return np.packbits(flags)


def postings(docs: DataFrame, asked: np.ndarray) -> DataFrame:
    """``doc_id, n, _mh1, _mh2, terms, tfs`` of every document with a term, not written.

    ``terms`` are its distinct terms that may be asked, ``n`` counts all; ``_mh1, _mh2``
    are MinHash values of all its terms, its place among alike documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(asked).astype(bool)
        for whole in batches:
            for batch in per_slice(whole):
                data, offsets = utf8(batch.column(1))
                data = LOWERED[data]
                hashes, starts, ends, first = term_hashes(data, offsets)
                n = np.diff(first)
                some = np.flatnonzero(n)
                if not len(some):
                    continue
                least = [np.minimum.reduceat(mixed(hashes ^ np.uint64(x)), first[some]).view(np.int64) for x in (0x5BD1, 0xC2B2)]
                doc = np.repeat(np.arange(len(n)), n)
                may = np.flatnonzero(flags[hashes >> np.uint64(64 - ASKED_BITS)])
                may = may[np.lexsort((hashes[may], doc[may]))]
                new = np.ones(len(may), bool)
                new[1:] = (hashes[may][1:] != hashes[may][:-1]) | (doc[may][1:] != doc[may][:-1])
                at = np.flatnonzero(new)
                tf, may = np.diff(np.append(at, len(may))), may[at]
                sizes = ends[may] - starts[may]
                found = pa.LargeStringArray.from_buffers(
                    len(may),
                    pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)),
                    pa.py_buffer(data[ranges(starts[may], sizes)]),
                )
                counts = np.bincount(doc[may], minlength=len(n))[some]
                columns = [
                    batch.column(0).take(pa.array(some)),
                    pa.array(n[some]),
                    *map(pa.array, least),
                    pa.ListArray.from_arrays(lists(tf, counts).offsets, found.cast(pa.string())),
                    lists(tf, counts),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "_mh1", "_mh2", "terms", "tfs"])

    schema = "doc_id long, n long, _mh1 long, _mh2 long, terms array<string>, tfs array<long>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def totals(docs: DataFrame) -> tuple[int, int]:
    """``N`` (documents with a term) and ``L`` (all their terms), of texts or of their ``n``."""
    # Counted as they stand: lower case makes them neither more nor fewer.
    n = F.col("n") if "n" in docs.columns else F.regexp_count(F.coalesce("text", F.lit("")), F.lit(TERM))
    row = docs.agg(F.count_if(n > 0).alias("N"), F.sum(n).alias("L")).first()
    return int(row["N"] or 0), int(row["L"] or 0)


def weights(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``(_row, doc_id, _mh1, _mh2, term, c)``: contributions of the asked terms in every document.

    ``_row`` tells repeated rows apart.
    """
    rows = materialize(postings(docs, asked_bits(items)))
    n_docs, n_terms = totals(rows)
    df = materialize(rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    w = F.floor(F.lit(1000.0) * F.log((2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
    m = F.lit(25) + div(F.lit(75) * F.col("n") * F.lit(n_docs), F.lit(max(n_terms, 1)))
    part = div(F.lit(1_000_000_000) * F.col("tf"), F.lit(1000) * F.col("tf") + F.lit(8) * m)
    each = rows.withColumn("_row", F.monotonically_increasing_id()).select(
        "_row", "doc_id", "n", "_mh1", "_mh2", F.inline(F.arrays_zip("terms", "tfs")).alias("term", "tf")
    )
    with_weight = salted_join(each, df.select("term", w.alias("w")), ["term"], ["_row"])
    return with_weight.select("_row", "doc_id", "_mh1", "_mh2", "term", (F.col("w") * part).alias("c"))


def segments(contrib: DataFrame, most: int) -> DataFrame:
    """Neighbouring documents with their contribution vectors, about ``most`` postings in a row.

    ``doc_ids, sizes, terms, codes, cs``: a document has the next ``sizes`` of ``codes``
    (places in ``terms``) and ``cs``.
    """
    names = ["doc_ids", "sizes", "terms", "codes", "cs"]

    def packed(rows: pa.Table) -> pa.RecordBatch:
        key = rows.column("_row").to_numpy()
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        terms = rows.column("term").combine_chunks().dictionary_encode()
        columns = [rows.column("doc_id").combine_chunks().take(pa.array(at)), np.diff(np.append(at, len(key))).astype(np.int32)]
        columns += [terms.dictionary, terms.indices, rows.column("c").combine_chunks()]
        return pa.RecordBatch.from_arrays([pa.array([x], pa.list_(pa.array(x).type)) for x in columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= most:
                rows = pa.Table.from_batches(held)
                key = rows.column("_row").to_numpy()
                end = int(np.flatnonzero(np.append(True, key[1:] != key[:-1]))[-1])
                if end:
                    yield packed(rows.slice(0, end))
                    held = rows.slice(end).combine_chunks().to_batches()
                    n -= end
        if n:
            yield packed(pa.Table.from_batches(held))

    order = ["_mh1", "_mh2", "_row"]
    ordered = contrib.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = "doc_ids array<long>, sizes array<int>, terms array<string>, codes array<int>, cs array<long>"
    return ordered.select("_row", "doc_id", "term", "c").mapInArrow(run, schema)


def item_vectors(items: DataFrame) -> DataFrame:
    """``items``: up to about ``ITEMS`` items in a row, each with its ``_inull, _item, terms, qs``.

    ``(_inull, _item)`` is the item id with nulls as a key.
    """
    keyed = items.select(
        F.col("item_id").isNull().alias("_inull"),
        F.coalesce(F.col("item_id").cast("long"), F.lit(0)).alias("_item"),
        F.explode(terms("text")).alias("term"),
    )
    q = keyed.groupBy("_inull", "_item", "term").agg(F.count(F.lit(1)).cast("long").alias("q"))
    vector = q.groupBy("_inull", "_item").agg(F.collect_list("term").alias("terms"), F.collect_list("q").alias("qs"))
    vector = materialize(vector)
    chunks = max(1, -(-vector.count() // ITEMS))
    chunk = F.pmod(F.xxhash64("_inull", "_item"), F.lit(chunks))
    return materialize(vector.groupBy(chunk.alias("_chunk")).agg(F.collect_list(F.struct(*vector.columns)).alias("items")))


class Segment:
    """Blocks of the posting lists of one segment and their summaries."""

    def __init__(self, sizes: np.ndarray, terms: list[str], codes: np.ndarray, cs: np.ndarray, block_docs: int, top: int):
        n, u = len(codes), len(terms)
        self.code = {t: i for i, t in enumerate(terms)}
        doc = np.repeat(np.arange(len(sizes)), sizes)
        # Lists of the terms, documents in the order of the segment.
        by_term = np.argsort(codes, kind="stable")
        code, self.doc, self.c = codes[by_term], doc[by_term], cs[by_term]
        self.first = np.searchsorted(code, np.arange(u + 1))
        self.most = np.maximum.reduceat(self.c, self.first[:-1])
        starts = (np.arange(n) - self.first[code]) % block_docs == 0
        block = np.cumsum(starts) - 1
        self.start = np.flatnonzero(starts)
        self.size = np.diff(np.append(self.start, n))
        self.n_blocks = len(self.start)
        self.block_term = code[self.start]
        self.blocks = np.searchsorted(self.block_term, np.arange(u + 1))
        self.own = np.maximum.reduceat(self.c, self.start)
        # The largest coordinates of every document, and the largest that it leaves out.
        order = np.lexsort((-cs, doc))
        place = np.arange(n) - (np.cumsum(sizes) - sizes)[doc]
        rest = np.zeros(len(sizes), np.int64)
        rest[doc[place == top]] = cs[order][place == top]
        self.rest = np.maximum.reduceat(rest[self.doc], self.start)
        kept = order[place < top]
        counts = np.minimum(sizes, top)
        at = ranges((np.cumsum(counts) - counts)[self.doc], counts[self.doc])
        key = codes[kept][at] * self.n_blocks + np.repeat(block, counts[self.doc])
        value = cs[kept][at]
        by = np.argsort(key, kind="stable")
        key, value = key[by], value[by]
        run = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        key, self.value = key[run], np.maximum.reduceat(value, run)
        self.in_block = key % self.n_blocks
        self.entries = np.searchsorted(key, np.arange(u + 1) * self.n_blocks)

    def bounds(self, ts: np.ndarray, qs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The blocks of these terms and the most a document in each can score."""
        counts = np.diff(self.blocks)[ts]
        blocks, q = ranges(self.blocks[ts], counts), np.repeat(qs, counts)
        rest, most = self.rest[blocks], self.most[ts]
        # Every term counts as much as the documents of the block can have left out of it ...
        by = np.argsort(most)
        below = np.concatenate([[0], np.cumsum((qs * most)[by])])
        above = qs.sum() - np.concatenate([[0], np.cumsum(qs[by])])
        i = np.searchsorted(most[by], rest, "right")
        bound = below[i] + rest * above[i]
        # ... or as the summary says, if that is more; the block's own term is exact.
        own = self.block_term[blocks]
        bound += q * (self.own[blocks] - np.minimum(rest, self.most[own]))
        local = np.full(self.n_blocks, -1)
        local[blocks] = np.arange(len(blocks))
        counts = np.diff(self.entries)[ts]
        e, which = ranges(self.entries[ts], counts), np.repeat(np.arange(len(ts)), counts)
        at = local[self.in_block[e]]
        ok = (at >= 0) & (ts[which] != own[at])
        e, which, at = e[ok], which[ok], at[ok]
        np.add.at(bound, at, qs[which] * np.maximum(self.value[e] - np.minimum(rest[at], most[which]), 0))
        return blocks, bound

    def scores(self, blocks: np.ndarray, ts: np.ndarray, qs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The documents of these blocks that score above 0, and their scores."""
        asked = np.zeros(int(self.doc.max()) + 1, bool)
        asked[self.doc[ranges(self.start[blocks], self.size[blocks])]] = True
        counts = np.diff(self.first)[ts]
        p = ranges(self.first[ts], counts)
        ok = asked[self.doc[p]]
        total = np.zeros(len(asked), np.int64)
        np.add.at(total, self.doc[p[ok]], self.c[p[ok]] * np.repeat(qs, counts)[ok])
        docs = np.flatnonzero(total > 0)
        return docs, total[docs]

    def best(self, ts: np.ndarray, qs: np.ndarray, k: int, seed_blocks: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that score above 0, all those among the first ``k`` with them, and their scores."""
        blocks, bound = self.bounds(ts, qs)
        seeds = blocks[np.argsort(-bound, kind="stable")[:seed_blocks]]
        found = np.sort(self.scores(seeds, ts, qs)[1])
        threshold = found[-k] if len(found) >= k else 1
        return self.scores(blocks[bound >= threshold], ts, qs)


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, block_docs: int = 64, top: int = 8, seed_blocks: int = 2
) -> DataFrame:
    """The ``k`` best documents of every item: ``item_id, rank, doc_id, score``.

    Only documents scoring above 0 are returned, equal scores by ascending doc_id
    (repeated rows are separate documents with equal ids and scores).  A null text has
    no terms; an item without terms gets no rows; rows of one item_id (null too) are
    one item with the terms of all.  Only ``doc_id, text`` and
    ``item_id, text`` are read; other columns are left out.  The terms of a text are
    told apart by 64-bit hashes.
    """
    items = items.select("item_id", "text")
    contrib = materialize(weights(docs.select("doc_id", "text"), items))
    index = materialize(segments(contrib, SEGMENT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, sizes, words, codes, cs, asked = (batch.column(j)[i].values for j in range(6))
                sizes, codes, cs = (x.to_numpy().astype(np.int64) for x in (sizes, codes, cs))
                segment = Segment(sizes, words.to_pylist(), codes, cs, block_docs, top)
                known, number = np.asarray(ids.is_valid()), ids.fill_null(0).to_numpy()
                out = []
                for item in asked.to_pylist():
                    pairs = [(segment.code[t], q) for t, q in zip(item["terms"], item["qs"]) if t in segment.code]
                    if not pairs:
                        continue
                    found, score = segment.best(*np.array(pairs, np.int64).T, k, seed_blocks)
                    best = np.lexsort((number[found], known[found], -score))[:k]
                    for d, x in zip(found[best].tolist(), score[best].tolist()):
                        out.append((item["_inull"], item["_item"], int(number[d]) if known[d] else None, x))
                columns = list(zip(*out)) or [[]] * 4
                kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    names = ["_inull", "_item", "doc_id", "score"]
    # Rows are whole segments here: few in a batch.
    with settings_of(docs.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": "4"}):
        pairs = index.crossJoin(item_vectors(items).select("items"))
        found = materialize(pairs.mapInArrow(run, "_inull boolean, _item long, doc_id long, score long"))
    order = Window.partitionBy("_inull", "_item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select(
            F.when(~F.col("_inull"), F.col("_item")).alias("item_id"),
            F.col("rank").cast("int"),
            "doc_id",
            "score",
        )
    )
