"""N-gram Jaccard join by chosen paths.

Every text is the set of its word shingles.  A run splits all sets on one sampled
shared token: the sets whose smallest token under a random order is the same stay
together, which happens to two sets with probability equal to their similarity.  A
bucket that is still large is split again on a few more sampled tokens, each of its
children on its own, until it is small or no longer falls apart because its members
are alike.  The pairs inside a bucket are compared exactly; runs are repeated until the
target recall is reached.  A large bucket of alike sets is packed into blocks and
compared in pairs of blocks, spread over tasks, so no task holds it whole.

Pairs are never written out.  A pair that meets in several buckets is counted by the
one with the smallest number, and a bucket hands on a spanning forest of its links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siterank.llm.tables import utf8
from siterank.operators.skew import salted_join
from siterank.session import materialize, settings_of

#: Bytes of the sets in a block, about, and the most copies of a block that move.
BLOCK_BYTES = 4 << 20
TILES = 16
#: Rows of an Arrow batch, and bytes of text in a slice of it, where a task works on whole texts as arrays: those take
#: eight bytes per byte of text and a dozen of them live at once, beside the batch in the JVM and in the worker.
FEW_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
SLICE_BYTES = 1 << 19

MULT = np.uint64(0x9FB21C651E98DF25)
BASE = np.uint64(0xD6E8FEB86659FD93)
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))


@dataclass(frozen=True)
class JoinSettings:
    words: int = 5
    similarity: float = 0.8
    recall: float = 0.9999
    bucket: int = 96
    children: int = 3
    depth: int = 4
    spare: int = 12
    probes: int = 3
    block: int = 256
    seed: int = 11

    @property
    def runs(self) -> int:
        """Runs until all but ``1 - recall`` of the pairs at the threshold have met."""
        met = self.similarity * (1 - (1 - self.similarity) ** self.children) ** self.depth
        return max(1, math.ceil(math.log(1 - self.recall) / math.log(1 - met)))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MULT
    return h ^ (h >> np.uint64(29))


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 19)
        one = np.ones(1, np.uint64)
        _POWERS[:] = [np.concatenate([one, np.cumprod(np.full(size - 1, b))]) for b in (BASE, UNBASE)]
    return _POWERS[0][:n], _POWERS[1][:n]


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed shingles of many texts, and where those of each text begin.

    A text of fewer words than a shingle has one shingle of all its words; a text
    without words has none.
    """
    n = len(offsets) - 1
    inside = ~SPACE[data]
    edge = np.zeros(len(data), bool)
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    before = np.concatenate([[False], inside[:-1]]) & ~edge
    starts = np.flatnonzero(inside & ~before)
    after = np.concatenate([inside[1:], [False]]) & ~np.concatenate([edge[1:], [False]])
    ends = np.flatnonzero(inside & ~after) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    up, down = powers(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * up)])
    word = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, offsets)
    counts = np.diff(first)
    grown = np.where(counts == 0, 0, np.maximum(counts - words + 1, 1))
    bounds = np.concatenate([[0], np.cumsum(grown)])
    owner = np.repeat(np.arange(n), grown)
    at = first[:-1][owner] + np.arange(bounds[-1]) - bounds[:-1][owner]
    end = first[1:][owner]
    out = np.full(len(at), 17, np.uint64)
    for k in range(words):
        here = at + k
        ok = here < end
        out = np.where(ok, out * BASE + word[np.minimum(here, len(word) - 1)], out)
    return mixed(out), bounds


def per_slice(batch: pa.RecordBatch, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``most`` bytes of text each; the text is its last column."""
    _, offsets = utf8(batch.column(batch.num_columns - 1))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def signatures(texts: DataFrame, settings: JoinSettings) -> DataFrame:
    """``_key, _sig`` of rows with a word: the smallest value of every random order."""
    total, words = settings.runs + settings.spare, settings.words
    rng = np.random.default_rng(settings.seed)
    orders = [np.uint64(x | 1) for x in rng.integers(0, 1 << 63, total).tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in per_slice(whole, SLICE_BYTES):
                tokens, bounds = shingles(*utf8(batch.column(1)), words)
                some = np.flatnonzero(np.diff(bounds))
                if not len(some):
                    continue
                sig = np.empty((len(some), total), np.int32)
                for t, order in enumerate(orders):
                    # High bits of a product by an odd number depend on all bits below.
                    values = ((tokens ^ (tokens >> np.uint64(31))) * order) >> np.uint64(33)
                    sig[:, t] = np.minimum.reduceat(values, bounds[:-1][some])
                lists = pa.ListArray.from_arrays(np.arange(0, sig.size + 1, total, dtype=np.int32), sig.ravel())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), lists], ["_key", "_sig"])

    return texts.select("_key", "text").mapInArrow(run, "_key string, _sig array<int>")


def chosen_paths(sigs: DataFrame, settings: JoinSettings) -> DataFrame:
    """``_node, _key, _size``: the buckets with two or more members, and who is in them."""
    runs, leaves = settings.runs, []
    rows = sigs.select(
        "_key", F.posexplode(F.slice("_sig", 1, runs)).alias("_run", "_value")
    ).select(F.xxhash64("_run", "_value").alias("_node"), "_key")
    for depth in range(settings.depth + 1):
        rows = materialize(rows)
        # Buckets of one set end here; how alike a large one is shows in its other orders.
        counts = rows.groupBy("_node").agg(F.count(F.lit(1)).alias("_size")).filter("_size > 1")
        small = counts.filter(F.col("_size") <= settings.bucket)
        leaves.append(rows.join(small, "_node").select("_node", "_key", "_size"))
        large = materialize(counts.filter(F.col("_size") > settings.bucket))
        if depth == settings.depth:
            leaves.append(rows.join(large, "_node").select("_node", "_key", "_size"))
            break
        if large.isEmpty():
            break
        members = rows.join(large, "_node").join(sigs, "_key")
        spare = F.slice("_sig", runs + 1, settings.spare)
        members = materialize(members.select("_node", "_key", "_size", spare.alias("_spare")))
        shares = (
            members.select("_node", "_size", F.posexplode(F.slice("_spare", 1, settings.probes)).alias("_order", "_value"))
            .groupBy("_node", "_size", "_order", "_value")
            .count()
            .groupBy("_node", "_size", "_order")
            .agg(F.max("count").alias("_most"))
            .groupBy("_node")
            .agg((F.avg("_most") / F.first("_size")).alias("_alike"))
        )
        # Most members share their smallest tokens: another split would not part them.
        alike = materialize(shares.filter("_alike >= 0.4").select("_node"))
        leaves.append(members.join(alike, "_node").select("_node", "_key", "_size"))
        chosen = F.transform(
            F.sequence(F.lit(0), F.lit(settings.children - 1)),
            lambda j: F.pmod(F.xxhash64("_node", F.lit(settings.seed)) + j * 5, F.lit(settings.spare)).cast("int"),
        )
        rows = (
            members.join(alike, "_node", "left_anti")
            .select("_node", "_key", "_spare", F.explode(chosen).alias("_order"))
            .select(F.xxhash64("_node", "_order", F.get("_spare", F.col("_order"))).alias("_node"), "_key")
        )
    out = leaves[0]
    for leaf in leaves[1:]:
        out = out.unionByName(leaf)
    return out


def different_buckets(leaves: DataFrame) -> DataFrame:
    """Of the buckets with the same members only the one with the smallest number.

    Most runs find a small group of alike sets as the same bucket.
    """
    members = leaves.groupBy("_node").agg(
        F.count(F.lit(1)).alias("_size"),
        F.bit_xor(F.xxhash64("_key")).alias("_x"),
        F.sum(F.xxhash64(F.lit(1), "_key").bitwiseAND((1 << 40) - 1)).alias("_s"),
    )
    kept = members.groupBy("_size", "_x", "_s").agg(F.min("_node").alias("_node"))
    return materialize(leaves.join(kept.select("_node"), "_node"))


def compare(rows: Iterator[pa.RecordBatch], settings: JoinSettings) -> Iterator[pa.RecordBatch]:
    """Links inside the buckets of sorted rows ``(_node, _key, _nodes, _tokens)``.

    Gives ``(_key, _to, _links)``: the number of links of a member that its bucket
    counts, and one member of its bucket it is connected to, if any.
    """
    held: list[tuple] = []
    node = None
    for batch in rows:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        out: list[tuple[str, str | None, int]] = []
        for row in zip(*columns):
            if row[0] != node:
                out += links_of(node, held, None, settings)
                held, node = [], row[0]
            held.append(row[1:])
        if out:
            yield links_batch(out)
    if held:
        yield links_batch(links_of(node, held, None, settings))


def compare_blocks(rows: Iterator[pa.RecordBatch], settings: JoinSettings) -> Iterator[pa.RecordBatch]:
    """Links of two blocks of a bucket, from rows ``(_node, _a, _b, _left, _right)``; gives what ``compare`` does."""

    def members(block: pa.Scalar) -> list[tuple]:
        return [(x["_key"], x["_nodes"], x["_tokens"]) for x in block.as_py()]

    for batch in rows:
        for i in range(batch.num_rows):
            node, a, b = (batch.column(j)[i].as_py() for j in range(3))
            left = members(batch.column(3)[i])
            yield links_batch(links_of(node, left, None if a == b else members(batch.column(4)[i]), settings))


def links_batch(out: list) -> pa.RecordBatch:
    columns = list(zip(*out)) or [[], [], []]
    types = [pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["_key", "_to", "_links"])


def common_tokens(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """How many tokens every set on the left shares with every one on the right, or with every other one on the left."""
    sets, k = left + (right or []), len(left)
    flat, back = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    n = len(flat)
    if right is None:
        shared = np.bincount(back, minlength=n) > 1
    else:
        shared = (np.bincount(back[owner < k], minlength=n) > 0) & (np.bincount(back[owner >= k], minlength=n) > 0)
    keep = shared[back]
    column = (np.cumsum(shared) - 1)[back[keep]]
    owner = owner[keep]
    n_columns = int(shared.sum())
    common = np.zeros((k, len(right) if right else k), np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for start in range(0, n_columns, 8192):
        lo, hi = np.searchsorted(column, [start, start + 8192])
        part = np.zeros((len(sets), min(8192, n_columns - start)), np.float32)
        part[owner[lo:hi], column[lo:hi] - start] = 1
        common += part[:k] @ (part[k:] if right else part).T
    return np.rint(common).astype(np.int64)


def links_of(node, left: list[tuple], right: list[tuple] | None, settings: JoinSettings) -> list[tuple]:
    """Links of members ``(key, nodes, tokens)`` of a bucket with those on the right, or among each other without any."""
    alone = right is None
    others = left if alone else right
    wanted = np.ones((len(left), len(others)), bool)
    if alone:
        wanted = np.triu(wanted, 1)
    # Pairs that also meet in a bucket of a smaller number are counted there.
    rival: dict[int, tuple[list[int], list[int]]] = {}
    for side, members in enumerate((left, others)):
        for i, x in enumerate(members):
            for other in x[1]:
                if other < node:
                    rival.setdefault(other, ([], []))[side].append(i)
    for rows, columns in rival.values():
        if rows and columns:
            wanted[np.ix_(rows, columns)] = False
    if not wanted.any():
        return []
    # Members without a wanted pair are left out.
    rows, columns = wanted.any(1), wanted.any(0)
    if alone:
        rows = columns = rows | columns
    wanted = wanted[np.ix_(rows, columns)]
    left = [left[i] for i in np.flatnonzero(rows)]
    others = left if alone else [others[i] for i in np.flatnonzero(columns)]
    sets = [np.unique(np.frombuffer(x[2], np.uint64)) for x in left]
    other_sets = sets if alone else [np.unique(np.frombuffer(x[2], np.uint64)) for x in others]
    common = common_tokens(sets, None if alone else other_sets)
    sizes, other_sizes = (np.array([len(x) for x in s]) for s in (sets, other_sets))
    either = sizes[:, None] + other_sizes[None, :] - common
    # Exact for thresholds of few decimals: no division.
    scale = 10_000
    linked = wanted & (common * scale >= either * round(settings.similarity * scale))
    links = linked.sum(0) + linked.sum(1) if alone else np.concatenate([linked.sum(1), linked.sum(0)])
    keys = [x[0] for x in (left if alone else left + others)]
    root = list(range(len(keys)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    first = 0 if alone else len(left)
    for i, j in zip(*map(np.ndarray.tolist, np.nonzero(linked))):
        x, y = top(i), top(first + j)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [
        (keys[i], keys[r] if (r := top(i)) != i else None, int(links[i])) for i in np.flatnonzero(links).tolist()
    ]


def tiled(packed: DataFrame) -> DataFrame:
    """A copy of every block for each ``_tile`` of its bucket, of which there are ``TILES`` at most."""
    tiles = F.sequence(F.lit(0), F.least(F.col("_blocks"), F.lit(TILES)) - 1)
    return packed.withColumn("_tile", F.explode(tiles))


def links_of_blocks(members: DataFrame, settings: JoinSettings) -> DataFrame:
    """``_key, _to, _links`` inside buckets too large for one task, of ``(_node, _key, _nodes, _tokens)``.

    A bucket is packed into blocks, one row each, and the pairs of blocks are formed by
    the join whose task compares them.  So what moves grows as the bucket does: a block
    and at most ``TILES`` copies of it, whatever the number of blocks it meets.  Only
    the comparisons grow with the square, as every pair of alike texts may be a link.
    """
    spark = members.sparkSession
    members = materialize(members)
    weights = members.groupBy("_node").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.octet_length("_tokens")).alias("_bytes"))
    blocks = F.greatest(F.ceil(F.col("_n") / settings.block), F.ceil(F.col("_bytes") / BLOCK_BYTES)).cast("int")
    placed = salted_join(members, weights.select("_node", blocks.alias("_blocks")), ["_node"], ["_key"])
    packed = (
        placed.withColumn("_block", F.pmod(F.xxhash64("_key", F.lit(settings.seed)), F.col("_blocks")).cast("int"))
        .groupBy("_node", "_blocks", "_block")
        .agg(F.collect_list(F.struct("_key", "_nodes", "_tokens")).alias("_members"))
    )
    packed = materialize(packed)
    left = packed.select("_node", F.pmod("_block", F.lit(TILES)).alias("_tile"), F.col("_block").alias("_a"), F.col("_members").alias("_left"))
    right = tiled(packed).select("_node", "_tile", F.col("_block").alias("_b"), F.col("_members").alias("_right"))
    # A fixed number of partitions is not joined into fewer: these rows are few, but much work.
    n, by = int(spark.conf.get("spark.sql.shuffle.partitions")), ["_node", "_tile"]
    pairs = left.repartition(n, *by).hint("merge").join(right.repartition(n, *by), by).filter("_a <= _b")
    found = pairs.select("_node", "_a", "_b", "_left", "_right").mapInArrow(
        lambda batches: compare_blocks(batches, settings), "_key string, _to string, _links long"
    )
    # Rows are blocks here: few in a batch, and few held by the join before it spills.
    few = {"spark.sql.execution.arrow.maxRecordsPerBatch": "4", "spark.sql.sortMergeJoinExec.buffer.in.memory.threshold": "16"}
    with settings_of(spark, few):
        return materialize(found)


def similar_sets(texts: DataFrame, settings: JoinSettings) -> DataFrame:
    """``_key, _to, _links`` of the texts that have links; ``texts`` is ``(_key, text)``, keys may repeat."""
    sigs = materialize(signatures(texts, settings).groupBy("_key").agg(F.first("_sig").alias("_sig")))
    leaves = different_buckets(materialize(chosen_paths(sigs, settings)))
    words, block = settings.words, settings.block

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in per_slice(whole, SLICE_BYTES):
                found, bounds = shingles(*utf8(batch.column(1)), words)
                sets = [found[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["_key", "_tokens"])

    # The buckets of a member, at most a few per run.
    whole = F.col("_size") <= 2 * block
    nodes = leaves.groupBy("_key").agg(F.collect_set("_node").alias("_nodes"), F.bool_or(whole).alias("_whole"))

    def members(leaves: DataFrame, of: DataFrame) -> DataFrame:
        picked = texts.select("_key", "text").join(of.select("_key"), "_key", "left_semi")
        picked = picked.groupBy("_key").agg(F.first("text").alias("text"))
        sets = picked.mapInArrow(tokens, "_key string, _tokens binary").join(of, "_key")
        return leaves.select("_node", "_key").join(sets, "_key").select("_node", "_key", "_nodes", "_tokens")

    small = members(leaves.filter(whole), nodes.filter("_whole").select("_key", "_nodes"))
    small = small.repartition("_node").sortWithinPartitions("_node")
    found = materialize(small.mapInArrow(lambda batches: compare(batches, settings), "_key string, _to string, _links long"))
    large = materialize(leaves.filter(~whole))
    if large.isEmpty():
        return found
    # Written, so that texts stay where they are if few of them are in large buckets.
    of = leaves.join(large.select("_key").distinct(), "_key", "left_semi")
    of = materialize(of.groupBy("_key").agg(F.collect_set("_node").alias("_nodes")))
    return found.unionByName(links_of_blocks(members(large, of), settings))


def components(edges: DataFrame) -> DataFrame:
    """``_key, _class`` of every key in ``(_key, _to)``: the smallest key it is connected with.

    Labels move along the links and then to the label's own label, so chains shorten by
    half in a round; every round is a written table.  Ends when no label changes.
    """
    both = edges.select("_key", "_to").unionByName(edges.select(F.col("_to").alias("_key"), F.col("_key").alias("_to")))
    both = materialize(both.distinct())
    labels = materialize(both.groupBy("_key").agg(F.least(F.min("_to"), F.col("_key")).alias("_class")))
    while True:
        near = both.join(labels.select(F.col("_key").alias("_to"), F.col("_class").alias("_theirs")), "_to")
        near = near.groupBy("_key").agg(F.min("_theirs").alias("_theirs"))
        moved = labels.join(near, "_key").select(
            "_key", F.col("_class").alias("_old"), F.least("_class", "_theirs").alias("_class")
        )
        moved = materialize(moved)
        jump = moved.select(F.col("_key").alias("_class"), F.col("_class").alias("_next"))
        labels = materialize(
            moved.join(jump, "_class", "left").select("_key", "_old", F.coalesce("_next", "_class").alias("_class"))
        )
        if labels.filter("_class <> _old").isEmpty():
            return labels.select("_key", "_class")


def near_duplicates(docs: DataFrame, settings: JoinSettings = JoinSettings()) -> DataFrame:
    """Add ``class_id`` and ``n_links`` to every document.

    ``n_links`` is the number of different texts whose shingle sets have at least the
    wanted Jaccard similarity with that of this text; copies of a text are one text.
    ``class_id`` is the smallest document id among all documents that are connected
    by such links or by equal texts.  Texts without words link with nothing; a null
    text equals only null texts.  Null ids never name a class, unless all ids of a
    class are null.  Rows repeat as they came; columns of the two names are replaced.
    """
    docs = docs.drop(*[c for c in ("class_id", "n_links") if c in docs.columns])
    keyed = docs.withColumn("_key", F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")))
    with settings_of(docs.sparkSession, FEW_ROWS):
        found = similar_sets(keyed.filter("text is not null"), settings)
    links = found.groupBy("_key").agg(F.sum("_links").alias("n_links"))
    classes = components(found.filter("_to is not null"))
    ids = keyed.groupBy("_key").agg(F.min("doc_id").alias("_id"))
    named = ids.join(classes, "_key", "left").join(links, "_key", "left")
    named = named.withColumn("_class", F.coalesce("_class", "_key"))
    smallest = named.groupBy("_class").agg(F.min("_id").alias("class_id"))
    named = materialize(named.join(smallest, "_class").select("_key", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links")))
    return keyed.join(named, "_key").drop("_key")
