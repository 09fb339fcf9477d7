"""Nearest neighbours by a hash-prefix forest.

Every tree hashes a vector to a long string of bits, one per random hyperplane, and
keeps the strings sorted.  A query descends each tree to the place of its longest
prefix match and then ascends in all trees together, one bit at a time, until the
strings that share the prefix hold enough candidates.  The candidates are measured
exactly.  Vectors are dealt to blocks of bounded size; every block has a forest of its
own and gives its nearest, and the best of all blocks remain.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siterank.session import materialize


@dataclass(frozen=True)
class ForestSettings:
    """``share`` of a block's vectors is the least number of candidates an ascent gathers.

    Vectors without structure need more than half of all for a recall of 0.9; clustered
    ones far fewer.  ``sample`` rows, a documented bound, set the thresholds of the
    hyperplanes so that both values of a bit are equally likely.
    """

    neighbours: int = 10
    trees: int = 24
    bits: int = 40
    share: float = 0.6
    block: int = 16_384
    query_block: int = 8_192
    sample: int = 4_096
    seed: int = 5


def planes(size: int, settings: ForestSettings) -> np.ndarray:
    rng = np.random.default_rng([settings.seed, size])
    return rng.standard_normal((settings.trees * settings.bits, size))


def strings(vectors: np.ndarray, thresholds: np.ndarray | None, settings: ForestSettings) -> np.ndarray:
    """The bit string of every vector in every tree, first bit highest."""
    seen = vectors @ planes(vectors.shape[1], settings).T
    bits = seen > (0 if thresholds is None else thresholds)
    bits = bits.reshape(len(vectors), settings.trees, settings.bits)
    return (bits.astype(np.uint64) << np.arange(settings.bits - 1, -1, -1, dtype=np.uint64)).sum(2, dtype=np.uint64)


class Forest:
    """Sorted arrays of bit strings, one per tree, over the vectors of one block."""

    def __init__(self, vectors: np.ndarray, thresholds: np.ndarray | None, settings: ForestSettings):
        self.settings, self.thresholds = settings, thresholds
        hashed = strings(vectors, thresholds, settings)
        self.order = np.argsort(hashed, axis=0, kind="stable")
        self.sorted = np.take_along_axis(hashed, self.order, axis=0)

    def candidates(self, queries: np.ndarray, least: int) -> list[np.ndarray]:
        """For every query the places of the vectors its synchronous ascent ends with."""
        s = self.settings
        hashed = strings(queries, self.thresholds, s)
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(queries)
        waiting = np.arange(len(queries))
        for level in range(s.bits, -1, -1):
            below = np.uint64((1 << (s.bits - level)) - 1)
            low = hashed[waiting] & ~below
            first = np.stack([np.searchsorted(self.sorted[:, t], low[:, t], "left") for t in range(s.trees)], 1)
            last = np.stack([np.searchsorted(self.sorted[:, t], low[:, t] | below, "right") for t in range(s.trees)], 1)
            enough = np.zeros(len(waiting), bool)
            for k in np.flatnonzero((last - first).sum(1) >= least).tolist():
                parts = [self.order[a:b, t] for t, (a, b) in enumerate(zip(first[k].tolist(), last[k].tolist())) if b > a]
                mark = np.zeros(len(self.order), bool)
                for part in parts:
                    mark[part] = True
                found = np.flatnonzero(mark)
                if len(found) >= least or level == 0:
                    out[waiting[k]] = found
                    enough[k] = True
            waiting = waiting[~enough]
            if not len(waiting):
                break
        return out


def nearest(vectors: np.ndarray, queries: np.ndarray, found: list[np.ndarray], k: int):
    """The k nearest candidates of every query, and all that tie with the last of them."""
    squares = (vectors**2).sum(1)
    for q, places in zip(queries, found):
        rough = squares[places] - 2 * (vectors[places] @ q)
        if len(places) > k:
            # Rough values rank well enough to leave the far ones out, not to order the near ones.
            limit = np.partition(rough, k - 1)[k - 1]
            slack = 1e-9 * (abs(limit) + float(q @ q) + float(squares[places].max()))
            places = places[rough <= limit + slack]
        yield places, np.sqrt(((vectors[places] - q) ** 2).sum(1))


def valid_vectors(rows: DataFrame) -> DataFrame:
    """``vec_id, embedding`` as doubles of the rows that take part, equal rows once."""
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.col("vec_id").isNotNull() & finite & F.exists(vector, lambda x: x != 0)
    return rows.filter(F.coalesce(usable, F.lit(False))).select("vec_id", vector.alias("embedding")).distinct()


def search(rows: DataFrame, every: int = 100, settings: ForestSettings = ForestSettings()) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the nearest found for every query.

    ``rows`` is ``(vec_id, embedding)``; queries are the rows whose id is divisible by
    ``every``, candidates all rows of the same dimension with another id.  Distances
    are Euclidean in doubles, ties go to the smaller id.  Vectors that are null, zero
    or hold null or non-finite components take no part.  An id with several vectors is
    measured by the nearest of them.  Equal vectors are one entry of the index with as
    many of the smallest ids as can be among the nearest, so a common vector is no burden.
    """
    k = settings.neighbours
    usable = materialize(valid_vectors(rows))
    by_id = Window.partitionBy("embedding").orderBy("vec_id")
    few = usable.withColumn("_nth", F.row_number().over(by_id)).filter(F.col("_nth") <= k + 1)
    index = few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    index = materialize(index.withColumn("size", F.size("embedding")))
    queries = materialize(
        usable.filter(F.pmod("vec_id", F.lit(every)) == 0).withColumn("size", F.size("embedding"))
    )
    sample = index.orderBy(F.xxhash64("embedding")).limit(settings.sample).select("embedding", "size").toPandas()
    thresholds = {
        int(size): np.median(np.stack(part["embedding"].to_list()) @ planes(int(size), settings).T, axis=0)
        for size, part in sample.groupby("size")
    }
    blocks = max(1, math.ceil(index.count() / settings.block))
    query_blocks = max(1, math.ceil(queries.count() / settings.query_block))
    # Every block of queries meets every block of vectors; both are of bounded size.
    left = index.select(
        "size",
        F.pmod(F.xxhash64("embedding"), F.lit(blocks)).alias("vb"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))).alias("qb"),
        "embedding",
        "ids",
    )
    right = queries.select(
        "size",
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("vb"),
        F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(query_blocks)).alias("qb"),
        F.col("vec_id").alias("query_id"),
        "embedding",
    )

    def block(vectors: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(vectors) and len(asked):
            matrix = np.stack(vectors["embedding"].to_list())
            wanted = np.stack(asked["embedding"].to_list())
            ids = vectors["ids"].to_list()
            forest = Forest(matrix, thresholds.get(matrix.shape[1]), settings)
            # One more than asked for: the query may be the only id of its own entry.
            least = min(len(matrix), max(k + 1, math.ceil(settings.share * len(matrix))))
            found = forest.candidates(wanted, least)
            for query, (places, scores) in zip(asked["query_id"], nearest(matrix, wanted, found, k + 1)):
                hits = [(s, i) for p, s in zip(places.tolist(), scores.tolist()) for i in ids[p] if i != query]
                out += [(query, i, s) for s, i in sorted(hits)[: 2 * k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    keys = ["size", "vb", "qb"]
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(block, "query_id long, vec_id long, score double")
    hits = hits.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
