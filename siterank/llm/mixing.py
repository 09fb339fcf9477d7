"""Mixing sources to target weights by a splitting tree of exact block quotas.

Documents of a source are put in a random order (by the MD5 of their id) and cut into
blocks of about equal word counts.  What the mix takes of a source is a number of its
blocks.  A tree splits the vector of these quotas among the output shards: every inner
node draws, from a multivariate hypergeometric distribution, how many blocks of each
source go to its left half; the leaves are exact quotas that add up to the whole.  The
shards of a source then take disjoint runs of its permuted blocks, and every shard
shuffles what it got by a hash of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siterank.llm.tables import WORD
from siterank.operators.skew import salted_join
from siterank.session import broadcast_limit, estimated_bytes, materialize


@dataclass(frozen=True)
class Mix:
    """Settings of a mix; ``weights`` repeat over the sources in order of code points."""

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    most: int = 2
    shards: int = 8
    block_words: int = 20_000
    seed: int = 7


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """``source, rank, source_size, target`` from ``(source, source_size)``, null last.

    Targets share ``share`` of all words by weight, at most ``most`` times the source's
    size each; what a capped source leaves is shared again by weight.  In order of the
    ratio of size to weight the capped sources come first, so running sums give the
    level of the others at once.  One row per source, pre-aggregated.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    n = len(mix.weights)
    weights = F.array(*[F.lit(w) for w in mix.weights])
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.element_at(weights, (F.col("rank") % n + 1).cast("int")).cast("double")
    )
    ratio = F.col("source_size") * F.lit(float(mix.most)) / F.col("weight")
    before = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = (
        ranked.withColumn("ratio", ratio)
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(mix.share))
        .withColumn("capped", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(float(mix.most)))
        .withColumn("left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("budget") - F.col("capped")) / F.col("left"))
        # Levels rise up to the first source, by ratio, that is not capped, and fall after it.
        .withColumn("common", F.max("level").over(every))
    )
    cap = F.col("source_size") * F.lit(float(mix.most))
    return levels.select(
        *[c for c in sizes.columns if c != "source_size"],
        "rank",
        "source_size",
        F.least(cap, F.col("common") * F.col("weight")).alias("target"),
    )


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Quotas of ``shards`` leaves, one row each, from the root's vector of block counts."""
    if shards == 1 or not len(quotas):
        return np.repeat(quotas[None, :], shards, axis=0) if len(quotas) else np.zeros((shards, 0), np.int64)
    left = shards // 2
    total = int(quotas.sum())
    drawn = total * left // shards
    # As NumPy's marginals method, without its limit on the sum: one source after another.
    first = np.zeros_like(quotas)
    rest, want = total, drawn
    for i, q in enumerate(quotas.tolist()):
        rest -= q
        if q and want:
            first[i] = rng.hypergeometric(q, rest, want) if rest else want
            want -= int(first[i])
    return np.concatenate([split_quotas(first, left, rng), split_quotas(quotas - first, shards - left, rng)])


def shard_quotas(blocks: DataFrame, mix: Mix) -> DataFrame:
    """``rank, n_blocks, ends``: after how many drawn blocks of the source each shard's run ends.

    The input is one row per source with ``draws``; the tree needs the whole vector of
    sources and nothing that grows with the documents.
    """

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        given = [frame for frame in frames if len(frame)]
        if given:
            frame = pd.concat(given).sort_values("rank")
            leaves = split_quotas(frame["draws"].to_numpy(np.int64), mix.shards, np.random.default_rng(mix.seed))
            yield frame[["rank", "n_blocks"]].assign(ends=list(np.cumsum(leaves, 0).T))

    return blocks.coalesce(1).mapInPandas(split, "rank int, n_blocks long, ends array<long>")


def mix_sources(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Add ``size, source_size, target, placements`` to every document.

    ``size`` is the number of words of ``text``; without a text the column ``size`` that
    came with the documents counts.

    ``placements`` is an array of ``(pass, shard, place, words)``: whole passes over the
    document, and of the last pass as many of its first words as the target still
    asks for.  The words of a source add up to its target, rounded.  ``place`` orders
    the documents of a shard.  The order of a source is that of the MD5 of the
    document id; rows with equal ids follow by size, and equal rows are alike.  Null
    texts have size 0; a null source is one source, the last.  Columns of the added
    names are replaced.

    Windows over documents are those of one block, which is bounded by its words; what
    goes beyond a block is summed up over one row per block, so a source with a third
    of all rows is no burden.
    """
    sized = word_count() if "text" in docs.columns else F.coalesce("size", F.lit(0)).cast("long")
    added = ["source_size", "target", "placements"]
    rows = docs.drop(*[c for c in added if c in docs.columns])
    kept = [c for c in rows.columns if c != "size"]
    code = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 12)
    rows = materialize(
        rows.withColumns(
            {
                "size": sized,
                "_order": F.conv(code, 16, 10).cast("long"),
                "_key": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")),
            }
        )
    )
    sizes = rows.groupBy("_key", "source").agg(F.sum("size").alias("source_size"))
    words, size = F.round("target").cast("long"), F.col("source_size")
    full = F.when(size > 0, F.floor(words / size)).otherwise(0).cast("long")
    sources = source_targets(sizes, mix).select(
        "_key",
        "rank",
        "source_size",
        "target",
        F.greatest(F.lit(1), F.ceil(size / F.lit(mix.block_words))).cast("long").alias("_blocks"),
        full.alias("_full"),
        (words - full * size).alias("_more"),
    )
    sources = materialize(sources)
    placed = salted_join(rows, sources, ["_key"], ["_order"])
    # Order is uniform over 48 bits: its leading part numbers the blocks.
    placed = placed.withColumn("_block", F.floor(F.col("_order") / F.lit(float(1 << 48)) * F.col("_blocks")))
    blocks = placed.groupBy("rank", "_block").agg(F.sum("size").alias("_block_size"))
    earlier = Window.partitionBy("rank").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counted = Window.partitionBy("rank").orderBy("_block")
    blocks = materialize(blocks.select(
        "rank",
        "_block",
        F.coalesce(F.sum("_block_size").over(earlier), F.lit(0)).alias("_before"),
        (F.row_number().over(counted) - 1).cast("long").alias("_nth"),
    ))
    # Draws of a source: every block once per whole pass, then the blocks of the rest.
    draws = (
        blocks.join(sources, "rank")
        .groupBy("rank")
        .agg(
            F.count(F.lit(1)).alias("n_blocks"),
            F.sum(F.col("_full") + (F.col("_before") < F.col("_more")).cast("long")).alias("draws"),
        )
    )
    ends = materialize(shard_quotas(draws, mix))
    within = (
        Window.partitionBy("rank", "_block")
        .orderBy("_order", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = (
        placed.join(blocks, ["rank", "_block"])
        .withColumn("_before", F.col("_before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(F.broadcast(ends) if estimated_bytes(ends) <= broadcast_limit(docs.sparkSession) else ends, "rank")
    )
    rest = F.greatest(F.lit(0), F.least("size", F.col("_more") - F.col("_before")))

    def place(number):
        nth = number * F.col("n_blocks") + F.col("_nth")
        return F.struct(
            number.cast("int").alias("pass"),
            F.size(F.filter("ends", lambda e: e <= nth)).alias("shard"),
            F.xxhash64(F.lit(mix.seed), number, "_order", "doc_id").alias("place"),
            F.when(number < F.col("_full"), F.col("size")).otherwise(rest).alias("words"),
        )

    passes = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_full").cast("long")), place)
    return placed.select(
        *kept,
        "size",
        "source_size",
        "target",
        F.filter(passes, lambda p: p["words"] > 0).alias("placements"),
    )


def taken_words():
    """What the mix takes of a document, repeats counted."""
    return F.aggregate("placements", F.lit(0).cast("long"), lambda total, p: total + p["words"])


def mixed_documents(placed: DataFrame, columns: list[str]) -> DataFrame:
    """One row per placement, ``columns`` with ``text`` cut to the words the mix takes."""
    rows = placed.select(*columns, F.col("size").alias("_size"), F.explode("placements").alias("_place"))
    # Only the last document a source gives can be cut.
    steps = F.regexp_extract_all(F.col("text"), F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), 1)
    head = F.array_join(F.slice(steps, 1, F.col("_place.words").cast("int")), "")
    text = F.when(F.col("_place.words") < F.col("_size"), head).otherwise(F.col("text"))
    return rows.withColumn("text", text).drop("_size")


def whole_words():
    """Words of a placement when its document is taken whole or not at all, whichever is nearer to the target."""
    words = F.col("_place.words")
    return F.when(words * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0).cast("long"))


def whole_documents(placed: DataFrame, columns: list[str]) -> DataFrame:
    """One row per placement, texts whole: the last document of a source is not cut."""
    rows = placed.select(*columns, "size", F.explode("placements").alias("_place"))
    return rows.filter(whole_words() > 0).select(*columns, "_place")


def source_differences(placed: DataFrame) -> DataFrame:
    """``source, target, taken, difference``: words of ``whole_documents`` against the target, per source."""
    rows = placed.select("source", "target", "size", F.explode_outer("placements").alias("_place"))
    taken = F.coalesce(F.sum(F.when(F.col("_place").isNotNull(), whole_words())), F.lit(0).cast("long"))
    found = rows.groupBy("source", "target").agg(taken.alias("taken"))
    return found.withColumn("difference", F.col("taken") - F.col("target"))
