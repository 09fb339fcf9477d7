"""Joins, top-N and running sums that hold when one key has a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siterank.session import broadcast_limit, estimated_bytes, materialize

# A key is heavy when it holds more than this share of the rows, so there are
# never more than 1 / HEAVY_SHARE heavy keys: safe to broadcast at any scale.
HEAVY_SHARE = 1 / 1000
# Below this many rows a key is no burden whatever its share.
HEAVY_ROWS = 200_000
# A ranked group is first ranked in this many shares ...
RANK_SHARES = 256
# ... when so many of its rows are kept that those of all tasks are a burden for one.
RANK_WHOLE = 100


def heavy_keys(
    counts: DataFrame,
    keys: Sequence[str],
    n: str = "n",
    share: float = HEAVY_SHARE,
    min_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """Heavy keys of a ``(keys, n)`` table and the number of shares each is split into.

    Every share is at most ``max(share * total, min_rows)`` rows on average.  The
    result has at most ``1 / share`` rows and its ``_shares`` add up to at most
    ``2 / share``, whatever the size of the table.
    """
    total = counts.agg(F.sum(n)).scalar()
    limit = F.greatest(total * F.lit(share), F.lit(float(min_rows)))
    return counts.filter(F.col(n) > limit).select(
        *keys, F.ceil(F.col(n) / limit).cast("int").alias("_shares")
    )


def salted_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    counts: DataFrame | None = None,
    n: str = "n",
    share: float = HEAVY_SHARE,
    min_rows: int = HEAVY_ROWS,
    broadcast_bytes: int | None = None,
) -> DataFrame:
    """Equi-join of ``big`` (skewed on ``keys``) with ``small``.

    If ``small`` is known to be within the broadcast limit of the session (or
    ``broadcast_bytes``), it is broadcast and ``big`` stays where it is.  Otherwise
    the rows of a heavy key are split by a hash of ``spread`` and the matching rows
    of ``small`` are repeated once per share.  ``counts`` is a ``(keys, n)`` table of
    the rows of ``big`` per key, if the caller has one already.  ``how`` must keep
    the rows of ``small`` only where they match (inner, left, semi, anti).
    """
    keys = list(keys)
    limit = broadcast_limit(big.sparkSession) if broadcast_bytes is None else broadcast_bytes
    if estimated_bytes(small) <= limit:
        return big.join(F.broadcast(small), keys, how)
    if counts is None:
        counts = big.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    # At most 1 / share rows, see heavy_keys; written first so that it is found once.
    heavy = F.broadcast(materialize(heavy_keys(counts, keys, n, share, min_rows)))
    shares = F.coalesce("_shares", F.lit(1))
    # Null keys match nothing: scatter them instead of sending them to one task.
    no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    left = (
        big.join(heavy, keys, "left")
        .withColumn(
            "_salt",
            F.pmod(F.xxhash64(*spread), F.when(no_key, F.lit(RANK_SHARES)).otherwise(shares)),
        )
        .drop("_shares")
    )
    right = (
        small.join(heavy, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), shares - 1)))
        .withColumn("_salt", F.col("_salt").cast("bigint"))
        .drop("_shares")
    )
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def rank_by_group(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    n: int | None,
    spread: Sequence[str],
    rank: str = "rank",
    shares: int = RANK_SHARES,
) -> DataFrame:
    """The first ``n`` rows of every group with their rank, exactly; all rows if ``n`` is None.

    Up to the window group limit of the session, Spark itself drops all but ``n``
    rows of a group in every task before the shuffle.  Above ``RANK_WHOLE`` a group is
    ranked in shares first and only the winners of the shares meet in one task, so no
    task sees more than ``shares * n`` rows of a group.  ``order`` must end in a unique
    key and ``spread`` should tell the rows of a group apart.  Without a limit the ranks are
    running counts, so a group of any size is many tasks.
    """
    if n is None:
        # A struct is not null where its fields are.
        grouped = df.withColumn("_by", F.struct(*by))
        return running_sums(grouped, ["_by"], order, {rank: F.lit(1)}).withColumn(rank, F.col(rank).cast("int")).drop("_by")
    in_group = Window.partitionBy(*by).orderBy(*order)
    if n > RANK_WHOLE:
        in_share = Window.partitionBy(*by, "_share").orderBy(*order)
        df = (
            df.withColumn("_share", F.pmod(F.xxhash64(*spread), F.lit(shares)))
            .withColumn(rank, F.row_number().over(in_share))
            .filter(F.col(rank) <= n)
            .drop("_share", rank)
        )
    return df.withColumn(rank, F.row_number().over(in_group)).filter(F.col(rank) <= n)


def running_sums(
    df: DataFrame, by: Sequence[str], order: Sequence[str | Column], sums: dict[str, Column]
) -> DataFrame:
    """Add, per group and in order, the sum of all rows up to and including this one.

    The rows are range-partitioned by group and order, so a large group lies in
    many partitions.  Each partition sums up on its own; what earlier partitions
    hold of the same group is added as a carry.  Only the first group of a
    partition can have one, so the carries are at most one row per partition.
    ``order`` must be unique within a group and the columns of ``by`` not null.
    """
    by, order = list(by), list(order)
    # The partition number must not change between the two uses below.
    parts = materialize(
        df.repartitionByRange(*by, *order)
        .withColumn("_part", F.spark_partition_id())
        .withColumns({f"_v_{name}": value for name, value in sums.items()})
    )
    totals = parts.groupBy(*by, "_part").agg(
        *[F.sum(f"_v_{name}").alias(f"_v_{name}") for name in sums]
    )
    # One row per partition of a group: its window is bounded by their number.
    before = (
        Window.partitionBy(*(by or [F.lit(0)]))
        .orderBy("_part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carries = totals.select(
        *by, "_part", *[F.sum(f"_v_{name}").over(before).alias(f"_c_{name}") for name in sums]
    ).filter(reduce(lambda a, b: a | b, [F.col(f"_c_{name}").isNotNull() for name in sums]))
    running = (
        Window.partitionBy(*by, "_part")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    within = parts.withColumns({name: F.sum(f"_v_{name}").over(running) for name in sums})
    return within.join(F.broadcast(carries), [*by, "_part"], "left").select(
        *df.columns,
        *[(F.col(name) + F.coalesce(f"_c_{name}", F.lit(0))).alias(name) for name in sums],
    )
