"""Skew-proof joins, ranks and running sums equal the plain ones."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from siterank.operators import skew

FORCE = {"broadcast_bytes": -1, "share": 0.05, "min_rows": 1}


@pytest.fixture(scope="module")
def big(spark):
    """A third of the rows share one key, some have none."""
    rows = spark.range(600).select(
        F.col("id").alias("row"),
        F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 40).alias("k"),
    )
    return rows.repartition(5)


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame([(k, f"v{k}") for k in range(0, 40, 2)] + [(0, "second")], "k long, v string")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join(big, small, how):
    want = sorted(map(str, big.join(small, ["k"], how).collect()))
    assert sorted(map(str, skew.salted_join(big, small, ["k"], ["row"], how, **FORCE).collect())) == want
    assert sorted(map(str, skew.salted_join(big, small, ["k"], ["row"], how).collect())) == want


def test_hot_key_is_split(big):
    heavy = skew.heavy_keys(big.groupBy("k").agg(F.count("*").alias("n")), ["k"], share=0.05, min_rows=1)
    rows = heavy.collect()
    assert [r.k for r in rows] == [0] and rows[0]._shares >= 6  # 200 of 600 rows in shares of 30


@pytest.mark.parametrize("limit", ["1000", "2"])
def test_rank_by_group(spark, big, limit):
    df = big.fillna(-1)
    w = Window.partitionBy("k").orderBy(F.desc("row"))
    want = sorted(map(tuple, df.withColumn("rank", F.row_number().over(w)).filter("rank <= 7").collect()))
    old = spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", limit)
    try:
        got = skew.rank_by_group(df, ["k"], [F.desc("row")], 7, ["row"])
        assert sorted(map(tuple, got.collect())) == want
    finally:
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", old)


@pytest.fixture(params=["true", "false"])
def coalesced(spark, request):
    """With and without the joining of small partitions."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, request.param)
    yield request.param == "true"
    spark.conf.set(key, old)


@pytest.mark.parametrize("by", [["k"], []])
def test_running_sums(big, by, coalesced):
    df = big.fillna(-1)
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("row", "k", F.sum("row").over(w).alias("s"), F.count("*").over(w).alias("n"))
    got = skew.running_sums(df, by, ["row"], {"s": F.col("row"), "n": F.lit(1)})
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_hot_group_lies_in_many_partitions(big, coalesced):
    df = big.fillna(-1).repartitionByRange("k", "row").withColumn("p", F.spark_partition_id())
    assert coalesced or df.filter("k = 0").select("p").distinct().count() > 1


def test_rank_by_group_without_limit(spark, big, coalesced):
    """All rows of all groups have their rank, a null group too; the hot group is ranked in many tasks."""
    df = big.filter("k != 3 or k is null").withColumn("x", F.when(F.col("row") % 5 > 0, F.col("row") % 50 / 7))
    order = [F.col("x").desc_nulls_last(), F.asc("row")]
    w = Window.partitionBy("k").orderBy(*order)
    want = df.withColumn("rank", F.row_number().over(w))
    got = skew.rank_by_group(df, ["k"], order, None, ["row"])
    assert got.schema["rank"].dataType == want.schema["rank"].dataType
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
