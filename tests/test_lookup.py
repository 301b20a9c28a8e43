"""Lookups: broadcast, salted, skewed and keyless."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from closebook.operators import lookup as K


@pytest.fixture
def skewed(spark):
    """A third of all rows under one key, a tenth without key, some unmatched."""
    key = F.expr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 10 = 1 THEN NULL ELSE concat('k', id % 50) END")
    return spark.range(3000).select("id", key.alias("k"))


@pytest.fixture
def values(spark):
    return spark.range(40).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("v")).union(
        spark.sql("SELECT 'hot', -1L")
    )


def rows(df):
    return sorted(df.collect(), key=str)


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_equals_plain(skewed, values, how):
    plain = skewed.join(values, "k", how)
    salted = K.salted_join(skewed, values, ["k"], how, rows_per_piece=10)
    assert rows(salted.select(plain.columns)) == rows(plain)
    assert rows(K.lookup_join(skewed, values, ["k"], how).select(plain.columns)) == rows(plain)


def test_hot_key_is_spread(skewed, values):
    hot = {r["k"]: r["_pieces"] for r in K.hot_keys(skewed, ["k"], 100).collect()}
    assert hot == {"hot": 10}
    spark = skewed.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = K.salted_join(skewed, values, ["k"], rows_per_piece=10)
        parts = joined.groupBy(F.spark_partition_id().alias("p"), "k").count()
        seen = {(r["k"], r["p"]): r["count"] for r in parts.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    for key, total in (("hot", 1000), (None, 200)):
        shares = [n for (k, _), n in seen.items() if k == key]
        assert sum(shares) == total and len(shares) == 4 and max(shares) < total / 2


def test_all_keys_above_a_share_are_hot(spark):
    facts = spark.range(4400).selectExpr("CASE WHEN id < 4000 THEN id % 3 ELSE id END AS k")
    hot = {r["k"]: r["_pieces"] for r in K.hot_keys(facts, ["k"], 50).collect()}
    assert hot == {0: 27, 1: 27, 2: 27}


def test_more_than_a_thousand_hot_keys(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "1200")
    try:
        facts = spark.range(11_000).selectExpr("id % 1100 AS k")
        hot = K.hot_keys(facts, ["k"], 5)
        assert hot.count() == 1100
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_keys_counted_on_an_earlier_stage(skewed, values):
    plain = skewed.join(values, "k", "left")
    salted = K.salted_join(skewed.withColumn("x", F.lit(1)), values, ["k"], counted=skewed, rows_per_piece=10)
    assert rows(salted.select(plain.columns)) == rows(plain)


def test_size_check(spark):
    small = spark.range(10)
    assert K.measured_small(small)
    assert not K.measured_small(small, max_rows=9)
    assert not K.measured_small(spark.range(1).select(F.repeat(F.lit("x"), 100).alias("t")), max_bytes=50)
    assert K.measured_small(small.filter("id < 0"))


def test_large_lookup_is_not_broadcast_whole(spark, skewed, values):
    plan = K.lookup_join(skewed, values, ["k"], small=False)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in text  # the hot keys only
    assert text.count("strategy=broadcast") == 2


def test_keep_last(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, None), ("a", 2, "y"), ("b", 1, "z")], "k string, n int, v string")
    assert rows(K.keep_last(df, ["k"], ["n"])) == [("a", 3, None), ("b", 1, "z")]
