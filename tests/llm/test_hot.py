"""Joins with hot keys against plain joins."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from listingspark.llm.hot import PARTS, hot_keys, salted_join


@pytest.mark.parametrize("rows", [0, 1, 20_000])
def test_salted_join_is_a_join(spark, rows):
    # a third of the rows has one key, some have none, and rows repeat
    key = F.when(F.col("id") % 3 == 0, F.lit(0)).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") % 4001)
    many = spark.range(rows).select(key.alias("k"), (F.col("id") % 5000).alias("v"))
    one = many.filter("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("m")).filter("n > 1")
    hot = hot_keys(one, ["k"], "n", many.count())
    assert hot.count() < PARTS
    got = sorted(map(tuple, salted_join(many, one, ["k"], hot).select("k", "v", "n", "m").collect()))
    assert got == sorted(map(tuple, many.join(one, "k").select("k", "v", "n", "m").collect()))


def test_hot_keys_are_dealt_among_several(spark):
    counted = spark.createDataFrame([("a", 1_000_000), ("b", 400), ("c", 600)], "k string, n long")
    assert sorted(map(tuple, hot_keys(counted, ["k"], "n", 1_024_000).collect())) == [("a", 2000), ("c", 2)]
