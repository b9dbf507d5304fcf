"""Joins of many rows with one row a key, where a key may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this part of all rows is hot; so there are fewer hot keys than this, whatever the data.
PARTS = 2048


def hot_keys(counted: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """keys and ``_salts`` (among how many the key is dealt) of the hot ones. counted: one row a key, with its rows ``n``.
    total: all rows, or an upper bound of them; no key is dealt so that more than total / PARTS rows stay together."""
    return counted.filter(F.col(n) * F.lit(PARTS) > F.lit(total)).select(*keys, F.ceil(F.col(n) * F.lit(PARTS) / F.lit(max(total, 1))).alias("_salts"))


def salted_join(many: DataFrame, one: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """many joined with one (at most a row a key) on keys, hot keys dealt among several tasks.

    The list of hot keys has fewer than ``PARTS`` rows and is broadcast. A row's salt is a hash of its columns, so that
    a task that is run again deals alike. Empty tables: empty result. Null keys join nothing."""
    salts = F.coalesce("_salts", F.lit(1).cast("long"))
    dealt = many.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*many.columns), salts)).drop("_salts")
    copies = one.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("_salts")
    return dealt.join(copies, [*keys, "_salt"]).drop("_salt")
