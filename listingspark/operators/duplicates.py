"""One advert on several sites: groups by chained price steps, representatives, sources of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicate_groups(df: DataFrame, *, block: list[str], value: str, tie: list[str], ratio: float = 1.03, eligible: Column | None = None) -> DataFrame:
    """``group``: number of the price step in its block. Ordered by value, a row more than ``ratio`` times the one before
    starts a new group, so steps chain. Rows that aren't eligible have no group. Blocks stay small by their nature; the
    frequent ones are split by Spark's sort, not held in memory."""
    eligible = F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False))
    w = Window.partitionBy("_own", *block).orderBy(value, *tie)
    df = df.withColumn("_own", eligible)
    before = F.lag(value).over(w)
    df = df.withColumn("_step", F.when(before.isNull() | (F.col(value) > before * ratio), 1).otherwise(0))
    total = F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("group", F.when(F.col("_own"), total)).drop("_own", "_step")


def representatives(df: DataFrame, *, group: list[str], richness: Column, tie: list[str], source: str) -> DataFrame:
    """``rank`` in the group by richness, ``n_copies``, and the group's sorted distinct sources; rows whose group is null
    are alone."""
    alone = F.col(group[-1]).isNull()
    order = Window.partitionBy(*group).orderBy(richness.desc(), *tie)
    whole = Window.partitionBy(*group)
    return df.withColumns(
        {
            "rank": F.when(alone, 1).otherwise(F.row_number().over(order)),
            "n_copies": F.when(alone, F.lit(1).cast("long")).otherwise(F.count(F.lit(1)).over(whole)),
            "sources": F.when(~alone, F.array_sort(F.collect_set(source).over(whole))),
        }
    )
