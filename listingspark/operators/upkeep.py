"""Nearest comparables kept up to date: what a batch of sales can't change isn't computed again.

The kept table holds the nearest rows of each subject, as ``comparables.nearest`` gives them. A new row of the pool changes a
subject only if the subject has fewer than k rows, or if the new row comes before the subject's last one. So the batch
alone is searched, what doesn't come before the last kept row is left out, and only subjects with something left are
ranked again; the others keep their rows. Rows that leave the pool concern the subjects that hold them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Subjects and pool rows -> the nearest rows of each subject, with distance and rank.
Search = Callable[[DataFrame, DataFrame], DataFrame]


def first_nearest(subjects: DataFrame, pool: DataFrame, search: Search) -> DataFrame:
    """The kept table of a first load: the search's result and touched (how many loads have changed the subject's rows)."""
    return search(subjects, pool).withColumn("touched", F.lit(1))


def add_to_nearest(kept: DataFrame, subjects: DataFrame, batch: DataFrame, search: Search, *, subject_key: list[str], pool_key: list[str], k: int) -> DataFrame:
    """The kept table after ``batch`` has joined the pool: equal to a search in the whole pool, as long as distances of rows that
    are in it already don't change. A row of the pool may be in one batch only. An empty batch changes nothing; an empty
    kept table is that of a first load. The result reads ``kept``, so write it somewhere else."""
    place = F.struct(F.isnull("distance"), "distance", *pool_key)
    last = kept.groupBy(*subject_key).agg(F.count(F.lit(1)).alias("_n"), F.max(place).alias("_last"), F.max("touched").alias("_touched"))
    found = search(subjects, batch).drop("rank").join(last, subject_key, "left")
    better = found.filter(F.col("_n").isNull() | (F.col("_n") < k) | (place < F.col("_last")))
    touched = better.select(*subject_key, F.coalesce("_touched", F.lit(0)).alias("_before")).distinct()
    both = kept.drop("rank").join(touched.drop("_before"), subject_key, "left_semi").unionByName(better.drop("_n", "_last", "_touched").withColumn("touched", F.lit(0)))
    order = Window.partitionBy(*subject_key).orderBy(F.asc_nulls_last("distance"), *pool_key)
    again = both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).join(touched, subject_key).withColumn("touched", F.col("_before") + 1).drop("_before")
    return kept.join(touched, subject_key, "left_anti").unionByName(again)


def drop_from_nearest(kept: DataFrame, subjects: DataFrame, pool: DataFrame, gone: DataFrame, search: Search, *, subject_key: list[str], pool_key: list[str]) -> DataFrame:
    """The kept table after the rows ``gone`` (their pool_key) have left ``pool``: subjects that hold one of them are searched
    again, in the pool without them. A subject that finds nothing has no row."""
    hit = kept.join(gone.select(*pool_key).distinct(), pool_key, "left_semi").groupBy(*subject_key).agg(F.max("touched").alias("_touched"))
    again = search(subjects.join(hit, subject_key, "left_semi"), pool.join(gone, pool_key, "left_anti"))
    again = again.join(hit, subject_key).withColumn("touched", F.col("_touched") + 1).drop("_touched")
    return kept.join(hit, subject_key, "left_anti").unionByName(again)


def change_subjects(kept: DataFrame, changed: DataFrame, pool: DataFrame, search: Search, *, subject_key: list[str]) -> DataFrame:
    """The kept table after the subjects ``changed`` are new or have other values: these alone are searched."""
    before = kept.join(changed.select(*subject_key), subject_key, "left_semi").groupBy(*subject_key).agg(F.max("touched").alias("_touched"))
    again = search(changed, pool).join(before, subject_key, "left").withColumn("touched", F.coalesce("_touched", F.lit(0)) + 1).drop("_touched")
    return kept.join(changed, subject_key, "left_anti").unionByName(again)
