"""References from sketches by key and month, merged for any window of months.

Months that are past don't change, so a reference that moves on by a month reads the new month's sales and merges small
sketches of the others. Counts, sums and bounds are exact; quantiles come from KLL sketches and numbers of different values
from HLL ones, both of a bounded size and mergeable. ``prices.trimmed_reference`` is the exact way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of KLL sketches: with 1024 the rank of a quantile is off by some 0.3 %.
SIZE = 1024
MONTH = "month_"


def month_of(day: Column) -> Column:
    """Months as whole numbers, twelve a year."""
    return F.year(day) * 12 + F.month(day) - 1


def monthly_sketches(sales: DataFrame, keys: list[str], value: str, day: str, distinct: list[str] | None = None, *, size: int = SIZE) -> DataFrame:
    """A row for each key and month: n, total, least, most and ``values_`` (KLL sketch) of the values, and a sketch ``distinct_c`` for
    each column c of ``distinct``. Rows without a value or a day are left out. A key of very many sales is summed up in
    each task first, so only sketches are shuffled."""
    known = sales.filter(F.col(value).isNotNull() & F.col(day).isNotNull() & ~F.isnan(F.col(value).cast("double"))).withColumn(MONTH, month_of(F.col(day)))
    x = F.col(value).cast("double")
    more = [F.hll_sketch_agg(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(f"distinct_{c}") for c in distinct or []]
    return known.groupBy(*keys, MONTH).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("total"), F.min(x).alias("least"), F.max(x).alias("most"), F.kll_sketch_agg_double(x, F.lit(size)).alias("values_"), *more)


def merged_reference(months: DataFrame, keys: list[str], as_of: Column, span: int, probs: list[float], *, trim: tuple[float, float] = (0.0, 1.0), min_n: int = 1) -> DataFrame:
    """By key, over the ``span`` months before that of ``as_of``: n, mean, least, most, q (a quantile for each of ``probs``, of
    the values between the trim quantiles) and the number n_c of different values of each sketched column c. Keys of
    fewer than ``min_n`` sales have no row."""
    last = month_of(as_of)
    window = months.filter((F.col(MONTH) < last) & (F.col(MONTH) >= last - span))
    columns = [c.removeprefix("distinct_") for c in months.columns if c.startswith("distinct_")]
    counts = [F.hll_sketch_estimate(F.hll_union_agg(f"distinct_{c}")).alias(f"n_{c}") for c in columns]
    merged = window.groupBy(*keys).agg(F.sum("n").alias("n"), F.try_divide(F.sum("total"), F.sum("n")).alias("mean"), F.min("least").alias("least"), F.max("most").alias("most"), F.kll_merge_agg_double("values_").alias("_all"), *counts)
    at = F.array(*[F.lit(trim[0] + p * (trim[1] - trim[0])) for p in probs])
    return merged.filter(F.col("n") >= min_n).withColumn("q", F.kll_sketch_get_quantile_double("_all", at)).drop("_all")


def add_months(spark: SparkSession, path: str, sales: DataFrame, keys: list[str], value: str, day: str, months: range, distinct: list[str] | None = None, *, size: int = SIZE) -> None:
    """Write the sketches of ``months`` (numbers as ``month_of`` gives) to the table at ``path``, a folder for each month; others
    stay and aren't read. The filter is on ``day``, so that it reaches the scan of the sales."""
    first, end = (F.make_date(F.lit(m // 12), F.lit(m % 12 + 1), F.lit(1)) for m in (months.start, months.stop))
    part = sales.filter((F.col(day) >= first) & (F.col(day) < end))
    monthly_sketches(part, keys, value, day, distinct, size=size).repartition(MONTH).write.partitionBy(MONTH).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
