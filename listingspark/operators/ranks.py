"""Ranks and exact quantiles of keys that may hold most rows: sorted in range partitions, so that no key is in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import Workspace, in_order


def running_by_key(ws: Workspace, df: DataFrame, keys: list[str], order: list[Column], amount: str) -> DataFrame:
    """df with ``upto`` (sum of ``amount`` over the key's rows up to this one in ``order``) and ``all`` (the key's sum).

    Rows are sorted by key and order in range partitions; of each partition there is a total for each key in it, which are
    as many rows as partitions and keys together. Null keys are a key of their own."""
    named = [f"_key{i}" for i in range(len(keys))]
    # null-safe keys: whether it is null, and its value
    df = df.withColumns({n: F.struct(F.col(k).isNull().alias("none"), F.col(k).alias("value")) for n, k in zip(named, keys, strict=True)})
    table = in_order(ws, df, [*map(F.col, named), *order], "ranked", "_number").withColumn("_part", F.shiftright("_number", 33))
    totals = table.groupBy("_part", *named).agg(F.sum(amount).alias("_total"))
    own = Window.partitionBy(*named)
    before = F.coalesce(F.sum("_total").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = ws.write(totals.select("_part", *named, before.alias("_before"), F.sum("_total").over(own).alias("all")), "totals")
    inside = Window.partitionBy("_part", *named).orderBy("_number").rowsBetween(Window.unboundedPreceding, 0)
    # keys were compared with their nulls told apart, so that joining them by their parts loses none
    parts = lambda d: d.withColumns({f"{n}_{x}": F.coalesce(F.col(n)[x].cast("string"), F.lit("")) for n in named for x in ("none", "value")})
    on = ["_part", *[f"{n}_{x}" for n in named for x in ("none", "value")]]
    summed = parts(table.withColumn("_inside", F.sum(amount).over(inside)))
    out = summed.join(parts(totals).drop(*named), on).withColumn("upto", F.col("_before") + F.col("_inside"))
    return out.drop("_number", "_inside", "_before", *named, *on)


def spread_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """keys, n and q (array, one for each of ``probs``): interpolated quantiles as ``percentile`` gives, for few keys of very
    many different values. Null values are left out; keys without any have no row."""
    ws = Workspace(df.sparkSession, "quantiles")
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_by_key(ws, counted, keys, [F.col("_value")], "_n")
    at = [(F.col("all") - 1) * p for p in probs]
    holds = lambda place: (place < F.col("upto")) & (place >= F.col("upto") - F.col("_n"))
    ends = [f(h) for h in at for f in (F.floor, F.ceil)]
    wanted = ranked.filter(sum((holds(e).cast("int") for e in ends), F.lit(0)) > 0)
    picks = [F.max(F.when(holds(e), F.col("_value"))).alias(f"_{i}") for i, e in enumerate(ends)]
    out = wanted.groupBy(*keys).agg(F.max("all").alias("n"), *picks)
    share = [(F.col("n") - 1) * p - F.floor((F.col("n") - 1) * p) for p in probs]
    # between equal values nothing is added up, as parts of a value may not sum up to it again
    q = [F.when(F.col(f"_{2 * i}") == F.col(f"_{2 * i + 1}"), F.col(f"_{2 * i}")).otherwise(F.col(f"_{2 * i}") * (1 - s) + F.col(f"_{2 * i + 1}") * s) for i, s in enumerate(share)]
    return out.select(*keys, "n", F.array(*q).alias("q"))


def spread_rank(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """df with the row's number in its key, as ``row_number`` gives."""
    ws = Workspace(df.sparkSession, "rank")
    return running_by_key(ws, df.withColumn("_one", F.lit(1).cast("long")), keys, order, "_one").withColumn(name, F.col("upto").cast("int")).drop("upto", "all", "_one")
