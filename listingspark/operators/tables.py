"""Bronze-to-silver table operators: dedup, latest rows, upserts with column policies, widening, imputation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rank_in(keys: list[str | Column], order: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``. Spark keeps one row of a key before the shuffle already."""
    return df.withColumn("_rank", rank_in(keys, order)).filter("_rank = 1").drop("_rank")


def dedup_first(df: DataFrame, identities: list[str], order: list[Column]) -> DataFrame:
    """The first row of each identity, which is the first of ``identities`` that is not null; rows without stay."""
    kinds = F.coalesce(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}:"), F.col(c).cast("string"))) for c in identities])
    df = df.withColumn("_identity", kinds)
    first = latest_per_key(df.filter("_identity is not null"), ["_identity"], order)
    return first.unionByName(df.filter("_identity is null")).drop("_identity")


def compact(df: DataFrame, identities: list[str], newest: list[Column]) -> DataFrame:
    """The newest row of each identity; of rows without one, equal rows once."""
    kinds = F.coalesce(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}:"), F.col(c).cast("string"))) for c in identities])
    df = df.withColumn("_identity", kinds)
    return latest_per_key(df.filter("_identity is not null"), ["_identity"], newest).unionByName(df.filter("_identity is null").distinct()).drop("_identity")


def widened(a: T.DataType, b: T.DataType) -> T.DataType:
    return a if a == b else T.StringType()


def as_type(df: DataFrame, name: str, want: T.DataType) -> Column:
    have = df.schema[name].dataType
    if have == want:
        return F.col(name)
    return F.to_json(name) if isinstance(have, T.ArrayType | T.MapType | T.StructType) else F.col(name).cast(want)


def append_bronze(old: DataFrame | None, batch: DataFrame, collected_at: Column) -> DataFrame:
    """``batch`` below ``old``: unseen columns are added, missing ones are null, and a column whose types differ becomes
    a string on both sides, so that no row is lost. The batch is stamped with _collected_at."""
    batch = batch.withColumn("_collected_at", collected_at)
    if old is None:
        return batch
    types = {c: widened(old.schema[c].dataType, batch.schema[c].dataType) for c in old.columns if c in batch.columns}
    cast = lambda df: df.select(*[as_type(df, c, types[c]).alias(c) if c in types else F.col(c) for c in df.columns])
    return cast(old).unionByName(cast(batch), allowMissingColumns=True)


def ensure_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in df.columns})


def upsert(target: DataFrame, incoming: DataFrame, keys: list[str], policy: dict[str, str]) -> DataFrame:
    """A new snapshot of ``target``. policy by column: ``overwrite`` (the incoming value of a matched row, null too), ``keep``
    (the old value where the incoming one is null) or ``insert`` (the old value of a matched row). Columns without a
    policy are overwritten. A full outer join, as Parquet tables know no MERGE."""
    columns = [c for c in target.columns if c not in keys]
    a = target.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in columns], F.lit(True).alias("_old"))
    b = incoming.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_new"))

    def value(c: str) -> Column:
        old, new = F.col(f"_old_{c}"), F.col(f"_new_{c}")
        match policy.get(c, "overwrite"):
            case "keep":
                return F.coalesce(new, old)
            case "insert":
                return F.when(F.col("_old").isNotNull(), old).otherwise(new)
            case _:
                return F.when(F.col("_new").isNotNull(), new).otherwise(old)

    return a.join(b, keys, "full_outer").select(*keys, *[value(c).alias(c) for c in columns])


def update_from(target: DataFrame, source: DataFrame, keys: list[str], values: dict[str, Column], order: list[Column] | None = None) -> DataFrame:
    """A new snapshot of ``target`` in which rows with a row of ``source`` have the values: expressions of the target's columns and
    of the source's, whose names have ``new_`` before them. order: which of a key's rows in source counts; without it
    keys must be unique there, or the target's rows are doubled. Other rows, and null keys, stay as they are."""
    one = source if order is None else latest_per_key(source, keys, order)
    more = [c for c in source.columns if c not in keys]
    both = target.join(one.select(*keys, *[F.col(c).alias(f"new_{c}") for c in more], F.lit(True).alias("_met")), keys, "left")
    updated = {c: F.when(F.col("_met"), v.cast(target.schema[c].dataType)).otherwise(F.col(c)).alias(c) for c, v in values.items()}
    return both.select(*[updated.get(c, F.col(c)) for c in target.columns])


def apply_policy(df: DataFrame, drop: Column) -> DataFrame:
    """Rows that ``drop`` is not true for."""
    return df.filter(~F.coalesce(drop, F.lit(False)))


def impute_mode(df: DataFrame, source: DataFrame, on: list[str], value: str) -> DataFrame:
    """Nulls of ``value`` replaced by the most frequent value of the key in ``source``; ties give the least."""
    modes = source.filter(F.col(value).isNotNull()).groupBy(*on, value).agg(F.count(F.lit(1)).alias("_n"))
    modes = latest_per_key(modes, on, [F.desc("_n"), F.asc(value)]).select(*on, F.col(value).alias("_mode"))
    return df.join(modes, on, "left").withColumn(value, F.coalesce(value, "_mode")).drop("_mode")


def pending(subjects: DataFrame, cache: DataFrame, keys: list[str], inputs: list[str], version: int = 1) -> DataFrame:
    """Subjects whose fingerprint (of the inputs and the version) the cache doesn't hold, with the fingerprint."""
    marked = subjects.withColumn("fingerprint", F.xxhash64(F.lit(version), *inputs))
    return marked.join(cache.select(*keys, "fingerprint"), [*keys, "fingerprint"], "left_anti")


def column_coverage(df: DataFrame) -> DataFrame:
    """name, filled (rows that aren't null) and percent of each column, in one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in df.columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("filled")) for c in df.columns])).alias("x")
    return counts.select("_n", pairs).select("x.name", "x.filled", F.round(F.try_divide(F.col("x.filled") * 100.0, F.col("_n")), 2).alias("percent"))


def json_key_coverage(df: DataFrame, column: str) -> DataFrame:
    """key and n: how often each top-level key occurs; texts that aren't JSON objects count for nothing."""
    return df.select(F.explode(F.json_object_keys(column)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
