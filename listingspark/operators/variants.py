"""Bronze rows as VARIANT: each value keeps the type it came with, whatever other batches hold under its name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What schema_of_variant says of a value, and the kind that it is of; others are their own kind.
KINDS = {"BIGINT": "NUMBER", "DECIMAL": "NUMBER", "DOUBLE": "NUMBER", "FLOAT": "NUMBER", "VOID": "NULL"}


def packed(df: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    """The keys, and all other columns as one VARIANT object. Without other columns it is an empty object."""
    rest = [c for c in df.columns if c not in keys]
    value = F.to_variant_object(F.struct(*rest)) if rest else F.parse_json(F.lit("{}"))
    return df.select(*keys, value.alias(raw))


def parsed(df: DataFrame, text: str, raw: str = "raw", broken: str = "broken") -> DataFrame:
    """df with JSON ``text`` as VARIANT, without a pass for its schema. Text that isn't JSON gives null, and stays in
    ``broken``; null text gives null in both."""
    value = F.try_parse_json(text)
    others = [c for c in df.columns if c not in (raw, broken, text)]
    return df.select(*others, value.alias(raw), F.when(value.isNull(), F.col(text)).alias(broken))


def append_batch(df: DataFrame, path: str, batch: str, collected_at: Column) -> None:
    """Write df as the batch of that name, stamped with _collected_at. No other batch is read or written, whatever its types; a
    batch that is written again, as after a failed job, replaces itself."""
    df.withColumn("_collected_at", collected_at).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All batches, with their name in ``batch``; columns that a batch lacks are null."""
    return spark.read.option("mergeSchema", True).option("basePath", path).parquet(f"{path}/batch=*").withColumn("batch", F.col("batch").cast("string"))


def field(raw: str | Column, name: str, of: str | T.DataType) -> Column:
    """The value at a key as a type; null where the key is missing, the row is no object, or the value is not of that type
    and can't be cast to it. Arrays and objects as strings are JSON. A name with both kinds of quotes can't be asked for."""
    if "'" in name and '"' in name:
        raise ValueError(f"a path can't hold the key {name}")
    mark = '"' if "'" in name else "'"
    raw = F.col(raw) if isinstance(raw, str) else raw
    path = f"$[{mark}{name}{mark}]"
    if of in ("string", T.StringType()):
        value = F.try_variant_get(raw, path, "variant")
        return F.coalesce(F.try_variant_get(raw, path, "string"), F.when(~F.is_variant_null(value), F.to_json(value)))
    return F.try_variant_get(raw, path, of if isinstance(of, str) else of.simpleString())


def kind_of(value: Column) -> Column:
    """NUMBER, STRING, BOOLEAN, ARRAY, OBJECT, NULL (a null that is written) or what else a value is."""
    said = F.regexp_extract(F.schema_of_variant(value), r"^(\w+)", 1)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[said], said)


def exploded(df: DataFrame, raw: str = "raw") -> DataFrame:
    """A row for each key of each object of ``raw``: key, value. Rows that are null or no object have none."""
    each = df.select(F.col(raw).alias("_raw")).lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_raw").outer()))
    return each.filter("key is not null").select("key", "value")


def variant_coverage(df: DataFrame, raw: str = "raw") -> DataFrame:
    """key, kind, n (rows with a value of that kind there), percent (of all rows of df), type (the schema that all these values
    have in common). A key with several kinds has several rows: that is where types are in conflict."""
    counts = exploded(df, raw).groupBy("key", kind_of(F.col("value")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.schema_of_variant_agg("value").alias("type"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.select("key", "kind", "n", F.round(F.col("n") * 100.0 / total, 2).alias("percent"), "type")


def as_columns(df: DataFrame, schema: T.StructType, raw: str = "raw") -> DataFrame:
    """df with the schema's fields read from ``raw``, which goes; a column of df by a field's name gives way to it."""
    names = {f.name for f in schema}
    return df.select(*[c for c in df.columns if c != raw and c not in names], *[field(raw, f.name, f.dataType).alias(f.name) for f in schema])
