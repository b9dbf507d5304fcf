"""Tables in hash buckets, so that a merge rewrites only the buckets that its rows are in.

A bucket is a partition folder, of the hash of the keys. A merge finds the buckets of its batch, reads those alone
(partition pruning), and replaces them by dynamic partition overwrite; the files of the others stay. The new buckets are
written whole to a folder beside them first, so that a replacement that breaks off is done again from there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import latest_per_key, update_from, upsert
from ..plans.shared import Workspace

BUCKET = "bucket_"
READY = "_ready"


def with_bucket(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """Keys of one value must have one type in all batches: the hash tells types apart."""
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def replace_buckets(df: DataFrame, path: str) -> None:
    """Write the buckets of df, as whole; others stay."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(parts, BUCKET).write.partitionBy(BUCKET).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_buckets(spark: SparkSession, path: str, only: list[int] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if only is None else df.filter(F.col(BUCKET).isin(only))


def present(spark: SparkSession, pattern: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path has a bucket."""
    return present(spark, f"{path}/{BUCKET}=*")


def swap_buckets(df: DataFrame, path: str) -> None:
    """Replace the buckets of df: written whole first, where readers do not look, then put in place."""
    df.write.mode("overwrite").parquet(f"{path}/{READY}")
    end_swap(df.sparkSession, path)


def end_swap(spark: SparkSession, path: str) -> bool:
    """Put buckets in place that a broken job had ready; whether there were any. Each merge and update begins with it."""
    ready = f"{path}/{READY}"
    if not present(spark, f"{ready}/_SUCCESS"):
        return False
    replace_buckets(spark.read.parquet(ready), path)
    at = spark._jvm.org.apache.hadoop.fs.Path(ready)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return True


def touched(ws: Workspace, batch: DataFrame, keys: list[str], buckets: int) -> tuple[DataFrame, list[int]]:
    """The batch, written with its buckets, and their numbers: at most ``buckets`` of them come to the driver."""
    own = ws.write(with_bucket(batch, keys, buckets), "batch")
    return own, sorted(r[0] for r in own.select(BUCKET).distinct().collect())


def merge_buckets(spark: SparkSession, path: str, batch: DataFrame, keys: list[str], buckets: int, policy: dict[str, str] | None = None, newest: list[Column] | None = None) -> list[int]:
    """Upsert ``batch`` into the table (see ``upsert`` for policies) and tell which of its ``buckets`` were rewritten.

    The first batch makes the table; later ones need its columns and number of buckets. newest: the order in which one row
    of each key in the batch is chosen; without it keys must be unique there. Rows with a null key match nothing and are
    added. A merge that is run again after a failure, wherever it broke off, gives the same table if keys aren't null. An
    empty batch changes nothing. One merge at a time may run on a path."""
    ws = Workspace(spark, "merge")
    end_swap(spark, path)
    own, numbers = touched(ws, batch if newest is None else latest_per_key(batch, keys, newest), keys, buckets)
    if numbers:
        if exists(spark, path):
            old = read_buckets(spark, path, numbers)
            own = with_bucket(upsert(old.drop(BUCKET), own.drop(BUCKET).select(*[c for c in old.columns if c != BUCKET]), keys, policy or {}), keys, buckets)
        swap_buckets(own, path)
    ws.remove()
    return numbers


def update_buckets(spark: SparkSession, path: str, source: DataFrame, keys: list[str], buckets: int, values: dict[str, Column], order: list[Column] | None = None) -> list[int]:
    """``update_from`` on the buckets in which a key of ``source`` may be; their numbers."""
    ws = Workspace(spark, "update")
    end_swap(spark, path)
    own, numbers = touched(ws, source, keys, buckets)
    if numbers and exists(spark, path):
        old = read_buckets(spark, path, numbers)
        swap_buckets(update_from(old, own.drop(BUCKET), keys, values, order), path)
    ws.remove()
    return numbers
