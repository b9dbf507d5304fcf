"""File streams through the batch operators: each micro-batch is merged into a versioned snapshot, or into the hash buckets that
its rows are in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.tables import latest_per_key, upsert
from ..plans.shared import Workspace
from ..sources import buckets as store


def snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest complete version under ``path``; None before the first."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath().toString() for s in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v=*/_SUCCESS")) or []]
    return spark.read.parquet(max(found).rsplit("/", 1)[0]) if found else None


def merge_stream(source: DataFrame, path: str, checkpoint: str, keys: list[str], order: str, policy: dict[str, str], prepare: Callable[[DataFrame], DataFrame] = lambda d: d, **trigger) -> StreamingQuery:
    """Upsert a stream into snapshots: version n is written by batch n alone, so a batch that runs again after a failure
    replaces its own version and nothing is applied twice. Late rows lose to newer ones of their key."""

    def apply(batch: DataFrame, number: int) -> None:
        new = latest_per_key(prepare(batch), keys, [F.desc(order)])
        old = snapshot_before(batch.sparkSession, path, number)
        if old is not None:
            known = old.select(*keys, F.col(order).alias("_known"))
            new = new.join(known, keys, "left").filter(F.col("_known").isNull() | (F.col(order) >= F.col("_known"))).drop("_known")
        (new if old is None else upsert(old, new, keys, policy)).write.mode("overwrite").parquet(f"{path}/v={number:012d}")

    return source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def merge_stream_in_buckets(
    source: DataFrame, path: str, checkpoint: str, keys: list[str], order: str, buckets: int, policy: dict[str, str] | None = None, prepare: Callable[[DataFrame], DataFrame] = lambda d: d, **trigger
) -> StreamingQuery:
    """Upsert a stream into a table in ``buckets`` hash buckets: a micro-batch reads and rewrites only those that its rows are in,
    so its cost grows with the batch and not with the table. Late rows lose to newer ones of their key, which also makes
    a batch that runs again after a failure change nothing. Rows with a null key or a null ``order`` are left out: no later row could
    replace them, or be told from them. Of rows of a key equal in ``order``, one that comes in a later batch wins."""

    def apply(batch: DataFrame, number: int) -> None:
        spark, ws = batch.sparkSession, Workspace(batch.sparkSession, "stream")
        store.end_swap(spark, path)
        new = latest_per_key(prepare(batch).dropna(subset=[*keys, order]), keys, [F.desc(order)])
        new, numbers = store.touched(ws, new, keys, buckets)
        if numbers and store.exists(spark, path):
            known = store.read_buckets(spark, path, numbers).select(*keys, F.col(order).alias("_known"))
            new = new.join(known, keys, "left").filter(F.col("_known").isNull() | (F.col(order) >= F.col("_known"))).drop("_known")
        store.merge_buckets(spark, path, new.drop(store.BUCKET), keys, buckets, policy)
        ws.remove()

    return source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def snapshot_before(spark: SparkSession, path: str, number: int) -> DataFrame | None:
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath().toString() for s in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v=*/_SUCCESS")) or []]
    earlier = [f for f in found if int(f.split("/v=")[1].split("/")[0]) < number]
    return spark.read.parquet(max(earlier).rsplit("/", 1)[0]) if earlier else None


def read_stream(spark: SparkSession, path: str, schema: T.StructType, kind: str = "json") -> DataFrame:
    return spark.readStream.schema(schema).format(kind).load(path)
