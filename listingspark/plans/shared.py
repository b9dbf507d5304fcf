"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a fresh local folder only in local mode, where that may be unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application: their Python may not have it on its path."""
    context, package = spark.sparkContext, Path(__file__).resolve().parents[1]
    if any(str(f).endswith(f"/{package.name}.zip") for f in context.listFiles):
        return
    to = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="spark-")), f"{package.name}.zip")
    with zipfile.ZipFile(to, "w") as out:
        for f in sorted(package.rglob("*.py")):
            out.write(f, f.relative_to(package.parent))
    context.addPyFile(to)


_open: list[list[Workspace]] = []


@contextmanager
def made_here() -> Iterator[list[Workspace]]:
    """The workspaces that calls inside open. Who has written what they wanted from an operator's lazy result can then
    ``remove`` them; until then the result reads their tables."""
    made: list[Workspace] = []
    _open.append(made)
    try:
        yield made
    finally:
        _open[:] = [x for x in _open if x is not made]


class Workspace:
    """A folder for one operator call. ``write`` cuts lineage with a Parquet table: it outlives lost executors,
    and its size is known to the optimizer, which then broadcasts it only below its own threshold."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.n = spark, 0
        ship_package(spark)
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        for made in _open:
            made.append(self)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        at = f"{self.path}/{self.n:03d}-{name}"
        df.write.parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._workspace_path = at
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables of ``write`` that nothing reads any more."""
        for table in tables:
            self._delete(table._workspace_path)

    def remove(self) -> None:
        """Remove all tables of this call."""
        self._delete(self.path)

    def _delete(self, at: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def in_order(ws: Workspace, df: DataFrame, keys: list[str | Column], name: str, number: str = "number") -> DataFrame:
    """df written with ``number``, which grows in the order of the keys: the number of a row in sorted range partitions."""
    n = int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
    return ws.write(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn(number, F.monotonically_increasing_id()), name)


def running_total(ws: Workspace, df: DataFrame, order: list[str], amount: str | None, name: str) -> DataFrame:
    """``df`` with ``name`` = the sum of ``amount`` (rows if None) over all rows before this one in ``order``.

    A global prefix sum without a global window: range partitions, their totals, then a window inside each.
    Rows equal in ``order`` have no defined order among themselves, so pass a unique order."""
    spark = ws.spark
    cols = [F.col(c) for c in order]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    value = F.lit(1).cast("long") if amount is None else F.col(amount).cast("long")
    dealt = ws.write(
        df.repartitionByRange(n, *cols).withColumn("_part", F.spark_partition_id()).withColumn("_amount", value), "range"
    )
    parts = dealt.groupBy("_part").agg(F.sum("_amount").alias("_total"))  # a row for each partition
    before = parts.select(
        "_part", F.coalesce(F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("_part").orderBy(*cols).rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.withColumn("_inside", F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
        .join(F.broadcast(before), "_part")
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop("_part", "_amount", "_inside", "_before")
    )
