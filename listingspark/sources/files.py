"""Files of the pipeline: sales, rents, inventories, published tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SALES = "id_mutation date_mutation nature_mutation valeur_fonciere code_departement code_commune code_postal nom_commune adresse_numero adresse_suffixe adresse_nom_voie adresse_code_voie id_parcelle type_local surface_reelle_bati nombre_pieces_principales surface_terrain longitude latitude".split()


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths that are there; patterns count as there if they match any."""
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    return [p for p in paths if len(path(p).getFileSystem(conf).globStatus(path(p)) or [])]


def read_sales(spark: SparkSession, paths: list[str], partitions: int | None = None) -> DataFrame:
    """Sales files with a header, all strings. Each file's columns are found by the names in its own header, missing ones are
    null; files that aren't there are left out. gz can't be split, so the rows are dealt out again with ``partitions``."""
    empty = spark.createDataFrame([], T.StructType([T.StructField(n, T.StringType()) for n in SALES]))
    by_header: dict[tuple[str, ...], list[str]] = {}
    for path in existing(spark, paths):
        by_header.setdefault(tuple(spark.read.option("header", True).csv(path).columns), []).append(path)
    # files of one header are one scan
    parts = []
    for header, files in by_header.items():
        schema = T.StructType([T.StructField(n, T.StringType()) for n in header])
        df = spark.read.option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", True).schema(schema).csv(files)
        parts.append(df.select(*[F.col(c) if c in header else F.lit(None).cast("string").alias(c) for c in SALES]))
    df = reduce(lambda a, b: a.unionByName(b), parts, empty)
    return df.repartition(partitions) if partitions else df


#: What the bytes 80 to 9F stand for in CP1252, which Spark's reader has not; those that it leaves free stay as they are.
CP1252 = {chr(b): bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0)}


def western(text: Column) -> Column:
    """Text that was read as ISO-8859-1 as CP1252 means it."""
    return F.translate(text, "".join(CP1252), "".join(CP1252.values()))


def read_rents(spark: SparkSession, files: dict[tuple[str, str], str]) -> DataFrame:
    """Rent indicators by (type, typology): semicolons, letters of one byte as CP1252 has them, decimal commas."""
    number = lambda c: F.expr(f"try_cast(replace(`{c}`, ',', '.') as double)")

    def one(kind: str, typology: str, path: str) -> DataFrame:
        raw = spark.read.option("sep", ";").option("header", True).option("encoding", "ISO-8859-1").csv(path)
        return raw.select(
            F.col("INSEE_C").alias("code_commune"), western(F.col("LIBGEO")).alias("commune"), F.lit(kind).alias("type_bien"), F.lit(typology).alias("typologie"),
            number("loypredm2").alias("loyer_m2"), number("lwr.IPm2").alias("loyer_m2_bas"), number("upr.IPm2").alias("loyer_m2_haut"), F.col("TYPPRED").alias("niveau"), F.col("nbobs_com").try_cast("int").alias("n"), number("R2_adj").alias("r2"),
        )

    return reduce(lambda a, b: a.unionByName(b), [one(*k, v) for k, v in files.items()])


def read_inventory(spark: SparkSession, path: str, source: str, at) -> DataFrame:
    """One url a line, distinct."""
    lines = spark.read.text(path).select(F.trim("value").alias("url")).filter("url <> ''").distinct()
    return lines.select(F.lit(source).alias("source"), "url", at.alias("listed_at"))


def publish_table(df: DataFrame, path: str, keep: int = 2) -> str:
    """A new version of the table at ``path``: readers (``published``) see the last one whose write has ended, so a job that
    fails changes nothing. The ``keep`` newest versions stay, for readers that began before; returns the new one's path."""
    spark = df.sparkSession
    jpath, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    fs = jpath(path).getFileSystem(conf)
    names = sorted(x.getPath().getName() for x in (fs.globStatus(jpath(f"{path}/v=*")) or []))
    number = int(names[-1].removeprefix("v=")) + 1 if names else 0
    df.write.parquet(f"{path}/v={number:012d}")
    done = _versions(spark, path)
    for old in done[: max(0, len(done) - keep)]:
        fs.delete(jpath(old), True)
    return f"{path}/v={number:012d}"


def _versions(spark: SparkSession, path: str) -> list[str]:
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    found = jpath(path).getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(jpath(f"{path}/v=*/_SUCCESS")) or []
    return sorted(x.getPath().getParent().toString() for x in found)


def published(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole version of a published table."""
    return spark.read.parquet(_versions(spark, path)[-1])


def bronze_schema(extra: dict[str, T.DataType] | None = None) -> T.StructType:
    names = "id name price surface land_surface rooms bedrooms zipcode city lat lng type_hint url body seller_name dpe ges published_at details_json images_json reference_annonce raw_payload _collected_at mode_vente date_vente prix_adjuge".split()
    fields = [T.StructField(n, T.StringType()) for n in names] + [T.StructField("image_count", T.LongType())]
    return T.StructType(fields + [T.StructField(n, t) for n, t in (extra or {}).items()])
