"""Names as keys by collation: case, marks, ligatures and combining marks do not part them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shared import Workspace
from .tables import latest_per_key

COLLATION = "UNICODE_CI_AI"


def place_name(name: Column) -> Column:
    """A place's name that equals its other spellings: any blanks and signs between words, 'st' and 'ste' as 'saint' and
    'sainte', any case and marks. The value is one of the spellings; null stays null, a name without letters or digits is null."""
    words = F.trim(F.regexp_replace(name, r"[^\p{L}\p{M}\p{N}]+", "-"), F.lit("-"))
    saints = F.regexp_replace(words, r"(?i)(^|-)st(e?)(?=-)", "$1saint$2")
    return F.collate(F.nullif(saints, F.lit("")), COLLATION)


def join_by_place(left: DataFrame, right: DataFrame, names: tuple[str, str], plain: list[str] | None = None, how: str = "left") -> DataFrame:
    """An equi-join on the places' names and the columns ``plain``. Columns of right that left has too come as ``right_...``.
    Null names meet nothing. An aggregate by place should be written before it comes as right: a hot place's rows can then be
    split."""
    plain = plain or []
    key = "_place"
    moved = {c: f"right_{c}" if c in left.columns else c for c in right.columns if c not in plain}
    b = right.select(*plain, *[F.col(c).alias(n) for c, n in moved.items()], place_name(F.col(names[1])).alias(key))
    return left.withColumn(key, place_name(F.col(names[0]))).join(b, [key, *plain], how).drop(key)


def count_by_place(df: DataFrame, name: str, aggregates: list[Column], plain: list[str] | None = None) -> DataFrame:
    """A row for each place (and plain columns): ``name`` is the least of its spellings, by code point, then the aggregates."""
    plain = plain or []
    out = df.withColumn("_place", place_name(F.col(name))).groupBy("_place", *plain).agg(F.min(name).alias("_name"), *aggregates)
    return out.withColumnRenamed("_name", name).select(name, *[c for c in out.columns if c not in ("_place", "_name")]) if name not in plain else out.drop("_place", "_name")


def impute_by_place(df: DataFrame, source: DataFrame, name: str, value: str, plain: list[str] | None = None) -> DataFrame:
    """Nulls of ``value`` replaced by the most frequent value of the place in ``source``; ties give the least. Places without one,
    and null names, stay as they are. The places' values are written, so that the rows of a hot place can be split."""
    plain, ws = plain or [], Workspace(df.sparkSession, "places")
    known = source.filter(F.col(value).isNotNull()).groupBy(place_name(F.col(name)).alias("_place"), *plain, value).agg(F.count(F.lit(1)).alias("_place_rows"))
    modes = latest_per_key(known, ["_place", *plain], [F.desc("_place_rows"), F.asc(value)]).select("_place", *plain, F.col(value).alias("_mode"))
    modes = ws.write(modes.withColumn("_place", F.collate("_place", "UTF8_BINARY")), "modes").withColumn("_place", F.collate("_place", COLLATION))
    out = df.withColumn("_place", place_name(F.col(name))).join(modes, ["_place", *plain], "left")
    return out.withColumn(value, F.coalesce(value, "_mode")).select(*df.columns)
