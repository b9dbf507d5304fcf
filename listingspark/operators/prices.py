"""Price references from sales: cleaning, trimmed statistics, yearly index, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import spread_quantiles

#: Quantiles of a reference row.
LEVELS = {"p10": 0.1, "q1": 0.25, "median": 0.5, "q3": 0.75, "p90": 0.9}


def single_line(detail: DataFrame, group: str, counted: Column) -> DataFrame:
    """Lines that are alone in their group and the only one of it that ``counted`` holds for: the price of such a sale
    is that of one thing."""
    w = Window.partitionBy(group)
    return detail.withColumns({"_lines": F.count(F.lit(1)).over(w), "_counted": F.count_if(counted).over(w)}).filter("_lines = 1 and _counted = 1").drop("_lines", "_counted")


def group_single(detail: DataFrame, group: str, wanted: Column, excluded: Column, values: list[str]) -> DataFrame:
    """One row for each group with just one wanted line and no excluded one: the greatest wanted value of each column."""
    out = detail.groupBy(group).agg(F.count_if(wanted).alias("_wanted"), F.count_if(excluded).alias("_excluded"), *[F.max(F.when(wanted, F.col(v))).alias(v) for v in values])
    return out.filter("_wanted = 1 and _excluded = 0").drop("_wanted", "_excluded")


def in_ranges(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows with each column inside its bounds, both included."""
    for c, (lo, hi) in ranges.items():
        df = df.filter(F.col(c).between(lo, hi))
    return df


# Bounds of usable sales, residential and commercial.
RESIDENTIAL = {"surface_bati": (10.0, 1000.0), "prix_m2": (200.0, 30000.0)}
COMMERCIAL = {"surface_bati": (10.0, 10000.0), "prix_m2": (100.0, 50000.0)}
DWELLINGS = ("Maison", "Appartement")
PREMISES = "Local industriel. commercial ou assimilé"


def typed_sales(detail: DataFrame) -> DataFrame:
    """The raw all-string sales file with names and types of the sales table."""
    number = lambda c: F.expr(f"try_cast({c} as double)")
    return detail.select(
        "id_mutation",
        F.expr("try_cast(date_mutation as date)").alias("date_mutation"),
        "nature_mutation",
        "code_departement",
        "code_commune",
        "code_postal",
        F.col("nom_commune").alias("commune"),
        F.concat_ws(" ", "adresse_numero", "adresse_suffixe", "adresse_nom_voie").alias("adresse"),
        "type_local",
        number("surface_reelle_bati").alias("surface_bati"),
        number("valeur_fonciere").alias("valeur_fonciere"),
        F.expr("try_cast(nombre_pieces_principales as int)").alias("nombre_pieces"),
        number("surface_terrain").alias("surface_terrain"),
        number("longitude").alias("longitude"),
        number("latitude").alias("latitude"),
    )


def clean_sales_residential(detail: DataFrame) -> DataFrame:
    """Sales of one dwelling in one line, with a price for each square metre in bounds."""
    sales = single_line(typed_sales(detail), "id_mutation", F.col("type_local").isin(*DWELLINGS))
    sales = sales.filter("nature_mutation = 'Vente' and valeur_fonciere > 5000 and surface_bati > 0 and code_postal is not null")
    return in_ranges(sales.withColumn("prix_m2", F.try_divide("valeur_fonciere", "surface_bati")), RESIDENTIAL)


def clean_sales_commercial(detail: DataFrame) -> DataFrame:
    """Sales of one commercial unit without a dwelling, whatever their number of lines."""
    sales = typed_sales(detail).filter("nature_mutation = 'Vente'")
    values = [c for c in sales.columns if c not in ("id_mutation", "nature_mutation")]
    sales = group_single(sales, "id_mutation", F.col("type_local") == PREMISES, F.col("type_local").isin(*DWELLINGS), values)
    sales = sales.filter("valeur_fonciere > 5000 and surface_bati > 0 and code_postal is not null")
    return in_ranges(sales.withColumn("prix_m2", F.try_divide("valeur_fonciere", "surface_bati")), COMMERCIAL)


def trimmed_reference(sales: DataFrame, keys: list[str], value: str, day: str, as_of: Column, *, trim: tuple[float, float] = (0.01, 0.99), min_n: int = 5, months: int = 12, size: str | None = None, place: tuple[str, str] | None = None, spread: bool = False) -> DataFrame:
    """Statistics of ``value`` by key without its extremes: rows outside the trim quantiles of their key are left out,
    and keys of fewer than ``min_n`` rows after that. Bounds are a row for each key and are joined back. The mean is taken
    of the values to four places, exactly. size and place: columns whose median and means are added. spread: for few
    keys of very many sales, whose quantiles are taken from sorted partitions; else a key's values are counted in one task."""
    if spread:
        bounds = spread_quantiles(sales, keys, value, list(trim)).select(*keys, F.col("q").alias("_b"))
    else:
        bounds = sales.groupBy(*keys).agg(F.percentile(value, F.array(*map(F.lit, trim))).alias("_b"))
    kept = sales.join(bounds, keys).filter(F.col(value).between(F.col("_b")[0], F.col("_b")[1]))
    out = kept.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(day) >= F.add_months(as_of, -months)).alias("n_recent"),
        *([] if spread else [F.percentile(value, F.array(*map(F.lit, LEVELS.values()))).alias("_q")]),
        F.avg(F.col(value).cast("decimal(20,4)")).cast("double").alias("mean"),
        F.stddev_samp(value).alias("deviation"),
        F.min(day).alias("first_day"),
        F.max(day).alias("last_day"),
        *([F.median(size).alias("median_size")] if size and not spread else []),
        *[F.avg(x).alias(x) for x in place or ()],
    )
    if spread:
        out = out.join(spread_quantiles(kept, keys, value, list(LEVELS.values())).select(*keys, F.col("q").alias("_q")), keys)
        if size:
            out = out.join(spread_quantiles(kept, keys, size, [0.5]).select(*keys, F.col("q")[0].alias("median_size")), keys, "left")
    more = [*(["median_size"] if size else []), *(place or ())]
    return out.filter(F.col("n") >= min_n).select(*keys, "n", "n_recent", *[F.col("_q")[i].alias(c) for i, c in enumerate(LEVELS)], "mean", "deviation", "first_day", "last_day", *more)


def yearly_index(sales: DataFrame, keys: list[str], value: str, day: str, *, min_n: int = 150, bounds: tuple[float, float] = (0.8, 1.25)) -> DataFrame:
    """ratio by key and year: the last year's median over that year's, clamped; years of few sales are left out."""
    known = sales.select(*keys, F.year(day).alias("year"), value).filter(F.col(value).isNotNull())
    medians = spread_quantiles(known, [*keys, "year"], value, [0.5]).select(*keys, "year", F.col("q")[0].alias("median"), "n").filter(F.col("n") >= min_n)
    last = medians.groupBy(*keys).agg(F.max_by("median", "year").alias("last"))
    ratio = F.greatest(F.lit(bounds[0]), F.least(F.lit(bounds[1]), F.try_divide("last", "median")))
    return medians.join(last, keys).select(*keys, "year", "n", "median", ratio.alias("ratio"))


def indexed(sales: DataFrame, index: DataFrame, keys: list[str], value: str, day: str) -> DataFrame:
    """``value`` at the last year's level; 1 where the index has no year."""
    return sales.withColumn("year", F.year(day)).join(index.select(*keys, "year", "ratio"), [*keys, "year"], "left").withColumn(value, F.col(value) * F.coalesce("ratio", F.lit(1.0))).drop("ratio", "year")


def reference_metadata(sales: DataFrame, places: list[str], day: str) -> DataFrame:
    return sales.agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(c).alias(f"n_{c}") for c in places], F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def sector_view(sales: DataFrame, where: Column, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` sales of a sector: a report, by its nature of a fixed size."""
    return sales.filter(where).orderBy(*order).limit(n)


def sector_references(references: DataFrame, where: Column, kind: str = "type_local") -> DataFrame:
    """The reference rows of a sector by type, prices rounded: type, n, q1, median, q3, last_day."""
    return references.filter(where).select(kind, "n", *[F.round(x).alias(x) for x in ("q1", "median", "q3")], "last_day").orderBy(kind)


def rent_reference(rents: DataFrame, sales: DataFrame) -> DataFrame:
    """Rents of communes with the postcode that most of the commune's sales have; rents of 0 or less are left out."""
    from .tables import latest_per_key

    codes = latest_per_key(sales.filter("code_postal is not null").groupBy("code_commune", "code_postal").agg(F.count(F.lit(1)).alias("n")), ["code_commune"], [F.desc("n"), F.asc("code_postal")]).drop("n")
    return rents.filter("loyer_m2 > 0").join(codes, "code_commune", "left")


def is_stale(metadata: DataFrame, built: str, days: int, as_of: Column) -> DataFrame:
    """stale: no build, or one more than ``days`` before ``as_of``."""
    return metadata.agg(F.coalesce(F.max(built) < as_of - F.make_dt_interval(F.lit(days)), F.lit(True)).alias("stale"))
