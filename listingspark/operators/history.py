"""Lifecycle of listings: trusted inventories, activity, price history; and incremental reading of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import spread_rank


def inventory_verdicts(runs: DataFrame, *, share: float = 0.7, days: int = 30) -> DataFrame:
    """runs(source, run_at, url_count, complete) with ``most`` and ``accepted``: a complete, non-empty run of at least
    ``share`` of the most that an accepted run of the ``days`` before had. Each verdict rests on those before it, so a
    source's runs, of which there are a few a day, are gone through in order."""
    run = F.struct("run_at", F.col("url_count").cast("long").alias("url_count"), F.coalesce("complete", F.lit(False)).alias("complete"))
    span = F.make_dt_interval(F.lit(days))

    def judge(done: Column, x: Column) -> Column:
        recent = F.filter(done, lambda d: d["accepted"] & (d["run_at"] > x["run_at"] - span))
        most = F.array_max(F.transform(recent, lambda d: d["url_count"]))
        ok = x["complete"] & (x["url_count"] > 0) & (F.coalesce(most, F.lit(0)) * F.lit(share) <= x["url_count"])
        return F.concat(done, F.array(F.struct(x["run_at"].alias("run_at"), x["url_count"].alias("url_count"), x["complete"].alias("complete"), most.alias("most"), F.coalesce(ok, F.lit(False)).alias("accepted"))))

    kind = f"array<struct<run_at:{runs.schema['run_at'].dataType.simpleString()},url_count:bigint,complete:boolean,most:bigint,accepted:boolean>>"
    listed = runs.groupBy("source").agg(F.array_sort(F.collect_list(run)).alias("runs"))
    return listed.select("source", F.inline(F.aggregate("runs", F.array().cast(kind), judge)))


def replace_inventory(inventory: DataFrame, snapshot: DataFrame, accepted: DataFrame) -> DataFrame:
    """The inventory with the accepted sources' rows replaced by the snapshot's distinct urls."""
    sources = accepted.filter("accepted").select("source").distinct()
    fresh = snapshot.join(sources, "source", "left_semi").select("source", "url", "listed_at").dropDuplicates(["source", "url"])
    return inventory.join(sources, "source", "left_anti").select("source", "url", "listed_at").unionByName(fresh)


def activity(listings: DataFrame, inventory: DataFrame, as_of: Column, *, ttl_days: dict[str, int] | None = None, default_days: int = 21, bronze: DataFrame | None = None) -> DataFrame:
    """listings with ``active``: of a source with an inventory, whether the url is listed, or the url under which ``bronze``(source, id,
    url) has the advert (the one that was visited; some sources publish another); of others, whether it was
    seen within the source's time to live; past auctions (of more than a day ago) are not."""
    known = inventory.select("source").distinct().withColumn("_known", F.lit(True))
    urls = inventory.select("source", "url").distinct().withColumn("_listed", F.lit(True))
    ttl = F.lit(default_days)
    for source, days in (ttl_days or {}).items():
        ttl = F.when(F.col("source") == source, days).otherwise(ttl)
    seen = F.col("last_seen_at") >= as_of - F.make_dt_interval(ttl)
    past = F.coalesce(F.col("date_vente") < as_of - F.expr("INTERVAL 1 DAY"), F.lit(False)) if "date_vente" in listings.columns else F.lit(False)
    df = listings.drop("active").join(known, "source", "left").join(urls, ["source", "url"], "left").withColumn("_visited", F.lit(None).cast("boolean"))
    if bronze is not None:
        visited = bronze.join(urls, ["source", "url"]).select("source", F.col("id").cast("string").alias("external_id"), F.lit(True).alias("_visited")).distinct()
        df = df.drop("_visited").join(visited, ["source", "external_id"], "left")
    listed = F.col("_listed").isNotNull() | F.col("_visited").isNotNull()
    now = F.when(F.col("_known").isNotNull(), listed).otherwise(F.coalesce(seen, F.lit(False)))
    return df.withColumn("active", now & ~past).drop("_known", "_listed", "_visited")


def price_changes(listings: DataFrame, history: DataFrame, keys: list[str], values: list[str], at: str, as_of: Column) -> DataFrame:
    """Rows to append to the history: listings of which a value is distinct from the last one kept, or that have none."""
    last = history.groupBy(*keys).agg(F.max_by(F.struct(*values), at).alias("_last"))
    changed = F.lit(False)
    for v in values:
        changed = changed | ~F.col(v).eqNullSafe(F.col("_last")[v])
    return listings.join(last, keys, "left").filter(F.col("_last").isNull() | changed).select(*keys, as_of.alias(at), *values)


def change_log(observed: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Observations that differ from the one before them, as repeated appends would keep them."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return observed.withColumns({"_last": F.lag(value).over(w), "_n": F.row_number().over(w)}).filter((F.col("_n") == 1) | ~F.col(value).eqNullSafe(F.col("_last"))).drop("_last", "_n")


def price_signals(history: DataFrame, keys: list[str], value: str, at: str) -> DataFrame:
    """First and greatest value, number of drops and the last drop's time, of the values above 0."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(at))
    df = history.filter(F.col(value) > 0).withColumn("_drop", F.coalesce(F.col(value) < before, F.lit(False)))
    return df.groupBy(*keys).agg(F.min_by(value, at).alias("first_value"), F.max(value).alias("most"), F.count_if("_drop").alias("n_drops"), F.max(F.when(F.col("_drop"), F.col(at))).alias("last_drop"))


def crawl_frontier(listed: DataFrame, known: DataFrame, checks: DataFrame, as_of: Column, *, revisit_days: int, version: int, terminal: Column | None = None, order: list[Column] | None = None, cap: int | None = None) -> DataFrame:
    """Listed urls to read: not those read within ``revisit_days`` by this parser version, nor those in a terminal state,
    nor those checked in vain as lately. cap: at most so many a run, in ``order``."""
    since = as_of - F.make_dt_interval(F.lit(revisit_days))
    fresh = (F.col("collected_at") >= since) & (F.col("version") == version)
    done = known.filter(fresh if terminal is None else fresh | F.coalesce(terminal, F.lit(False))).select("url")
    out = listed.join(done, "url", "left_anti").join(checks.filter(F.col("checked_at") >= since).select("url"), "url", "left_anti")
    return out if cap is None else out.orderBy(*(order or [F.col("url")])).limit(cap)


def increment(df: DataFrame, at: str, watermark: Column, *, overlap_minutes: int = 30, full: Column | None = None) -> DataFrame:
    """Rows from the watermark less an overlap on; all rows where ``full`` holds."""
    return df.filter((F.col(at) >= watermark - F.make_dt_interval(mins=F.lit(overlap_minutes))) | F.coalesce(full if full is not None else F.lit(False), F.lit(False)))


def advance(state: DataFrame, seen: DataFrame, key: str, at: str, complete: Column) -> DataFrame:
    """New watermarks: the greatest time seen of each key, where its pass was complete; others stay."""
    new = seen.filter(complete).groupBy(key).agg(F.max(at).alias("_new"))
    return state.join(new, key, "full_outer").select(key, F.greatest("watermark", "_new").alias("watermark"))


def recent_entries(df: DataFrame, lastmod: str, as_of: Column, days: int = 365) -> DataFrame:
    """Entries of which the last change is not known (null or empty) or at most ``days`` old, the newest first."""
    said = F.nullif(F.col(lastmod).cast("string"), F.lit(""))
    at = said.try_cast("timestamp")
    return df.filter(said.isNull() | (at >= as_of - F.make_dt_interval(F.lit(days)))).orderBy(at.desc_nulls_last())


def interleave(df: DataFrame, group: str, order: list[Column], cap: int | None = None) -> DataFrame:
    """First rows of all groups, then second ones, and so on: ``turn`` is the place in the group. cap: of them the first."""
    out = spread_rank(df, [group], order, "turn")
    return out if cap is None else out.orderBy("turn", group).limit(cap)


def latest_runs(log: DataFrame, n: int) -> DataFrame:
    """The ``n`` runs that began last: a report."""
    return run_states(log).orderBy(F.desc("started"), "run_id").limit(n)


def run_states(log: DataFrame) -> DataFrame:
    """The latest state of each run in an append-only log(run_id, at, status, rows, error); errors cut at 2000 characters."""
    return log.groupBy("run_id").agg(F.max_by(F.struct("status", "rows", F.substring("error", 1, 2000).alias("error")), "at").alias("s"), F.min("at").alias("started"), F.max("at").alias("at")).select("run_id", "started", "at", "s.*")
