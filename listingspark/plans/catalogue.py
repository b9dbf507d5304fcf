"""Queries on the driver's tables, each beside its SQL equal.

The tables hold no adverts, so the operators run on the tables' own columns: line items are sales (price, quantity as
size, part type and brand as kind, supplier's nation as place, ship date), events are price histories."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text_fr
from ..operators import comparables, duplicates, history, prices, scoring, search, tables
from ..sources import pages as page_source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
c, lit = F.col, F.lit


def query(sql: str | None = None):
    """Register the function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def half_up(x: str, digits: int) -> str:
    """SQL that rounds as Spark does: halves of the shortest decimal form go up."""
    return f"round(({x})::DOUBLE::VARCHAR::DECIMAL(38, 15), {digits})::DOUBLE"


LINES = """line AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS rn FROM lineitem) WHERE rn = 1)"""
OBS = f"""{LINES}, obs AS (SELECT l_orderkey, l_linenumber, l_orderkey * 10 + l_linenumber AS id, p_brand, p_type, p_size, l_quantity AS size, l_extendedprice AS price,
  l_extendedprice / l_quantity AS rate, l_shipdate AS day, s_nationkey AS nation, l_returnflag AS flag, l_discount AS discount FROM line JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""


def lines(spark: SparkSession, sf: str) -> DataFrame:
    order = [c(x) for x in ("l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")]
    return tables.latest_per_key(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], order)


def observations(spark: SparkSession, sf: str) -> DataFrame:
    df = lines(spark, sf).join(table(spark, sf, "part"), c("l_partkey") == c("p_partkey")).join(table(spark, sf, "supplier"), c("l_suppkey") == c("s_suppkey"))
    return df.select(
        "l_orderkey", "l_linenumber", (c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), "p_brand", "p_type", "p_size", c("l_quantity").alias("size"), c("l_extendedprice").alias("price"),
        F.try_divide("l_extendedprice", "l_quantity").alias("rate"), c("l_shipdate").alias("day"), c("s_nationkey").alias("nation"), c("l_returnflag").alias("flag"), c("l_discount").alias("discount"),
    )


# --- nearest comparables -----------------------------------------------------------------------------------------

AS_OF = "2002-01-01"


def subjects(obs: DataFrame) -> DataFrame:
    """The queries of a search: every order whose number is divisible by 50, against all rows."""
    return obs.filter("l_orderkey % 50 = 0").select("id", "p_brand", "p_type", "p_size", "size", "price", "nation", "discount")


def pool(obs: DataFrame) -> DataFrame:
    return obs.select(*[c(x).alias(f"v_{x}") for x in ("id", "p_brand", "p_type", "p_size", "size", "price", "rate", "day", "nation")])


def search_near(asked: DataFrame, offered: DataFrame) -> DataFrame:
    """The fifteen nearest of the same brand and type: of each size and nation none but the latest can be among them."""
    age = F.datediff(lit(AS_OF).cast("date"), "v_day") / 365.25 * 0.08
    distance = F.abs(F.ln(c("v_size") / c("size"))) * 4.0 + F.when(c("nation") == c("v_nation"), 0.0).otherwise(0.35) + age
    kind, ours = ["v_p_brand", "v_p_type", "v_size"], [("p_brand", "v_p_brand"), ("p_type", "v_p_type")]
    return comparables.nearest_of_alike(
        asked.select("id", "p_brand", "p_type", "size", "nation"), offered.select("v_id", *kind, "v_nation", "v_price", "v_day"), subject_key="id", pool_key="v_id", asked=["p_brand", "p_type", "size", "nation"],
        ways=[comparables.Way([*ours, ("nation", "v_nation")], [*kind, "v_nation"]), comparables.Way(ours, kind)], order=[F.to_date("v_day").desc_nulls_last(), c("v_id")],
        distance=distance, k=15, band=("size", "v_size", 0.8, 1.2, 0.05), narrow=comparables.Narrow(1.05, math.log(1.05) * 4.0 + F.least(lit(0.0), F.min(age))),
    )


def near(spark: SparkSession, sf: str) -> DataFrame:
    obs = observations(spark, sf)
    return search_near(subjects(obs), pool(obs))


NEAR = f"""WITH {OBS}, near AS (
  SELECT s.id, v.id AS v_id, v.price AS v_price, v.size AS v_size, v.day AS v_day, s.price, s.size, s.discount,
    abs(ln(v.size / s.size)) * 4.0::DOUBLE + CASE WHEN s.nation = v.nation THEN 0.0::DOUBLE ELSE 0.35::DOUBLE END + date_diff('day', v.day::DATE, DATE '{AS_OF}') / 365.25::DOUBLE * 0.08::DOUBLE AS distance
  FROM obs s JOIN obs v ON s.p_brand = v.p_brand AND s.p_type = v.p_type AND s.id <> v.id AND v.size BETWEEN s.size * 0.8::DOUBLE AND s.size * 1.2::DOUBLE
  WHERE s.l_orderkey % 50 = 0
), ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, v_id) AS rank FROM near) WHERE rank <= 15)"""
TRIMMED = f"""{NEAR}, bounds AS (SELECT id, quantile_cont(v_price, 0.25) AS a, quantile_cont(v_price, 0.75) AS b FROM ranked GROUP BY id
), trimmed AS (SELECT ranked.* FROM ranked JOIN bounds USING (id) WHERE v_price BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)
), stats AS (
  SELECT id, count(*) AS n, quantile_cont(v_price, 0.25) AS q1, quantile_cont(v_price, 0.5) AS median, quantile_cont(v_price, 0.75) AS q3, min(v_day) AS first_day, max(v_day) AS last_day,
    median(v_size) AS median_size, avg(distance) AS mean_distance FROM trimmed GROUP BY id HAVING count(*) >= 5)"""


@query(f"{NEAR} SELECT id, v_id, rank, round(distance, 6) AS distance FROM ranked")
def comparables_topk(spark, sf):
    return near(spark, sf).select("id", "v_id", "rank", F.round("distance", 6).alias("distance"))


def stats(spark, sf):
    return comparables.comparable_stats(comparables.iqr_trim(near(spark, sf), ["id"], "v_price"), ["id"], "v_price", "v_size", "v_day")


@query(f"{TRIMMED} SELECT id, n, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, first_day, last_day, median_size, round(mean_distance, 6) AS mean_distance FROM stats")
def comparables_iqr_stats(spark, sf):
    return stats(spark, sf).withColumns({x: F.round(x, 4) for x in ("q1", "median", "q3")} | {"mean_distance": F.round("mean_distance", 6)})


@query(f"""WITH {OBS}, near AS (
  SELECT s.id, v.id AS v_id, abs(ln(v.size / s.size)) * 4.0::DOUBLE + abs(v.p_size - s.p_size) * 0.01::DOUBLE AS distance
  FROM obs s JOIN obs v ON s.p_brand = v.p_brand AND s.id <> v.id AND v.size BETWEEN s.size * 0.8::DOUBLE AND s.size * 1.2::DOUBLE AND (s.nation = v.nation OR abs(v.p_size - s.p_size) <= 2)
  WHERE s.l_orderkey % 50 = 0)
SELECT id, v_id, rank, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, v_id) AS rank FROM near) WHERE rank <= 12""")
def comparables_place_or_range(spark, sf):
    """Same place, or a part size within 2: the OR is two equi-joins, the range on a grid of part sizes. Of sizes, part sizes and
    places none but the least numbers can be found; mostly the nearest part sizes of all places are enough."""
    obs = observations(spark, sf)
    offered = pool(obs).select("v_id", "v_p_brand", "v_size", "v_p_size", "v_nation", F.floor(c("v_p_size") / 3).alias("v_cell"))
    distance = F.abs(F.ln(c("v_size") / c("size"))) * 4.0 + F.abs(c("v_p_size") - c("p_size")) * 0.01
    kind, brand = ["v_p_brand", "v_size", "v_p_size"], ("p_brand", "v_p_brand")
    close = comparables.Way([brand, ("cell", "v_cell")], kind, F.abs(c("v_p_size") - c("p_size")) <= 2, ("cell", F.sequence(F.floor((c("p_size") - 2) / 3), F.floor((c("p_size") + 2) / 3))))
    asked = ["p_brand", "size", "p_size"]
    found = comparables.nearest_of_alike(
        subjects(obs).select("id", *asked, "nation"), offered, subject_key="id", pool_key="v_id", asked=[*asked, "nation"], ways=[comparables.Way([brand, ("nation", "v_nation")], [*kind, "v_nation"]), close], order=[c("v_id")],
        distance=distance, k=12, band=("size", "v_size", 0.8, 1.2, 0.05), narrow=comparables.Narrow(1.01, F.max(lit(0.02)), close, asked),
    )
    return found.select("id", "v_id", "rank", F.round("distance", 6).alias("distance"))


@query("""WITH s AS (SELECT s_suppkey, s_nationkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
), cu AS (SELECT c_custkey, c_nationkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey
), m AS (SELECT c_custkey, s_suppkey, CASE WHEN c_nationkey = s_nationkey THEN 0 ELSE 1 END AS way FROM cu JOIN s ON c_nationkey = s_nationkey OR cu.n_regionkey = s.n_regionkey)
SELECT c_custkey, s_suppkey, way FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY way, s_suppkey) AS k FROM m) WHERE k = 1""")
def best_match_top1(spark, sf):
    """A supplier for each customer: of the same nation, or else of the same region. Suppliers are cut to the first of
    each nation beforehand, as no other can be the best."""
    nations = table(spark, sf, "nation")
    first = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("s_suppkey"))
    s = first.join(nations, c("s_nationkey") == c("n_nationkey")).select("s_suppkey", "s_nationkey", c("n_regionkey").alias("s_region"))
    cu = table(spark, sf, "customer").join(nations, c("c_nationkey") == c("n_nationkey")).select("c_custkey", "c_nationkey", c("n_regionkey").alias("c_region"))
    return comparables.best_match(cu, s, key=["c_custkey"], ways=[[("c_nationkey", "s_nationkey")], [("c_region", "s_region")]], tie=["s_suppkey"]).select("c_custkey", "s_suppkey", "way")


@query(f"""WITH {OBS}, near AS (
  SELECT s.id, v.rate, row_number() OVER (PARTITION BY s.id ORDER BY abs(ln(v.size / s.size)), v.id) AS k
  FROM obs s JOIN obs v ON s.p_brand = v.p_brand AND s.p_type = v.p_type AND s.nation = v.nation AND s.id <> v.id AND v.size BETWEEN s.size * 0.4::DOUBLE AND s.size * 2.5::DOUBLE
  WHERE s.l_orderkey % 50 = 0)
SELECT id, count(*) AS n, {half_up("quantile_cont(rate, 0.25)", 2)} AS q1, {half_up("quantile_cont(rate, 0.5)", 2)} AS median, {half_up("quantile_cont(rate, 0.75)", 2)} AS q3 FROM near WHERE k <= 20 GROUP BY id HAVING count(*) >= 3""")
def neighbour_rate_top20(spark, sf):
    obs = observations(spark, sf)
    kind, asked = ["v_p_brand", "v_p_type", "v_size", "v_nation"], ["p_brand", "p_type", "size", "nation"]
    found = comparables.nearest_of_alike(
        subjects(obs).select("id", *asked), pool(obs).select("v_id", *kind, "v_rate"), subject_key="id", pool_key="v_id", asked=asked, ways=[comparables.Way([("p_brand", "v_p_brand"), ("p_type", "v_p_type"), ("nation", "v_nation")], kind)],
        order=[c("v_id")], distance=F.abs(F.ln(c("v_size") / c("size"))), k=20, band=("size", "v_size", 0.4, 2.5, 0.1), narrow=comparables.Narrow(1.01, F.max(lit(math.log(1.01)))),
    )
    return comparables.neighbour_rate(found, ["id"], "v_rate").withColumns({x: F.round(x, 2) for x in ("q1", "median", "q3")})


# --- price references --------------------------------------------------------------------------------------------


@query(f"""WITH {LINES}, w AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n, count(*) FILTER (WHERE l_returnflag = 'N') OVER (PARTITION BY l_orderkey) AS m FROM line)
SELECT l_orderkey, l_partkey, l_extendedprice FROM w WHERE n = 1 AND m = 1 AND l_quantity BETWEEN 2 AND 45""")
def clean_single_line(spark, sf):
    df = prices.single_line(lines(spark, sf), "l_orderkey", c("l_returnflag") == "N")
    return prices.in_ranges(df, {"l_quantity": (2.0, 45.0)}).select("l_orderkey", "l_partkey", "l_extendedprice")


@query(f"""WITH {LINES}
SELECT l_orderkey, max(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS l_extendedprice, max(l_quantity) FILTER (WHERE l_returnflag = 'R') AS l_quantity
FROM line GROUP BY l_orderkey HAVING count(*) FILTER (WHERE l_returnflag = 'R') = 1 AND count(*) FILTER (WHERE l_returnflag = 'A') = 0""")
def clean_group_single(spark, sf):
    return prices.group_single(lines(spark, sf), "l_orderkey", c("l_returnflag") == "R", c("l_returnflag") == "A", ["l_extendedprice", "l_quantity"])


def reference_sql(keys: str) -> str:
    return f"""WITH {OBS.replace("obs AS (SELECT", "obs AS (SELECT s_nationkey / 3 + 40 AS lat, s_nationkey / 7 AS lng,")}, b AS (SELECT {keys}, quantile_cont(price, 0.01) AS lo, quantile_cont(price, 0.99) AS hi FROM obs GROUP BY {keys}
), k AS (SELECT obs.* FROM obs JOIN b USING ({keys}) WHERE price BETWEEN lo AND hi)
SELECT {keys}, count(*) AS n, count(*) FILTER (WHERE day >= TIMESTAMP '2000-06-01') AS n_recent, {", ".join(f"{half_up(f'quantile_cont(price, {q})', 6)} AS {x}" for x, q in prices.LEVELS.items())},
  ((sum(round(price * 10000)::HUGEINT) * 20000 + count(*)) // (2 * count(*)))::DOUBLE / 100000000 AS mean, {half_up("stddev_samp(price)", 3)} AS deviation, min(day) AS first_day, max(day) AS last_day,
  median(size) AS median_size, {half_up("avg(lat)", 6)} AS lat, {half_up("avg(lng)", 6)} AS lng FROM k GROUP BY {keys} HAVING count(*) >= 5"""


def reference(spark, sf, keys: list[str]) -> DataFrame:
    obs = observations(spark, sf).withColumns({"lat": c("nation") / 3 + 40, "lng": c("nation") / 7})
    df = prices.trimmed_reference(obs, keys, "price", "day", lit("2001-06-01").cast("date"), size="size", place=("lat", "lng"), spread=len(keys) == 1)
    return df.withColumns({x: F.round(x, 6) for x in (*prices.LEVELS, "lat", "lng")} | {"deviation": F.round("deviation", 3)})


@query(reference_sql("p_brand, p_type"))
def trimmed_reference_fine(spark, sf):
    return reference(spark, sf, ["p_brand", "p_type"])


@query(reference_sql("p_type"))
def trimmed_reference_coarse(spark, sf):
    return reference(spark, sf, ["p_type"])


INDEX = f"""WITH {OBS}, m AS (SELECT p_type, year(day) AS year, median(price) AS median, count(*) AS n FROM obs GROUP BY 1, 2 HAVING count(*) >= 150
), l AS (SELECT p_type, arg_max(median, year) AS last FROM m GROUP BY 1), idx AS (SELECT p_type, year, n, median, greatest(0.8, least(1.25, last / median)) AS ratio FROM m JOIN l USING (p_type))"""


@query(f"{INDEX} SELECT p_type, year, n, round(median, 3) AS median, round(ratio, 6) AS ratio FROM idx")
def yearly_index(spark, sf):
    return prices.yearly_index(observations(spark, sf), ["p_type"], "price", "day").withColumns({"median": F.round("median", 3), "ratio": F.round("ratio", 6)})


@query(f"{INDEX} SELECT p_brand, count(*) AS n, round(sum(price * coalesce(ratio, 1.0)), 2) AS price FROM obs LEFT JOIN idx ON obs.p_type = idx.p_type AND year(day) = idx.year GROUP BY 1")
def indexed_price(spark, sf):
    obs = observations(spark, sf)
    index = prices.yearly_index(obs, ["p_type"], "price", "day")
    return prices.indexed(obs, index, ["p_type"], "price", "day").groupBy("p_brand").agg(F.count(lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("price"))


@query(f"WITH {OBS} SELECT count(*) AS n, count(DISTINCT p_brand) AS n_p_brand, count(DISTINCT nation) AS n_nation, min(day) AS first_day, max(day) AS last_day FROM obs")
def reference_metadata(spark, sf):
    return prices.reference_metadata(observations(spark, sf), ["p_brand", "nation"], "day")


@query(f"WITH {OBS} SELECT id, day, price FROM obs WHERE p_brand = 'Brand#2' AND p_type = 'ECONOMY' ORDER BY day DESC, id LIMIT 20")
def sector_view(spark, sf):
    return prices.sector_view(observations(spark, sf), (c("p_brand") == "Brand#2") & (c("p_type") == "ECONOMY"), [F.desc("day"), F.asc("id")], 20).select("id", "day", "price")


@query(f"WITH {OBS} SELECT p_type, count(*) AS n, round(quantile_cont(price, 0.25)) AS q1, round(quantile_cont(price, 0.5)) AS median, round(quantile_cont(price, 0.75)) AS q3, max(day) AS last_day FROM obs WHERE p_brand = 'Brand#2' GROUP BY p_type HAVING count(*) >= 5")
def sector_references(spark, sf):
    """The reference rows of a sector beside its sales."""
    reference = prices.trimmed_reference(observations(spark, sf), ["p_brand", "p_type"], "price", "day", lit(AS_OF).cast("date"), trim=(0.0, 1.0))
    return prices.sector_references(reference, c("p_brand") == "Brand#2", "p_type")


@query("""WITH n AS (SELECT o_custkey, o_orderpriority AS p, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2
), m AS (SELECT o_custkey, p FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, p) AS k FROM n) WHERE k = 1)
SELECT o_orderkey, o.o_custkey, CASE WHEN o_orderstatus = 'P' THEN p ELSE o_orderpriority END AS o_orderpriority FROM orders o LEFT JOIN m ON o.o_custkey = m.o_custkey""")
def mode_imputation(spark, sf):
    """Priorities of orders in one status are taken as unknown and set to the customer's most frequent one."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.when(c("o_orderstatus") != "P", c("o_orderpriority")).alias("o_orderpriority"))
    return tables.impute_mode(orders, orders, ["o_custkey"], "o_orderpriority").select("o_orderkey", "o_custkey", "o_orderpriority")


# --- bronze to silver --------------------------------------------------------------------------------------------


@query("SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS k FROM events) WHERE k = 1")
def latest_per_key(spark, sf):
    return tables.latest_per_key(table(spark, sf, "events"), ["user_id", "event_type"], [F.desc("ts"), F.asc("event_id")])


@query("""WITH e AS (SELECT event_id, ts, CASE WHEN event_type <> 'error' THEN user_id END AS id, CASE WHEN event_type <> 'view' THEN props END AS url, event_type FROM events
), i AS (SELECT *, coalesce('id:' || id, 'url:' || url) AS ident FROM e)
SELECT event_id, id, url FROM (SELECT *, row_number() OVER (PARTITION BY ident ORDER BY ts, event_id) AS k FROM i WHERE ident IS NOT NULL) WHERE k = 1 UNION ALL SELECT event_id, id, url FROM i WHERE ident IS NULL""")
def first_per_identity(spark, sf):
    df = table(spark, sf, "events").select("event_id", "ts", F.when(c("event_type") != "error", c("user_id")).alias("id"), F.when(c("event_type") != "view", c("props")).alias("url"))
    return tables.dedup_first(df, ["id", "url"], [F.asc("ts"), F.asc("event_id")]).select("event_id", "id", "url")


@query("""WITH i AS (SELECT CASE WHEN event_type = 'purchase' THEN user_id END AS id, event_type, ts FROM events)
SELECT id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC) AS k FROM i WHERE id IS NOT NULL) WHERE k = 1 UNION ALL SELECT DISTINCT id, event_type, ts FROM i WHERE id IS NULL""")
def compact_bronze(spark, sf):
    df = table(spark, sf, "events").select(F.when(c("event_type") == "purchase", c("user_id")).alias("id"), "event_type", "ts")
    return tables.compact(df, ["id"], [F.desc("ts")])


UPSERT = """WITH o AS (SELECT o_custkey, o_totalprice, CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS priority, o_orderdate, o_orderkey FROM orders
), a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM o WHERE o_orderdate < TIMESTAMP '1998-01-01') WHERE k = 1
), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM o WHERE o_orderdate >= TIMESTAMP '1998-01-01') WHERE k = 1)"""


@query(f"""{UPSERT} SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN b.k IS NOT NULL THEN b.o_totalprice ELSE a.o_totalprice END AS o_totalprice,
  coalesce(b.priority, a.priority) AS priority, CASE WHEN a.k IS NOT NULL THEN a.o_orderdate ELSE b.o_orderdate END AS o_orderdate FROM a FULL JOIN b ON a.o_custkey = b.o_custkey""")
def merge_upsert_policies(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_totalprice", F.when(c("o_orderstatus") != "F", c("o_orderpriority")).alias("priority"), "o_orderdate", "o_orderkey")
    part = lambda p: tables.latest_per_key(o.filter(p), ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")]).drop("o_orderkey")
    return tables.upsert(part("o_orderdate < timestamp '1998-01-01'"), part("o_orderdate >= timestamp '1998-01-01'"), ["o_custkey"], {"priority": "keep", "o_orderdate": "insert"})


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT coalesce(o_orderstatus = 'P' AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH'), false)")
def policy_filter(spark, sf):
    return tables.apply_policy(table(spark, sf, "orders"), (c("o_orderstatus") == "P") & ~c("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_orderstatus")


@query("""WITH p AS (SELECT p_partkey, p_brand, p_size, p_retailprice FROM part)
SELECT p_partkey FROM p WHERE p_brand = 'Brand#1' OR p_size > 40""")
def fingerprint_pending(spark, sf):
    """Parts that a cache of older inputs doesn't hold: of a brand that it lacks, or with another price."""
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    inputs = ["p_brand", "p_size", "p_retailprice"]
    old = part.filter("p_brand <> 'Brand#1'").withColumn("p_retailprice", F.when(c("p_size") > 40, c("p_retailprice") + 1).otherwise(c("p_retailprice")))
    cache = old.select("p_partkey", F.xxhash64(lit(1), *inputs).alias("fingerprint"))
    return tables.pending(part, cache, ["p_partkey"], inputs).select("p_partkey")


@query("""SELECT 'event_id' AS name, count(event_id) AS filled, round(count(event_id) * 100.0 / count(*), 2) AS percent FROM events
UNION ALL SELECT 'kind', count(CASE WHEN event_type <> 'view' THEN event_type END), round(count(CASE WHEN event_type <> 'view' THEN event_type END) * 100.0 / count(*), 2) FROM events
UNION ALL SELECT 'value', count(nullif(floor(value / 10), 0)), round(count(nullif(floor(value / 10), 0)) * 100.0 / count(*), 2) FROM events""")
def column_coverage(spark, sf):
    df = table(spark, sf, "events").select("event_id", F.when(c("event_type") != "view", c("event_type")).alias("kind"), F.nullif(F.floor(c("value") / 10), lit(0)).alias("value"))
    return tables.column_coverage(df)


@query("SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key")
def json_key_coverage(spark, sf):
    return tables.json_key_coverage(table(spark, sf, "events"), "props")


@query("SELECT event_id, try_cast(props ->> '$.k' AS DOUBLE) AS k FROM events")
def json_details_number(spark, sf):
    return table(spark, sf, "events").select("event_id", text_fr.json_text(c("props"), "k").try_cast("double").alias("k"))


# --- lifecycle ---------------------------------------------------------------------------------------------------


@query("""SELECT user_id, event_type, ts, value FROM (SELECT *, lag(value) OVER w AS before, row_number() OVER w AS k FROM (SELECT user_id, event_type, ts, event_id, round(value, -1) AS value FROM events) WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
WHERE k = 1 OR value IS DISTINCT FROM before""")
def price_change_log(spark, sf):
    df = table(spark, sf, "events").withColumn("value", F.round("value", -1))
    return history.change_log(df, ["user_id", "event_type"], "value", ["ts", "event_id"]).select("user_id", "event_type", "ts", "value")


@query("""WITH d AS (SELECT *, value < lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS fell FROM events WHERE value > 0)
SELECT user_id, event_type, arg_min(value, ts) AS first_value, max(value) AS most, count(*) FILTER (WHERE fell) AS n_drops, max(ts) FILTER (WHERE fell) AS last_drop FROM d GROUP BY 1, 2""")
def price_signals(spark, sf):
    return history.price_signals(table(spark, sf, "events"), ["user_id", "event_type"], "value", "ts")


@query("""WITH l AS (SELECT event_id, event_type AS source, user_id::VARCHAR AS url, ts FROM events
), i AS (SELECT DISTINCT event_type AS source, user_id::VARCHAR AS url FROM events WHERE event_type IN ('click', 'signup') AND value > 20)
SELECT event_id, CASE WHEN source IN (SELECT source FROM i) THEN (source, url) IN (SELECT (source, url) FROM i) OR (event_id % 5 = 0 AND (source, (url::BIGINT + 1)::VARCHAR) IN (SELECT (source, url) FROM i)) ELSE ts >= TIMESTAMP '2024-01-31' - CASE source WHEN 'error' THEN INTERVAL 5 DAY ELSE INTERVAL 21 DAY END END AS active FROM l""")
def activity_inventory(spark, sf):
    """Sources with an inventory by its urls, or by those under which bronze has a fifth of the adverts; the others by when they
    were seen."""
    e = table(spark, sf, "events")
    bronze = e.filter("event_id % 5 = 0").select(c("event_type").alias("source"), c("event_id").alias("id"), (c("user_id") + 1).cast("string").alias("url"))
    listings = e.select("event_id", c("event_id").cast("string").alias("external_id"), c("event_type").alias("source"), c("user_id").cast("string").alias("url"), c("ts").alias("last_seen_at"), lit(True).alias("active"))
    inventory = e.filter("event_type in ('click', 'signup') and value > 20").select(c("event_type").alias("source"), c("user_id").cast("string").alias("url"))
    return history.activity(listings, inventory, lit("2024-01-31").cast("timestamp"), ttl_days={"error": 5}, bronze=bronze).select("event_id", "active")


@query("""WITH RECURSIVE r AS (SELECT source, run_at, url_count, complete, row_number() OVER (PARTITION BY source ORDER BY run_at) AS k FROM (
  SELECT event_type AS source, date_trunc('day', ts) AS run_at, count(*) AS url_count, max(value) > 30 AS complete FROM events WHERE dayofmonth(ts) % 3 > 0 OR user_id % 5 < dayofmonth(ts) % 4 GROUP BY 1, 2)
), f AS (  -- run after run, with the runs accepted so far
  SELECT source, k, run_at, url_count, complete, complete AND url_count > 0 AS accepted, CASE WHEN complete AND url_count > 0 THEN [{'at': run_at, 'n': url_count}] ELSE [] END AS trusted FROM r WHERE k = 1
  UNION ALL
  SELECT source, k, run_at, url_count, complete, ok, CASE WHEN ok THEN list_append(trusted, {'at': run_at, 'n': url_count}) ELSE trusted END FROM (
    SELECT r.*, f.trusted, r.complete AND r.url_count > 0 AND coalesce(list_max(list_transform(list_filter(f.trusted, lambda x: x['at'] > r.run_at - INTERVAL 4 DAY), lambda x: x['n'])), 0) * 0.7 <= r.url_count AS ok FROM f JOIN r ON f.source = r.source AND r.k = f.k + 1)
)
SELECT source, run_at, url_count, complete, accepted FROM f""")
def inventory_guard(spark, sf):
    """A run a day for each kind of event, on some days a short one: it is held against accepted runs only."""
    day = F.dayofmonth("ts")
    seen = table(spark, sf, "events").filter((day % 3 > 0) | (c("user_id") % 5 < day % 4))
    runs = seen.groupBy(c("event_type").alias("source"), F.date_trunc("day", "ts").alias("run_at")).agg(F.count(lit(1)).alias("url_count"), (F.max("value") > 30).alias("complete"))
    return history.inventory_verdicts(runs, days=4).drop("most")


@query("""WITH known AS (SELECT url FROM pages WHERE length(html) > 4000), tried AS (SELECT url FROM pages WHERE html LIKE '%style%' AND length(html) < 1500)
SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM known) AND url NOT IN (SELECT url FROM tried)""")
def crawl_frontier(spark, sf):
    pages, now = table(spark, sf, "pages"), lit("2024-02-01").cast("timestamp")
    known = pages.filter("length(html) > 4000").select("url", (now - F.expr("interval 3 days")).alias("collected_at"), lit(2).alias("version"))
    tried = pages.filter("html like '%style%' and length(html) < 1500").select("url", now.alias("checked_at"))
    return history.crawl_frontier(pages, known, tried, now, revisit_days=7, version=2).select("page_id", "url")


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 30 MINUTE")
def watermark_increment(spark, sf):
    return history.increment(table(spark, sf, "events"), "ts", lit("2024-01-20 12:00:00").cast("timestamp")).select("event_id", "ts")


@query("SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS turn FROM events")
def round_robin(spark, sf):
    return history.interleave(table(spark, sf, "events"), "event_type", [F.desc("ts"), F.asc("event_id")]).select("event_id", "turn")


# --- scoring -----------------------------------------------------------------------------------------------------


@query(f"""WITH {OBS}, m AS (SELECT CASE WHEN flag <> 'N' THEN p_type ELSE '*' END AS sector, price / (size * 500) AS m, CASE WHEN discount > 0.02 THEN price / (discount * 1000000) END AS t FROM obs WHERE price / (size * 500) BETWEEN 0.5 AND 15)
SELECT sector, round(median(m), 6) AS multiple_ebe, round(median(t), 6) AS multiple_ca, count(*) AS n, grouping(sector) > 0 AS total FROM m GROUP BY GROUPING SETS ((sector), ())""")
def grouping_sets_multiple(spark, sf):
    """Multiples by sector and in total; rows of one return flag count as having no sector."""
    df = observations(spark, sf).select(F.when(c("flag") != "N", c("p_type")).alias("sector"), "price", (c("size") * 500).alias("ebe"), F.when(c("discount") > 0.02, c("discount") * 1000000).alias("turnover"))
    out = scoring.sector_multiples(df, sector="sector", price="price", ebe="ebe", turnover="turnover")
    return out.withColumns({x: F.round(x, 6) for x in ("multiple_ebe", "multiple_ca")})


@query(f"""WITH {OBS} SELECT p_brand AS type_bien, round(median(price / (size * 1000)), 6) AS ratio, count(*) AS n FROM obs WHERE flag = 'R' AND price / (size * 1000) BETWEEN 0.3 AND 15 GROUP BY 1 HAVING count(*) >= 20""")
def ratio_median_having(spark, sf):
    df = observations(spark, sf).select(c("p_brand").alias("type_bien"), c("price").alias("prix_adjuge"), (c("size") * 1000).alias("prix"), F.when(c("flag") == "R", "enchere_notariale").otherwise("gre_a_gre").alias("mode_vente"))
    return scoring.auction_ratio(df).withColumn("ratio", F.round("ratio", 6))


GROUPS = f"""WITH {OBS}, b AS (SELECT *, CASE WHEN flag <> 'A' THEN 1 ELSE 0 END AS own FROM obs
), s AS (SELECT *, CASE WHEN lag(price) OVER w IS NULL OR price > 1.03 * lag(price) OVER w THEN 1 ELSE 0 END AS step FROM b WINDOW w AS (PARTITION BY own, p_brand, p_type, size ORDER BY price, id)
), g AS (SELECT *, CASE WHEN own = 1 THEN sum(step) OVER (PARTITION BY own, p_brand, p_type, size ORDER BY price, id ROWS UNBOUNDED PRECEDING) END AS grp FROM s)"""


def groups(spark, sf):
    return duplicates.duplicate_groups(observations(spark, sf), block=["p_brand", "p_type", "size"], value="price", tie=["id"], eligible=c("flag") != "A")


@query(f'{GROUPS} SELECT id, grp::BIGINT AS "group" FROM g')
def duplicate_groups(spark, sf):
    return groups(spark, sf).select("id", "group")


@query(f"""{GROUPS}, w AS (SELECT id, grp, CASE WHEN grp IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY p_brand, p_type, size, grp ORDER BY discount DESC, id) END AS rank,
  CASE WHEN grp IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY p_brand, p_type, size, grp) END AS n_copies,
  CASE WHEN grp IS NOT NULL THEN array_to_string(list_sort(list_distinct(list(flag) OVER (PARTITION BY p_brand, p_type, size, grp))), ',') END AS sources FROM g) SELECT id, rank, n_copies, sources FROM w""")
def duplicate_representative(spark, sf):
    out = duplicates.representatives(groups(spark, sf), group=["p_brand", "p_type", "size", "group"], richness=c("discount"), tie=["id"], source="flag")
    return out.select("id", "rank", "n_copies", F.array_join("sources", ",").alias("sources"))


DEALS = f"""{TRIMMED}, d AS (SELECT s.id, s.price, n, q1, median, s.price / median - 1 AS decote, s.discount,
    CASE WHEN n >= 10 AND mean_distance <= 0.65 THEN 1.0 WHEN n >= 7 AND mean_distance <= 1.05 THEN 0.75 ELSE 0.45 END AS trust FROM stats JOIN (SELECT DISTINCT id, price, discount FROM near) s USING (id)
), scored AS (SELECT *, round(greatest(0.0, least(100.0, -100 * decote / 0.30)) * trust) AS score, CASE WHEN discount >= 0.10 THEN 8 WHEN discount >= 0.05 THEN 5 ELSE 0 END AS bonus FROM d
), final AS (SELECT *, least(100, score + bonus) AS total FROM scored)"""


def deals(spark, sf):
    """Line items as adverts: the price against the comparables' median, trusted by their number and distance."""
    own = subjects(observations(spark, sf)).select("id", "price", "discount")
    df = stats(spark, sf).join(own, "id").withColumn("decote", F.try_divide("price", "median") - 1)
    trust = F.when((c("n") >= 10) & (c("mean_distance") <= 0.65), 1.0).when((c("n") >= 7) & (c("mean_distance") <= 1.05), 0.75).otherwise(0.45)
    df = df.withColumn("score", F.round(scoring.clamp(c("decote") * -100 / 0.30) * trust))
    bonus = F.when(c("discount") >= 0.10, 8).when(c("discount") >= 0.05, 5).otherwise(0)
    return df.withColumn("total", F.least(lit(100.0), c("score") + bonus))


@query(f"{DEALS} SELECT id, n, round(decote, 6) AS decote, score FROM final")
def deal_scores(spark, sf):
    return deals(spark, sf).select("id", "n", F.round("decote", 6).alias("decote"), "score")


@query(f"""{DEALS} SELECT id, total, CASE WHEN total >= 75 THEN 'excellente' WHEN total >= 55 THEN 'bonne' WHEN total >= 30 THEN 'correcte' ELSE 'hors_cible' END AS level FROM final""")
def deal_levels(spark, sf):
    return deals(spark, sf).select("id", "total", scoring.level_of(c("total")).alias("level"))


@query(f"""{DEALS} SELECT id, round(greatest(0, 100 * (price - q1) / price), 4) AS cut_q1, round(greatest(0, 100 * (price - median * 0.85) / price), 4) AS cut_good,
  CASE WHEN y >= 10 THEN 'exceptionnel' WHEN y >= 8 THEN 'eleve' WHEN y >= 6 THEN 'correct' WHEN y >= 4 THEN 'faible' ELSE 'insuffisant' END AS band FROM (SELECT *, 1200 * (median * 0.005) / price AS y FROM final)""")
def negotiation_targets(spark, sf):
    df = deals(spark, sf).withColumns({"good": c("median") * 0.85, "rent": c("median") * 0.005})
    df = scoring.negotiation(df, "price", ["q1", "good"], "rent")
    return df.select("id", F.round("cut_q1", 4).alias("cut_q1"), F.round("cut_good", 4).alias("cut_good"), scoring.yield_band(scoring.percent(c("rent") * 1200, c("price"))).alias("band"))


@query(f"""WITH s AS (SELECT * FROM (VALUES ('usual', 7.5, 0.0, 10.0, 3.4, 20.0), ('short', 7.5, 5000.0, 20.0, 3.0, 10.0), ('free', 2.0, 0.0, 0.0, 0.0, 15.0)) AS s(name, fees, works, deposit, rate, years)
), d AS (SELECT o_orderkey, o_totalprice::DOUBLE AS price, o_totalprice::DOUBLE * 0.006::DOUBLE AS rent FROM orders
), f AS (SELECT *, price * (1 + fees::DOUBLE / 100) + works::DOUBLE AS cost, rate::DOUBLE / 1200 AS r, years::DOUBLE * 12 AS n FROM d, s
), g AS (SELECT *, cost * (1 - deposit::DOUBLE / 100) * CASE WHEN r > 0 THEN r / (1 - pow(1 + r, -n)) ELSE 1 / n END AS instalment FROM f)
SELECT o_orderkey, name, {half_up("cost", 2)} AS cost, {half_up("instalment", 2)} AS instalment, {half_up("rent - instalment", 2)} AS cash_flow FROM g""")
def financing_scenarios(spark, sf):
    scenarios = spark.createDataFrame([("usual", 7.5, 0.0, 10.0, 3.4, 20.0), ("short", 7.5, 5000.0, 20.0, 3.0, 10.0), ("free", 2.0, 0.0, 0.0, 0.0, 15.0)], "name string, fees double, works double, deposit double, rate double, years double")
    df = table(spark, sf, "orders").select("o_orderkey", c("o_totalprice").alias("price"), (c("o_totalprice") * 0.006).alias("rent"))
    return scoring.financing(df, scenarios).select("o_orderkey", "name", *[F.round(x, 2).alias(x) for x in ("cost", "instalment", "cash_flow")])


ADVERTS = f"""{TRIMMED}, i AS (SELECT o.id, CASE o.p_type WHEN 'STANDARD' THEN 'appartement' WHEN 'ECONOMY' THEN 'maison' WHEN 'PROMO' THEN 'local_commercial' ELSE 'immeuble' END AS kind, o.price AS prix, o.size * 20 AS m2, o.p_size, o.discount,
    substr('ABCDEFG', o.p_size % 7 + 1, 1) AS dpe, CASE o.p_size % 3 WHEN 0 THEN 300 WHEN 1 THEN 150 ELSE 0 END AS said, CASE WHEN o.p_size > 10 THEN o.p_size * 10.0 END AS land, n, q1 / (o.size * 20) AS q1, median / (o.size * 20) AS med, q3 / (o.size * 20) AS q3, last_day,
    median_size * 20 AS ref_m2, mean_distance AS dist, 10.0 + o.p_size / 10.0 AS rent, CASE WHEN o.discount > 0.05 THEN o.price * 0.08::DOUBLE END AS declared, o.discount > 0.07 AS let FROM stats JOIN obs o USING (id)
), s AS (SELECT *, CASE kind WHEN 'local_commercial' THEN 'murs' WHEN 'immeuble' THEN 'immeuble' ELSE 'residentiel' END AS seg, CASE WHEN kind = 'appartement' AND p_size % 5 + 1 <= 2 THEN 37.0 WHEN kind = 'appartement' THEN 72.0 WHEN kind = 'maison' THEN 92.0 ELSE m2 END AS usual,
    CASE kind WHEN 'appartement' THEN 0.75 WHEN 'maison' THEN 0.8 ELSE 1.0 END AS bend FROM i
), r AS (SELECT *, seg = 'residentiel' AND prix <= m2 * med * 0.55 AS low, CASE WHEN seg = 'murs' THEN rent * 0.9 * m2 ELSE rent * usual * pow(greatest(0.25, least(1.6, m2 / usual)), bend) * exp(ln(0.9) * 0.654) END AS low_rent,
    CASE WHEN seg = 'murs' THEN 0 WHEN dpe = 'G' THEN m2 * 350 WHEN dpe = 'F' THEN m2 * 200 ELSE 0 END AS works, declared > 0 AND let AS own FROM s
), k AS (SELECT *, coalesce(own, false) AS real, CASE WHEN own THEN declared / 12 WHEN seg <> 'murs' AND (prix / m2 < 300 OR m2 > CASE seg WHEN 'immeuble' THEN 1500 ELSE 400 END) THEN NULL WHEN seg = 'immeuble' THEN low_rent * 0.85 ELSE low_rent END AS kept, prix * 1.075 + works AS cost FROM r
), m AS (SELECT *, kept * 12 * 11 / 12 AS cashed, kept * 1.2 AS tax, CASE WHEN kind = 'appartement' THEN m2 * 25 * 0.35 ELSE 0 END AS condo FROM k
), d AS (SELECT *, cashed - tax - condo - 200 - cashed * 0.05 AS net, cost * 0.9 * (3.4 / 1200 / (1 - pow(1 + 3.4 / 1200, -240))) AS loan,
    CASE WHEN NOT low THEN (prix + CASE WHEN seg = 'residentiel' THEN works ELSE 0 END) / (m2 * med * CASE WHEN seg = 'residentiel' AND let THEN 0.85 ELSE 1 END) - 1 END AS decote FROM m
), e AS (SELECT *, 100 * net / cost AS yield, CASE WHEN low THEN 'indisponible' WHEN seg <> 'residentiel' THEN 'indicative'
    WHEN n >= 10 AND dist <= 0.65 AND (q3 - q1) / med <= 0.28 AND ref_m2 BETWEEN m2 * 0.85 AND m2 * 1.15 AND last_day >= DATE '2000-01-01' AND NOT let AND dpe BETWEEN 'A' AND 'E' AND said >= 250 AND (kind <> 'maison' OR land IS NOT NULL) THEN 'fiable'
    WHEN n >= 7 AND dist <= 1.05 AND (q3 - q1) / med <= 0.45 THEN 'indicative' ELSE 'fragile' END AS trust FROM d
), f AS (SELECT *, CASE WHEN said < 120 THEN 0.8 ELSE 1.0 END AS short,
    CASE WHEN decote IS NOT NULL AND seg = 'residentiel' THEN round(greatest(0, least(100, -100 * decote / 0.3)) * CASE trust WHEN 'fiable' THEN 1.0 WHEN 'indicative' THEN 0.75 ELSE 0.45 END * CASE WHEN kind = 'maison' AND land IS NULL THEN 0.85 ELSE 1 END * CASE WHEN said < 120 THEN 0.8 ELSE 1.0 END) END AS s_decote,
    CASE WHEN seg <> 'murs' AND NOT low AND yield IS NOT NULL THEN round(least(CASE WHEN real THEN 100 ELSE 70 END, greatest(0, least(100, (yield - 3) / 5 * 100)) * CASE WHEN decote > 0 THEN greatest(0.35, 1 - decote) ELSE 1 END * CASE WHEN real THEN 1.0 WHEN n * 3 >= 30 THEN 0.85 ELSE 0.65 END * CASE WHEN said < 120 THEN 0.8 ELSE 1.0 END)) END AS s_yield,
    CASE WHEN seg = 'murs' AND yield IS NOT NULL THEN round(greatest(0, least(100, (yield - 4) / 6 * 100)) * CASE WHEN real THEN 1.0 WHEN n * 3 >= 8 THEN 0.6 ELSE 0.45 END) END AS s_walls,
    CASE WHEN 100 * discount / (1 + discount) >= 10 THEN 8 WHEN 100 * discount / (1 + discount) >= 5 THEN 5 ELSE 0 END AS bonus FROM e
), g AS (SELECT *, greatest(coalesce(s_decote, -1), coalesce(s_yield, -1), coalesce(s_walls, -1)) AS best FROM f)
SELECT id, round(decote, 6) AS decote, round(yield, 6) AS rendement_net, round(net / 12 - loan, 4) AS cashflow, trust AS confiance, s_decote AS score_decote, s_yield AS score_rendement, s_walls AS score_murs, CASE WHEN best >= 0 THEN least(100, best + bonus) END AS score_global,
  CASE WHEN best < 0 THEN NULL WHEN s_walls = best THEN 'murs' WHEN s_yield = best THEN 'rendement' ELSE 'decote' END AS strategie,
  CASE WHEN low THEN 'a_verifier' WHEN best < 0 THEN 'a_analyser' WHEN best + bonus >= 75 THEN 'excellente' WHEN best + bonus >= 55 THEN 'bonne' WHEN best + bonus >= 30 THEN 'correcte' ELSE 'hors_cible' END AS niveau FROM g"""


@query(ADVERTS)
def deal_analysis(spark, sf):
    """The whole scoring chain over line items dressed as adverts: type from the part, surface from the quantity, rents from
    the part's size, comparables as found."""
    own = observations(spark, sf).filter("l_orderkey % 50 = 0").select("id", "p_type", "p_size", c("price").alias("prix"), (c("size") * 20).alias("surface_bati"), "discount")
    df = stats(spark, sf).join(own, "id")
    kind = F.when(c("p_type") == "STANDARD", "appartement").when(c("p_type") == "ECONOMY", "maison").when(c("p_type") == "PROMO", "local_commercial").otherwise("immeuble")
    none = lambda kind: lit(None).cast(kind)
    rent = lit(10.0) + c("p_size") / 10.0
    inputs = df.select(
        "id", lit("s").alias("source"), c("id").cast("string").alias("external_id"), lit("vente").alias("categorie"), kind.alias("type_bien"), "prix", "surface_bati", (c("p_size") % 5 + 1).alias("nb_pieces"), F.when(c("p_size") > 10, c("p_size") * 10.0).alias("surface_terrain"),
        F.substring(lit("ABCDEFG"), c("p_size") % 7 + 1, lit(1)).alias("dpe"), F.when(c("p_size") % 3 == 0, F.repeat(lit("x"), lit(300))).when(c("p_size") % 3 == 1, F.repeat(lit("x"), lit(150))).alias("description"), lit("").alias("titre"), lit('{"a": 1}').alias("details_json"),
        none("string").alias("segment"), none("string").alias("mode_vente"), none("double").alias("prix_adjuge"), lit(1.65).alias("ratio_adjudication"), lit(2.7).alias("multiple_ebe_reference"), lit(0.7).alias("multiple_ca_reference"),
        c("n").alias("nb_ventes"), *[F.try_divide(x, "surface_bati").alias(f"{x}_eur_m2") for x in ("q1", "median", "q3")], c("last_day").alias("derniere_vente"), (c("median_size") * 20).alias("surface_mediane_reference"), c("mean_distance").alias("score_comparabilite"),
        rent.alias("loyer_m2_mois"), (rent * 0.9).alias("loyer_m2_bas"), (rent * 1.1).alias("loyer_m2_haut"), (c("n") * 3).alias("nb_observations_loyer"), lit(0.6).alias("r2_loyer"),
        F.when(c("discount") > 0.05, c("prix") * 0.08).alias("loyer_annuel_declare"), (c("discount") > 0.07).alias("bien_loue"), (c("prix") * (c("discount") + 1)).alias("prix_max_observe"),
        *[none("double").alias(x) for x in ("chiffre_affaires", "ebe", "taxe_fonciere", "travaux_annonces", "charges_copro_annuelles", "lat")], none("date").alias("published_at"), lit("2001-01-01").cast("date").alias("first_seen_at"), lit(True).alias("active"), none("string").alias("code_postal"), none("int").alias("image_count"),
    )
    out = scoring.analyse_deals(inputs, lit(AS_OF).cast("date"))
    return out.select(
        "id", F.round("decote", 6).alias("decote"), F.round("rendement_net", 6).alias("rendement_net"), F.round("cashflow_mensuel", 4).alias("cashflow"), "confiance", "score_decote", "score_rendement", "score_murs", "score_global", "strategie", c("niveau_affaire").alias("niveau"),
    )


@query("""SELECT p_partkey::VARCHAR AS external_id, CASE WHEN p_size > 25 THEN 'location' ELSE 'vente' END AS categorie, CASE p_brand WHEN 'Brand#1' THEN 'bureau' WHEN 'Brand#2' THEN 'immeuble' ELSE 'autre' END AS type_bien,
  CASE WHEN p_size <= 25 THEN p_retailprice END AS prix, CASE WHEN p_size > 25 THEN p_retailprice END AS loyer, p_size::DOUBLE AS surface_bati, p_name AS titre FROM part WHERE NOT (p_size > 25 AND p_brand IN ('Brand#1', 'Brand#2', 'x')) AND p_size <= 25""")
def normalise_profile(spark, sf):
    """Parts as bronze strings of a professional source, each seen twice; rentals other than of shops are dropped."""
    from ..operators import normalise as norm

    part = table(spark, sf, "part")
    kind = F.when(c("p_brand") == "Brand#1", "bureau").when(c("p_brand") == "Brand#2", "immeuble").otherwise("villa")
    b = part.select(c("p_partkey").cast("string").alias("id"), F.concat(F.when(c("p_size") > 25, "location ").otherwise("vente "), kind).alias("type_hint"), c("p_retailprice").cast("string").alias("price"), c("p_size").cast("string").alias("surface"), c("p_name").alias("name"), lit("2024-02-01").alias("_collected_at"))
    older = b.withColumns({"price": lit("n.c."), "_collected_at": lit("2024-01-01")})
    silver = norm.normalise(b.unionByName(older), "parts", norm.PROFILES["professional"], lit("2024-03-01").cast("timestamp"))
    return norm.drop_rentals(silver).select("external_id", "categorie", "type_bien", "prix", "loyer", "surface_bati", "titre")


@query()
def finance_records(spark, sf):
    """Finance figures of all documents and conversations' texts, taken as adverts of 200 000 euros."""
    from ..functions.finance import extract_finance

    docs = table(spark, sf, "documents").select(lit("documents").alias("source"), c("doc_id").cast("string").alias("external_id"), "text")
    chats = table(spark, sf, "conversations").select(lit("conversations").alias("source"), F.concat_ws("-", "conv_id", "turn").alias("external_id"), "text")
    df = docs.unionByName(chats).select("source", "external_id", lit("").alias("titre"), c("text").alias("description"), lit("{}").alias("details_json"), lit(200000.0).alias("prix"), lit("appartement").alias("type_bien"))
    return extract_finance(df).drop("fingerprint")


# --- search ------------------------------------------------------------------------------------------------------


@query(f"WITH {OBS} SELECT id, price FROM obs WHERE p_type = 'STANDARD' AND price BETWEEN 20000 AND 60000 AND flag <> 'R' ORDER BY price DESC NULLS LAST, id LIMIT 50 OFFSET 25")
def filter_sort_page(spark, sf):
    df = observations(spark, sf).filter((c("p_type") == "STANDARD") & c("price").between(20000, 60000) & (c("flag") != "R"))
    return search.page(search.ordered(df, "price", True, ["id"]), 50, 25).select("id", "price")


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, round(avg(o_totalprice), 2) AS mean_price, median(o_totalprice) AS median_price, median(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT') AS median_urgent, min(o_orderdate) AS first_day FROM orders""")
def summary_counts(spark, sf):
    orders = table(spark, sf, "orders")
    one = search.summary(orders, total=F.count(lit(1)), finished=F.count_if(c("o_orderstatus") == "F"), mean_price=F.round(F.avg("o_totalprice"), 2), first_day=F.min("o_orderdate"))
    return search.with_medians(orders, one, median_price=c("o_totalprice"), median_urgent=F.when(c("o_orderpriority") == "1-URGENT", c("o_totalprice")))


@query("SELECT count(*) FILTER (WHERE c_acctbal > 5000) AS rich, count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS machinery, count(*) FILTER (WHERE c_acctbal < 0) AS debtors FROM customer")
def tab_counts(spark, sf):
    return search.tab_counts(table(spark, sf, "customer"), {"rich": c("c_acctbal") > 5000, "machinery": c("c_mktsegment") == "MACHINERY", "debtors": c("c_acctbal") < 0})


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def facets(spark, sf):
    return search.facet(table(spark, sf, "customer"), "c_mktsegment")


@query("""WITH d AS (SELECT CASE WHEN c_acctbal > 5000 THEN upper(n_name) ELSE lower(n_name) END AS city FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT city, n FROM (SELECT min(CASE WHEN city = upper(city) THEN 'b' ELSE 'a' END || city)[2:] AS city, count(*) AS n FROM d WHERE lower(strip_accents(city)) LIKE '%nation_1%' GROUP BY lower(strip_accents(city))) ORDER BY n DESC, city LIMIT 20""")
def city_search(spark, sf):
    df = table(spark, sf, "customer").join(table(spark, sf, "nation"), c("c_nationkey") == c("n_nationkey"))
    return search.cities(df.select(F.when(c("c_acctbal") > 5000, F.upper("n_name")).otherwise(F.lower("n_name")).alias("city")), "city", like="nation_1")


SEARCHES = [("dear", "value > 30"), ("views", "event_type = 'view'"), ("cheap errors", "event_type = 'error' and value < 5")]


@query("""WITH f AS (SELECT event_type, min(ts) AS first_seen FROM events GROUP BY 1), s AS (SELECT * FROM (VALUES ('dear', TIMESTAMP '2024-01-28'), ('views', TIMESTAMP '2024-01-29'), ('cheap errors', TIMESTAMP '2023-12-31')) AS s(search, since))
SELECT search, event_id FROM events JOIN f USING (event_type), s WHERE CASE search WHEN 'dear' THEN value > 30 WHEN 'views' THEN event_type = 'view' ELSE event_type = 'error' AND value < 5 END
  AND ((ts >= since AND ts > first_seen + INTERVAL 1 DAY) OR CASE WHEN value < 1 THEN ts + INTERVAL 2 DAY END >= since)""")
def saved_search_matches(spark, sf):
    df = table(spark, sf, "events").withColumn("last_drop", F.when(c("value") < 1, c("ts") + F.expr("interval 2 days")))
    state = spark.createDataFrame([("dear", "2024-01-28"), ("views", "2024-01-29"), ("cheap errors", "2023-12-31")], "search string, since string").withColumn("since", c("since").cast("timestamp"))
    return search.search_matches(df, [(n, F.expr(p)) for n, p in SEARCHES], state, source="event_type", first_seen="ts", last_drop="last_drop").select("search", "event_id")


@query("""WITH f AS (SELECT event_type, min(ts) AS first_seen FROM events GROUP BY 1)
SELECT s.search, count(event_id) AS total, count(*) FILTER (WHERE (ts >= TIMESTAMP '2024-01-29' AND ts > first_seen + INTERVAL 1 DAY) OR CASE WHEN value < 1 THEN ts + INTERVAL 2 DAY END >= TIMESTAMP '2024-01-29') AS recent
FROM (VALUES ('dear'), ('views'), ('cheap errors')) AS s(search) LEFT JOIN (SELECT * FROM events JOIN f USING (event_type)) ON CASE search WHEN 'dear' THEN value > 30 WHEN 'views' THEN event_type = 'view' ELSE event_type = 'error' AND value < 5 END GROUP BY 1""")
def search_counts(spark, sf):
    df = table(spark, sf, "events").withColumn("last_drop", F.when(c("value") < 1, c("ts") + F.expr("interval 2 days")))
    return search.search_counts(df, [(n, F.expr(p)) for n, p in SEARCHES], lit("2024-01-31").cast("timestamp"), source="event_type", first_seen="ts", last_drop="last_drop")


@query(f"""WITH {OBS} SELECT id AS "Référence", p_type AS "Type", replace(regexp_replace(printf('%.2f', price), '(\\.\\d+?)0+$', '\\1'), '.', ',') AS "Prix", CASE WHEN flag = 'R' THEN 'oui' ELSE 'non' END AS "Retour" FROM obs ORDER BY price DESC, id LIMIT 5000""")
def export_rows(spark, sf):
    df = observations(spark, sf).withColumn("back", c("flag") == "R")
    out = search.export_rows(df, {"id": "Référence", "p_type": "Type", "price": "Prix", "back": "Retour"}, order=[F.desc("price"), F.asc("id")])
    return out.withColumn("Référence", c("Référence").cast("long"))


@query(f"""WITH {OBS} SELECT id, p_type, {half_up("rate", 4)} AS rate, flag FROM (SELECT id, p_type, rate, CASE WHEN flag <> 'N' THEN flag END AS flag, price FROM obs ORDER BY price DESC NULLS LAST, id LIMIT 15000)""")
def feed_json(spark, sf):
    df = observations(spark, sf).withColumn("flag", F.when(c("flag") != "N", c("flag")))
    out = search.feed(df, ["p_type", "rate", "flag"], score="price", key=["id"])
    return out.select("id", F.get_json_object("json", "$.p_type").alias("p_type"), F.get_json_object("json", "$.rate").cast("double").alias("rate"), F.get_json_object("json", "$.flag").alias("flag"))


# --- texts and pages ---------------------------------------------------------------------------------------------


@query("SELECT doc_id, md5(lower(strip_accents(text))) AS folded FROM documents")
def fold_key(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text_fr.fold(c("text"))).alias("folded"))


FLAG_SQL = ", ".join(f"regexp_matches(t, '{p}') AS {k}" for k, p in text_fr.FLAGS.items())


@query(f"SELECT doc_id, {FLAG_SQL} FROM (SELECT doc_id, lower(strip_accents(text)) AS t FROM documents)")
def text_flags(spark, sf):
    df = table(spark, sf, "documents").withColumn("t", text_fr.fold(c("text")))
    return df.select("doc_id", *[c("t").rlike(text_fr.quick(p)).alias(k) for k, p in text_fr.FLAGS.items()])


@query("""SELECT p_partkey, kind FROM (SELECT p_partkey, CASE p_type WHEN 'STANDARD' THEN 'maison' WHEN 'ECONOMY' THEN 'immeuble' WHEN 'PROMO' THEN 'autre' ELSE 'bureau' END AS kind FROM part)""")
def type_from_text(spark, sf):
    """Advert sentences made of a part's words: the type whose word stands first."""
    said = F.when(c("p_type") == "STANDARD", "Une maison avec terrain et garage : ").when(c("p_type") == "ECONOMY", "Immeuble de rapport, appartements loués, ").when(c("p_type") == "PROMO", "Un emplacement de parking près d'une maison, ").otherwise("Des bureaux et un local commercial, ")
    return table(spark, sf, "part").select("p_partkey", text_fr.type_from_text(F.concat(said, c("p_name"))).alias("kind"))


@query("SELECT p_partkey, CASE WHEN p_size > 30 THEN 'libre' WHEN p_size > 15 THEN 'occupé' END AS occupancy, p_retailprice AS amount FROM part")
def occupancy_amount(spark, sf):
    state = F.when(c("p_size") > 30, "Libre de toute occupation").when(c("p_size") > 15, "Occupé par la propriétaire").otherwise("À visiter")
    said = F.concat(state, lit(", prix "), F.replace(F.format_string("%.2f", c("p_retailprice")), lit("."), lit(",")), lit(" €"))
    return table(spark, sf, "part").select("p_partkey", text_fr.occupancy(said).alias("occupancy"), text_fr.amount(said).alias("amount"))


@query("""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, len(regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1))::BIGINT AS n_links,
  md5(array_to_string(regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1), chr(10))) AS links FROM pages""")
def link_extract_state(spark, sf):
    found = page_source.links(c("html"))
    return table(spark, sf, "pages").select("page_id", page_source.title(c("html")).alias("title"), F.size(found).cast("long").alias("n_links"), F.md5(F.array_join(found, "\n")).alias("links"))


@query()
def html_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", page_source.html_to_text(c("html")).alias("text"))


@query("""SELECT doc_id, len(f)::BIGINT AS n, round(coalesce(list_sum(list_transform(f, lambda x: replace(replace(x, ' ', ''), ',', '.')::DOUBLE)), 0), 2) AS total
FROM (SELECT doc_id, regexp_extract_all(text, '(\\d+(?: \\d{3})*(?:,\\d{1,2})?) ?(?:€|euros?)', 1) AS f FROM documents)""")
def amounts_in_text(spark, sf):
    found = page_source.amounts(c("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(found).cast("long").alias("n"), F.round(F.coalesce(F.aggregate(found, lit(0.0), lambda a, b: a + b), lit(0.0)), 2).alias("total"))
