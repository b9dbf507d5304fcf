"""Queries of what is kept between runs: saved searches as rows, comparables kept up, tables merged in part, sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import percolator, places, sketches, text_index, upkeep, variants
from ..operators.tables import update_from as updated
from ..sources import advert_files, buckets
from .adverts import DEALS, FOLDED_CITY, deals
from .catalogue import AS_OF, LINES, NEAR, OBS, lines, observations, pool, query, search_near, subjects, table
from .shared import Workspace

c, lit = F.col, F.lit

# --- saved searches --------------------------------------------------------------------------------------------------

#: A search for each customer: parts of its query string, and what they ask for.
KEY = "c_custkey"
ASKS = [
    (f"case {KEY} % 3 when 0 then 'segment=residentiel&segment=immeuble' when 1 then concat('segment=', case {KEY} % 4 when 0 then 'murs' when 1 then 'fonds' else 'residentiel' end) end",
     f"CASE {KEY} % 3 WHEN 0 THEN segment IN ('residentiel', 'immeuble') WHEN 1 THEN segment = CASE {KEY} % 4 WHEN 0 THEN 'murs' WHEN 1 THEN 'fonds' ELSE 'residentiel' END ELSE true END"),
    (f"case when {KEY} % 5 = 0 then 'type_bien=maison&type_bien=appartement&type_bien=maison' end", f"({KEY} % 5 <> 0 OR type_bien IN ('maison', 'appartement'))"),
    (f"case {KEY} % 4 when 1 then 'department=69&department=1' when 2 then 'department=2a' when 3 then 'unknown=1&&department=' end", f"CASE {KEY} % 4 WHEN 1 THEN code_postal LIKE '69%' WHEN 2 THEN code_postal LIKE '20%' ELSE true END"),
    (f"case when {KEY} % 7 = 0 then 'city=+%C3%A9vreux' end", f"({KEY} % 7 <> 0 OR folded = 'evreux')"),
    (f"case when {KEY} % 17 = 3 then 'postal_code=6900' end", f"({KEY} % 17 <> 3 OR code_postal LIKE '6900%')"),
    (f"case when {KEY} % 2 = 0 then concat('price_min=', cast({KEY} % 200 * 1000 as string), '&price_max=', cast({KEY} % 200 * 1000 + 60000 as string)) when {KEY} % 29 = 3 then 'price_max=40000.5' when {KEY} % 29 = 5 then 'price_min=9&price_max=2' end",
     f"CASE WHEN {KEY} % 2 = 0 THEN coalesce(prix, loyer) BETWEEN {KEY} % 200 * 1000 AND {KEY} % 200 * 1000 + 60000 WHEN {KEY} % 29 = 3 THEN coalesce(prix, loyer) <= 40000.5 WHEN {KEY} % 29 = 5 THEN false ELSE true END"),
    (f"case when {KEY} % 3 = 1 then concat('yield_min=', cast({KEY} % 8 as string), '.5&surface_min=30&surface_max=150') end", f"({KEY} % 3 <> 1 OR (rendement_net >= {KEY} % 8 + 0.5 AND surface_bati BETWEEN 30 AND 150))"),
    (f"case when {KEY} % 10 = 3 then 'new_days=30.9' when {KEY} % 10 = 4 then 'new_days=soon' end", f"({KEY} % 10 <> 3 OR jours_en_ligne <= 30)"),
    (f"case {KEY} % 6 when 1 then 'auctions=exclude' when 3 then 'auctions=only' when 5 then 'auctions=all' end", f"CASE {KEY} % 6 WHEN 1 THEN NOT vente_encheres WHEN 3 THEN vente_encheres ELSE true END"),
    (f"case {KEY} % 9 when 4 then 'cashflow_positive=true' when 5 then 'scored_only=true&price_drop=true' when 6 then 'real_rent=true&level=bonne&level=excellente' when 7 then 'scored_only=yes' end",
     f"CASE {KEY} % 9 WHEN 4 THEN cashflow_mensuel >= 0 WHEN 5 THEN score_global IS NOT NULL AND baisse_prix_pct >= 1 WHEN 6 THEN loyer_reel AND niveau_affaire IN ('bonne', 'excellente') ELSE true END"),
    (f"case when {KEY} % 13 = 5 then concat('q=lac+', cast({KEY} % 10 as string)) when {KEY} % 13 = 6 then 'q=a%5Cb' end", f"CASE {KEY} % 13 WHEN 5 THEN titre ILIKE '%lac ' || ({KEY} % 10) || '%' OR description ILIKE '%lac ' || ({KEY} % 10) || '%' OR ville ILIKE '%lac ' || ({KEY} % 10) || '%' WHEN 6 THEN false ELSE true END"),
    (f"case when {KEY} % 11 = 0 then 'include_inactive=true' end", f"({KEY} % 11 = 0 OR active IS NOT false)"),
    (f"case when {KEY} % 11 = 1 then 'include_duplicates=true' end", f"({KEY} % 11 = 1 OR rang_doublon = 1)"),
]
ASKED = " AND ".join(f"coalesce({w}, false)" for _, w in ASKS)
SINCE = "timestamp '2001-05-01 00:00:00'"


def customers_searches(spark, sf):
    """A saved search of each customer, last told of at one of three times."""
    return table(spark, sf, "customer").select(c(KEY).alias("search"), F.concat_ws("&", *[F.expr(e) for e, _ in ASKS]).alias("query"), (F.expr(SINCE) + F.make_interval(months=c(KEY).cast("int") % 3)).alias("since"))


MATCHED = f"{DEALS}, advert AS (SELECT *, {FOLDED_CITY} AS folded FROM deal), pair AS (SELECT {KEY} AS search, d.* FROM customer JOIN advert d ON {ASKED})"
RECENT = "(first_seen_at >= {at} AND first_seen_at > f + INTERVAL 1 DAY) OR coalesce(derniere_baisse >= {at}, false)"


@query(f"""WITH {MATCHED}, f AS (SELECT source, min(first_seen_at) AS f FROM deal GROUP BY source)
SELECT {KEY} AS search, count(external_id) AS total, count(*) FILTER (WHERE {RECENT.format(at="TIMESTAMP '2001-07-30'")}) AS recent FROM customer LEFT JOIN (SELECT * FROM pair JOIN f USING (source)) ON search = {KEY} GROUP BY 1""")
def percolator_counts(spark, sf):
    """A saved search for each customer against all adverts: one plan, whatever their number."""
    return percolator.percolator_counts(deals(spark, sf), customers_searches(spark, sf), lit("2001-08-01").cast("timestamp"), key=["external_id"])


@query(f"""WITH {MATCHED}, f AS (SELECT source, min(first_seen_at) AS f FROM deal GROUP BY source)
SELECT search, external_id FROM pair JOIN f USING (source) WHERE {RECENT.format(at="(TIMESTAMP '2001-05-01' + (search % 3)::INTEGER * INTERVAL 1 MONTH)")}""")
def percolator_alerts(spark, sf):
    return percolator.percolator_alerts(deals(spark, sf), customers_searches(spark, sf), keep=["external_id"])


# --- comparables kept up ---------------------------------------------------------------------------------------------

BATCHES = 3


def found_near(asked, offered):
    """The search of ``comparables_topk``."""
    return search_near(asked, offered).select("id", "v_id", "distance", "rank")


@query(f"""{NEAR}, upto AS (SELECT near.*, v_id % {BATCHES} AS batch, b FROM near, (SELECT unnest(range({BATCHES})) AS b) WHERE v_id % {BATCHES} <= b
), first AS (SELECT * FROM upto QUALIFY row_number() OVER (PARTITION BY id, b ORDER BY distance, v_id) <= 15
), touched AS (SELECT id, count(DISTINCT b) AS touched FROM first WHERE batch = b GROUP BY id)
SELECT id, v_id, rank, round(distance, 6) AS distance, touched::INTEGER AS touched FROM ranked JOIN touched USING (id)""")
def comparables_in_batches(spark, sf):
    """The pool comes in three batches; the result is that of one search in all, with how many batches changed a subject."""
    ws, obs = Workspace(spark, "batches"), observations(spark, sf)
    asked, offered = ws.write(subjects(obs), "subjects"), pool(obs)
    kept = None
    for b in range(BATCHES):
        batch, before = offered.filter(c("v_id") % BATCHES == b), kept
        kept = ws.write(upkeep.first_nearest(asked, batch, found_near) if before is None else upkeep.add_to_nearest(before, asked, batch, found_near, subject_key=["id"], pool_key=["v_id"], k=15), "kept")
        if before is not None:
            ws.drop(before)
    return kept.select("id", "v_id", "rank", F.round("distance", 6).alias("distance"), "touched")


@query(f"""{NEAR}, stays AS (SELECT * FROM near WHERE v_id % 7 <> 3
), again AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, v_id) AS r FROM stays
), hit AS (SELECT DISTINCT id FROM ranked WHERE v_id % 7 = 3)
SELECT id, v_id, r AS rank, round(distance, 6) AS distance, CASE WHEN hit.id IS NULL THEN 1 ELSE 2 END AS touched FROM again LEFT JOIN hit USING (id) WHERE r <= 15""")
def comparables_without_gone(spark, sf):
    """A seventh of the sales are taken back: subjects that held one of them are searched again."""
    ws, obs = Workspace(spark, "gone"), observations(spark, sf)
    asked, offered = ws.write(subjects(obs), "subjects"), pool(obs)
    kept = ws.write(upkeep.first_nearest(asked, offered, found_near), "kept")
    out = upkeep.drop_from_nearest(kept, asked, offered, offered.filter("v_id % 7 = 3").select("v_id"), found_near, subject_key=["id"], pool_key=["v_id"])
    return out.select("id", "v_id", "rank", F.round("distance", 6).alias("distance"), "touched")


# --- tables merged in part -------------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT o_custkey AS k, max(o_orderkey) AS first_order, sum(o_totalprice) AS total FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1
), b AS (SELECT o_custkey AS k, max(o_orderkey) AS first_order, CASE WHEN o_custkey % 2 = 0 THEN sum(o_totalprice) END AS total FROM orders WHERE o_orderkey % 3 = 1 AND o_custkey % 5 = 0 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.first_order, b.first_order) AS first_order, round(coalesce(b.total, a.total), 2) AS total FROM a FULL JOIN b ON a.k = b.k""")
def merge_in_buckets(spark, sf):
    """A table in buckets, a batch upserted into those it touches (the first order is kept, a null total too), read again."""
    orders, path = table(spark, sf, "orders"), f"{Workspace(spark, 'buckets').path}/customers"
    by = lambda d: d.groupBy(c("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("first_order"), F.sum("o_totalprice").alias("total"))
    buckets.merge_buckets(spark, path, by(orders.filter("o_orderkey % 3 = 0")), ["k"], 16)
    batch = by(orders.filter("o_orderkey % 3 = 1 and o_custkey % 5 = 0")).withColumn("total", F.when(c("k") % 2 == 0, c("total")))
    buckets.merge_buckets(spark, path, batch, ["k"], 16, {"first_order": "insert", "total": "keep"})
    return buckets.read_buckets(spark, path).select("k", "first_order", F.round("total", 2).alias("total"))


@query(f"""WITH {LINES}, r AS (SELECT * FROM line WHERE l_returnflag = 'R' QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber) = 1)
SELECT o_orderkey, o_custkey, CASE WHEN l_orderkey IS NULL THEN o_orderstatus ELSE 'R' END AS o_orderstatus, round(CASE WHEN l_orderkey IS NULL THEN o_totalprice ELSE o_totalprice - l_extendedprice END, 2) AS o_totalprice FROM orders LEFT JOIN r ON o_orderkey = l_orderkey""")
def update_from(spark, sf):
    """Orders updated from the last of their lines that came back."""
    back = lines(spark, sf).filter("l_returnflag = 'R'").select(c("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_shipdate", "l_extendedprice")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    out = updated(orders, back, ["o_orderkey"], {"o_orderstatus": lit("R"), "o_totalprice": c("o_totalprice") - c("new_l_extendedprice")}, [F.desc("l_shipdate"), F.asc("l_linenumber")])
    return out.withColumn("o_totalprice", F.round("o_totalprice", 2))


# --- references from sketches ----------------------------------------------------------------------------------------

PROBS = [0.05, 0.25, 0.5, 0.75, 0.95]
SPAN = 36


@query(f"""WITH {OBS}, w AS (SELECT * FROM obs WHERE day >= DATE '{AS_OF}'::DATE - INTERVAL {SPAN} MONTH AND day < date_trunc('month', DATE '{AS_OF}') AND (year(day) * 12 + month(day)) >= year(DATE '{AS_OF}') * 12 + month(DATE '{AS_OF}') - {SPAN})
SELECT p_brand, count(*) AS n, round(avg(price), 2) AS mean, min(price) AS least, max(price) AS most, {", ".join(f"true AS ok{i}" for i in range(len(PROBS)))}, true AS ok_nation FROM w GROUP BY p_brand""")
def sketched_reference(spark, sf):
    """Sketches by brand and month, written for the years up to one, then for the rest, and merged over three years: the ranks
    of their quantiles are within 1 % of those asked for, numbers of nations within 5 %."""
    obs, path = observations(spark, sf), f"{Workspace(spark, 'sketches').path}/months"
    last = int(AS_OF[:4]) * 12 + int(AS_OF[5:7]) - 1
    for months in (range(last - 240, last - 12), range(last - 12, last + 1)):
        sketches.add_months(spark, path, obs, ["p_brand"], "price", "day", months, ["nation"])
    got = sketches.merged_reference(spark.read.parquet(path), ["p_brand"], lit(AS_OF).cast("date"), SPAN, PROBS)
    window = obs.withColumn("m", sketches.month_of(c("day"))).filter(c("m").between(last - SPAN, last - 1))
    ranks = [F.count_if(c("price") < c("q")[i]).alias(f"below{i}") for i in range(len(PROBS))] + [F.count_if(c("price") <= c("q")[i]).alias(f"upto{i}") for i in range(len(PROBS))]
    seen = window.join(got.select("p_brand", "q"), "p_brand").groupBy("p_brand").agg(*ranks, F.count_distinct("nation").alias("nations"))
    ok = [((c(f"below{i}") <= (p + 0.01) * c("n")) & (c(f"upto{i}") >= (p - 0.01) * c("n"))).alias(f"ok{i}") for i, p in enumerate(PROBS)]
    return got.join(seen, "p_brand").select("p_brand", "n", F.round("mean", 2).alias("mean"), "least", "most", *ok, (F.abs(c("n_nation") - c("nations")) <= 0.05 * c("nations")).alias("ok_nation"))


# --- substrings ------------------------------------------------------------------------------------------------------

#: Five terms of each benchmark item: stretches of its text, longer ones and one of two characters.
TERMS = 5
TERM = "substr(text, 7 * k + 1, case when k = 4 then 2 else 6 + 3 * k end)"


@query(f"""WITH t AS (SELECT DISTINCT {TERM} AS term FROM benchmark, (SELECT unnest(range({TERMS})) AS k) WHERE {TERM} <> ''), d AS (SELECT doc_id, lower(text) AS low FROM documents)
SELECT term, doc_id FROM d JOIN t ON contains(low, lower(term))""")
def substring_search(spark, sf):
    """Terms from the benchmark in all documents, by an index that is written once and asked twice: terms of two characters and the
    others."""
    docs, path = table(spark, sf, "documents"), f"{Workspace(spark, 'trigrams').path}/index"
    text_index.write_index(docs, path, "doc_id", "text")
    terms = table(spark, sf, "benchmark").select("text", F.explode(F.sequence(lit(0), lit(TERMS - 1))).alias("k")).select(F.expr(TERM).alias("term"))
    found = [text_index.find_terms(docs, terms.filter(p), path, "doc_id", "text") for p in ("length(term) <= 2", "length(term) > 2")]
    return found[0].unionByName(found[1])


# --- bronze rows as variants -----------------------------------------------------------------------------------------

#: Three batches of parts: a price that is a number, then a text, then a list; tags that are a list, then an object.
VARIED = """x AS (SELECT p_partkey AS id, 'a' AS batch, 'NUMBER' AS price_kind, p_retailprice AS price, p_retailprice::VARCHAR AS said, NULL AS tags_kind, NULL AS tag, p_name AS name FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, 'b', 'STRING', NULL, 'sur demande', 'ARRAY', p_size, NULL FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, 'c', 'ARRAY', NULL, '[' || p_partkey || ',900000]', CASE WHEN p_size % 2 = 0 THEN 'OBJECT' ELSE 'NULL' END, CASE WHEN p_size % 2 = 0 THEN p_size END, p_name FROM part WHERE p_partkey % 5 = 0)"""


def varied(spark, sf):
    """The three batches, the last one from JSON lines, the first one written twice as after a failure."""
    part, path, at = table(spark, sf, "part"), f"{Workspace(spark, 'variants').path}/bronze", lit("2024-01-01").cast("timestamp")
    first = variants.packed(part.filter("p_partkey % 2 = 0").select(c("p_partkey").alias("id"), c("p_retailprice").cast("double").alias("price"), c("p_name").alias("name")), ["id"])
    second = variants.packed(part.filter("p_partkey % 3 = 0").select(c("p_partkey").alias("id"), lit("sur demande").alias("price"), F.array("p_size", lit(1)).alias("tags")), ["id"])
    said = F.concat(lit('{"price": ['), c("p_partkey"), lit(', 900000], "name": "'), c("p_name"), lit('", "tags": '), F.when(c("p_size") % 2 == 0, F.concat(lit('{"n": '), c("p_size"), lit("}"))).otherwise("null"), lit("}"))
    third = variants.parsed(part.filter("p_partkey % 5 = 0").select(c("p_partkey").alias("id"), said.alias("line")), "line")
    for name, df in (("a", first), ("b", second), ("a", first), ("c", third)):
        variants.append_batch(df, path, name, at)
    return variants.read_batches(spark, path)


@query(f"WITH {VARIED} SELECT * FROM x")
def bronze_variants(spark, sf):
    """Types that differ between batches stay what they were, and no batch is written again for another's sake."""
    kind = lambda name: variants.kind_of(F.try_variant_get("raw", f"$.{name}", "variant"))
    tag = F.coalesce(F.try_variant_get("raw", "$.tags[0]", "int"), F.try_variant_get("raw", "$.tags.n", "int"))
    price = F.when(kind("price") == "NUMBER", variants.field("raw", "price", "double"))
    return varied(spark, sf).select("id", "batch", kind("price").alias("price_kind"), price.alias("price"), variants.field("raw", "price", "string").alias("said"), kind("tags").alias("tags_kind"), tag.alias("tag"), variants.field("raw", "name", "string").alias("name"))


@query(f"""WITH {VARIED}, k AS (SELECT 'price' AS key, price_kind AS kind FROM x UNION ALL SELECT 'tags', tags_kind FROM x WHERE tags_kind IS NOT NULL UNION ALL SELECT 'name', 'STRING' FROM x WHERE name IS NOT NULL)
SELECT key, kind, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM x), 2) AS percent FROM k GROUP BY 1, 2""")
def bronze_variant_coverage(spark, sf):
    """Keys of all batches by the kinds that their values are of."""
    return variants.variant_coverage(varied(spark, sf)).drop("type")


@query("SELECT key, CASE WHEN type IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN 'NUMBER' WHEN type = 'VARCHAR' THEN 'STRING' ELSE type END AS kind, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM events), 2) AS percent FROM (SELECT key, json_type(props, '$.\"' || key || '\"') AS type FROM (SELECT props, unnest(json_keys(props)) AS key FROM events)) GROUP BY 1, 2")
def event_variant_coverage(spark, sf):
    """Keys of all events' properties by kind."""
    return variants.variant_coverage(variants.parsed(table(spark, sf, "events").select("props"), "props")).drop("type")


# --- names by collation ----------------------------------------------------------------------------------------------

#: Names of places with marks, ligatures, signs and saints.
PLACES = ["Œuilly", "Saint-Étienne", "Évreux", "Nœux-les-Mines", "L'Haÿ-les-Roses", "Sainte-Mère-Église", "Bègles", "Plœmeur"]
SPELLED = ["Œuilly", "ST ETIENNE", "évreux", "NOEUX LES MINES", "l haÿ les roses", "Ste Mère Église", "BEGLES", "PLŒMEUR"]
PLACE = lambda key, names: F.element_at(F.array(*[lit(x) for x in names]), (c(key) % len(names) + 1).cast("int"))


def spelled_orders(spark, sf):
    """Orders in places, spelled in one of two ways, or without marks in capitals, or by combining marks; some without a place."""
    at = lambda names: PLACE("o_custkey", names)
    combining = F.replace(F.replace(at(PLACES), lit("\u00e9"), lit("e\u0301")), lit("\u00c9"), lit("E\u0301"))
    city = F.when(c("o_orderkey") % 4 == 0, at(PLACES)).when(c("o_orderkey") % 4 == 1, at(SPELLED)).when(c("o_orderkey") % 4 == 2, F.upper(at(PLACES))).otherwise(combining)
    return table(spark, sf, "orders").withColumn("city", F.when(c("o_orderkey") % 13 != 0, city))


@query(f"""WITH s AS (SELECT s_suppkey % {len(PLACES)} AS k, count(*) AS suppliers FROM supplier GROUP BY 1)
SELECT o_orderkey, CASE WHEN o_orderkey % 13 <> 0 THEN suppliers END AS suppliers FROM orders LEFT JOIN s ON k = o_custkey % {len(PLACES)}""")
def places_by_collation(spark, sf):
    """Orders with the number of suppliers at their place, whose names are spelled otherwise."""
    ws = Workspace(spark, "suppliers")
    there = places.count_by_place(table(spark, sf, "supplier").select(F.when(c("s_suppkey") % 3 == 0, PLACE("s_suppkey", PLACES)).otherwise(F.upper(PLACE("s_suppkey", SPELLED))).alias("city")), "city", [F.count(lit(1)).alias("suppliers")])
    return places.join_by_place(spelled_orders(spark, sf), ws.write(there, "suppliers"), ("city", "city")).select("o_orderkey", "suppliers")


@query(f"""WITH o AS (SELECT *, o_custkey % {len(PLACES)} AS k, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey % 5 END AS code FROM orders
), m AS (SELECT k, code FROM o WHERE code IS NOT NULL AND o_orderkey % 13 <> 0 GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, code) = 1)
SELECT o_orderkey, coalesce(o.code, CASE WHEN o_orderkey % 13 <> 0 THEN m.code END) AS code FROM o LEFT JOIN m USING (k)""")
def postcode_by_collation(spark, sf):
    """Codes imputed by the place's most frequent one, over all spellings."""
    df = spelled_orders(spark, sf).select("o_orderkey", "city", F.when(c("o_orderkey") % 3 > 0, c("o_custkey") % 5).alias("code"))
    return places.impute_by_place(df, df, "city", "code").select("o_orderkey", "code")


# --- files as a data source ------------------------------------------------------------------------------------------


def written_files(spark, df, kind, fields, ending, **options):
    """df written as files by its columns ``fields``, and read again as a data source."""
    path = f"{Workspace(spark, kind).path}/files"
    writer = df.repartition(*fields).write.partitionBy(*fields)
    writer.text(path) if kind == "inventory" else writer.options(header=True, **options).csv(path)
    advert_files.register(spark)
    layout = "/".join(f"{f}=(?P<{f}>[^/]+)" for f in fields) + rf"/part-[^/]*\.{ending}"
    return spark.read.format("advert_files").options(kind=kind, layout=layout).load(path)


@query("""SELECT o_orderkey::VARCHAR AS id_mutation, year(o_orderdate)::VARCHAR AS annee, (o_custkey % 10 + 60)::VARCHAR AS departement, CASE WHEN o_orderkey % 9 > 0 THEN o_totalprice::DECIMAL(20, 2) END::DOUBLE AS price, 'rue "du, lac"' || chr(10) || o_orderpriority AS adresse_nom_voie, NULL::VARCHAR AS type_local FROM orders""")
def sales_files(spark, sf):
    """Orders as packed sales files by year and department: quotes, commas and new lines in values, columns that are missing."""
    street = F.concat(lit('rue "du, lac"\n'), c("o_orderpriority"))
    price = F.when(c("o_orderkey") % 9 > 0, c("o_totalprice").cast("decimal(20,2)").cast("string"))
    df = table(spark, sf, "orders").select(street.alias("adresse_nom_voie"), price.alias("valeur_fonciere"), c("o_orderkey").alias("id_mutation"), F.year("o_orderdate").alias("annee"), (c("o_custkey") % 10 + 60).alias("departement"))
    out = written_files(spark, df, "sales", ["annee", "departement"], r"csv\.gz", compression="gzip", escape='"')
    return out.select("id_mutation", "annee", "departement", c("valeur_fonciere").cast("double").alias("price"), "adresse_nom_voie", "type_local")


@query("""SELECT p_partkey::VARCHAR AS code_commune, 'Évreux-lès-' || p_name AS commune, 't' || (p_partkey % 4) AS typologie, CASE WHEN p_partkey % 7 > 0 THEN p_size * 1.25::DOUBLE END AS loyer_m2, CASE WHEN p_partkey % 5 > 0 THEN p_size END AS n FROM part""")
def rent_files(spark, sf):
    """Parts as rent files: semicolons, letters of one byte, decimal commas, numbers that are none."""
    rent = F.when(c("p_partkey") % 7 > 0, F.replace((c("p_size") * 1.25).cast("string"), lit("."), lit(","))).otherwise("n.c.")
    df = table(spark, sf, "part").select(c("p_partkey").alias("INSEE_C"), F.concat(lit("Évreux-lès-"), c("p_name")).alias("LIBGEO"), rent.alias("loypredm2"), F.when(c("p_partkey") % 5 > 0, c("p_size").cast("string")).otherwise("x").alias("nbobs_com"), F.concat(lit("t"), c("p_partkey") % 4).alias("typologie"))
    return written_files(spark, df, "rents", ["typologie"], "csv", sep=";", encoding="ISO-8859-1").select("code_commune", "commune", "typologie", "loyer_m2", "n")


@query("""SELECT 's' || (page_id % 3) AS source, '2024-01-0' || (page_id % 2 + 1) AS jour, 'http://x/' || page_id AS url FROM pages""")
def inventory_files(spark, sf):
    """A line for each page, with blanks around, in files by source and day."""
    df = table(spark, sf, "pages").select(F.concat(lit(" http://x/"), c("page_id"), lit(" \n")).alias("value"), F.concat(lit("s"), c("page_id") % 3).alias("source"), F.concat(lit("2024-01-0"), c("page_id") % 2 + 1).alias("jour"))
    return written_files(spark, df, "inventory", ["source", "jour"], "txt").select("source", "jour", "url")
