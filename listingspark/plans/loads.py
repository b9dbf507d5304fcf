"""Queries of sources and loads: pages and payloads made of parts' numbers, which must come back as these numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text_fr
from ..operators import comparables, history, normalise, prices, scoring, search, tables
from ..sources import api
from ..sources import pages as page_source
from . import adverts
from .adverts import DEALS, columns, deals, dressed
from .catalogue import query, table

c, lit = F.col, F.lit
K, P = "o_orderkey", "p_partkey"


# --- bronze ----------------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey AS id, p_retailprice::VARCHAR AS price, p_name AS name, NULL::VARCHAR AS tags, 'old' AS _collected_at, NULL::DOUBLE AS dpe FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, 'sur demande', NULL, to_json([p_size, 1])::VARCHAR, 'new', NULL FROM part WHERE p_partkey % 3 = 0""")
def bronze_append(spark, sf):
    """A batch with an unseen column, without another, and with a text where numbers were; guaranteed columns are added."""
    part = table(spark, sf, "part")
    old = part.filter("p_partkey % 2 = 0").select(c("p_partkey").alias("id"), c("p_retailprice").alias("price"), c("p_name").alias("name"), lit("old").alias("_collected_at"))
    batch = part.filter("p_partkey % 3 = 0").select(c("p_partkey").alias("id"), lit("sur demande").alias("price"), F.array("p_size", lit(1)).alias("tags"))
    out = tables.append_bronze(old, batch, lit("new")).withColumn("tags", F.to_json("tags"))
    return tables.ensure_columns(out, T.StructType([T.StructField("dpe", T.DoubleType()), T.StructField("name", T.StringType())]))


@query("""SELECT page_id FROM pages WHERE page_id % 7 <> 3 AND page_id % 5 <> 1 AND NOT (page_id % 5 <> 1 AND page_id % 11 = 4)""")
def frontier_terminal(spark, sf):
    """Auctions in a final state are never read again, others once their reading is old; pages tried in vain wait."""
    pages, now = table(spark, sf, "pages"), lit("2024-02-01").cast("timestamp")
    pages = pages.withColumn("url", F.concat(lit("u"), c("page_id")))
    status = F.when(c("page_id") % 7 == 3, "adjugé").otherwise("à venir")
    known = pages.filter("page_id % 7 = 3 or page_id % 5 = 1").select("url", F.when(c("page_id") % 5 == 1, now - F.expr("interval 2 days")).otherwise(now - F.expr("interval 90 days")).alias("collected_at"), lit(2).alias("version"), status.alias("statut"))
    earlier = pages.select("url", (now - F.expr("interval 60 days")).alias("checked_at"))
    tried = tables.upsert(earlier, pages.filter("page_id % 11 = 4").select("url", now.alias("checked_at")), ["url"], {})
    done = c("statut").isin("adjugé", "carence", "retiré", "non communiqué")
    return history.crawl_frontier(pages, known, tried, now, revisit_days=7, version=2, terminal=done).select("page_id")


# --- payloads --------------------------------------------------------------------------------------------------------

PAYLOAD = f"""concat('{{"id": "a', cast({P} as string), '", "title": "', p_name, '", "price": ', case when {P} % 5 = 0 then concat('[', cast({P} as string), ', 900000]') else cast({P} * 10 as string) end, ', "surfaceArea": ', cast({P} % 90 as string),
  ', "postalCode": "59', lpad(cast({P} % 1000 as string), 3, '0'), '", "blurInfo": {{"type": "', case when {P} % 3 = 0 then 'exact' else 'street' end, '", "radius": ', cast({P} % 400 as string), ', "position": {{"lat": 50.5, "lon": 3}}}}, "propertyType": "flat", "adTypeFR": "VENTE", "energyClassification": "', substr('ABCDEFG', cast({P} % 7 + 1 as int), 1),
  '", "photos": [{{"url": "1.jpg"}}, {{"url": "2.jpg"}}], "annualCondominiumFees": "', cast({P} % 50 as string), '", "rent": ', cast({P} % 800 as string), ', "publicationDate": "', case when {P} % 4 = 0 then '1970-01-01' else '2024-05-06' end, 'T10:00:00"}}')"""


@query("""WITH p AS (SELECT p_partkey AS k, p_name FROM part)
SELECT 'a' || k AS id, p_name AS name, CASE WHEN k % 5 > 0 THEN k * 10 END::DOUBLE AS price, (k % 90)::DOUBLE AS surface, printf('59%03d', (k % 1000)::INTEGER) AS zipcode, 'flat/vente' AS type_hint, substr('ABCDEFG', (k % 7 + 1)::INTEGER, 1) AS dpe, 2::BIGINT AS image_count, k % 4 > 0 AS dated,
  CASE WHEN k % 5 = 0 THEN k || ' – 900000' END AS span, k % 3 > 0 AND k % 400 > 150 AS blurred, (k % 800 * 12)::DOUBLE AS rent, k % 50 AS fees FROM p""")
def api_search(spark, sf):
    df = dressed(table(spark, sf, "part"), {"payload": PAYLOAD})
    at = lambda k: F.get_json_object("details_json", f"$['{k}']")
    return api.search_adverts(df).select(
        "id", "name", "price", "surface", "zipcode", "type_hint", "dpe", "image_count", c("published_at").isNotNull().alias("dated"), at("Fourchette de prix").alias("span"), at("Précision cartographique").isNotNull().alias("blurred"), at("Loyer annuel").cast("double").alias("rent"), at("Charges annuelles de copropriété").cast("long").alias("fees"),
    )


NOTARY = f"""concat('{{"annonceId": ', cast({P} as string), ', "prixTotal": ', case when {P} % 3 = 0 then 'null' else cast({P} * 7 as string) end, ', "prixAffiche": ', cast({P} * 5 as string), ', "surface": "', cast({P} % 120 as string), '", "nbPieces": ', cast({P} % 6 as string), ', "typeBien": "MAI", "communeNom": "Lille", "typeTransaction": "',
  case {P} % 4 when 0 then 'VAE' when 1 then 'VAE' when 2 then 'VNI' else 'VENTE' end, '", "typeAdjudication": "', case when {P} % 4 = 0 then 'JUDICIAIRE' else 'VOLONTAIRE' end, '"}}')"""


@query("""SELECT p_partkey::VARCHAR AS id, CASE WHEN p_partkey % 3 = 0 THEN p_partkey * 5 ELSE p_partkey * 7 END::DOUBLE AS price, (p_partkey % 120)::DOUBLE AS surface, (p_partkey % 6)::VARCHAR AS rooms, 'Lille' AS city,
  CASE p_partkey % 4 WHEN 0 THEN 'enchere_judiciaire' WHEN 1 THEN 'enchere_notariale' WHEN 2 THEN 'vente_interactive' ELSE 'gre_a_gre' END AS mode_vente FROM part""")
def api_notary(spark, sf):
    return api.notary_adverts(dressed(table(spark, sf, "part"), {"payload": NOTARY})).select("id", "price", "surface", "rooms", "city", "mode_vente")


@query("SELECT p_partkey AS id, p_size::DOUBLE AS surface, '3' AS rooms, CASE WHEN p_partkey % 2 = 0 THEN p_size * 10 END::DOUBLE AS land_surface, CASE WHEN p_partkey % 3 = 0 THEN 'C' END AS dpe FROM part")
def api_attributes(spark, sf):
    pair = lambda k, v: F.struct(lit(k).alias("key"), v.cast("string").alias("value"))
    said = F.array(pair("square", c("p_size")), pair("rooms", lit(3)), pair("other", lit("x")), pair("energy_rate", F.when(c("p_partkey") % 3 == 0, "c").otherwise("V")))
    said = F.when(c("p_partkey") % 2 == 0, F.array_append(said, pair("land_plot_surface", c("p_size") * 10))).otherwise(said)
    return api.attribute_adverts(table(spark, sf, "part").select(c("p_partkey").alias("id"), said.alias("attributes"))).select("id", "surface", "rooms", "land_surface", "dpe")


# --- pages -----------------------------------------------------------------------------------------------------------

LINKED = f"""concat('<p>x</p><script type="application/ld+json">', case {P} % 3 when 0 then '{{"@graph": [{{"@type": "Person"}}, ' when 1 then '[' else '' end, '{{"@type": "House", "name": "Maison ', cast({P} as string), '", "offers": {{"price": "', cast({P} * 1000 as string), '"}}, "address": {{"postalCode": "59000", "addressLocality": "Lille"}}, "floorSize": {{"value": ', cast({P} % 200 as string), '}}}}',
  case {P} % 3 when 0 then ']}}' when 1 then ']' else '' end, '</script><script type="application/ld+json">', case when {P} % 4 = 0 then '{{"@type": "Offer", "name": "B"}}' else '{{broken' end, '</script>')"""


@query("""SELECT p_partkey::VARCHAR AS url, 'Maison ' || p_partkey AS name, (p_partkey * 1000)::DOUBLE AS price, (p_partkey % 200)::DOUBLE AS surface, '59000' AS zipcode FROM part UNION ALL SELECT p_partkey::VARCHAR, 'B', NULL, NULL, NULL FROM part WHERE p_partkey % 4 = 0""")
def linked_data(spark, sf):
    """Linked data in graphs, lists and alone, and blocks that are broken."""
    return page_source.extract_jsonld(dressed(table(spark, sf, "part"), {"url": f"cast({P} as string)", "html": LINKED})).select("url", "name", "price", "surface", "zipcode")


STATED = f"""concat('<div data-estate="{{&quot;n&quot;: ', cast({P} as string), '}}"></div><script id="app-state">{{&q;n&q;: ', cast({P} as string), '}}</script><script>layer.push({{"n": ', cast({P} as string), '}});</script><script id="DATA">[{{"n": 1}}, ', cast({P} as string), ']</script><script id="plain">{{"n": ', cast({P} as string), '}}</script>',
  '<script>flow.push([1,"{{\\\\"n\\\\": "])</script><script>flow.push([1,"', cast({P} as string), '}}"])</script>')"""


@query("SELECT p_partkey::VARCHAR AS url, kind, p_partkey AS n FROM part, (VALUES ('script'), ('transfer'), ('indexed'), ('attribute'), ('layer'), ('chunks')) AS k(kind)")
def page_states(spark, sf):
    """The six kinds of state in a page, each with the part's number."""
    pages = dressed(table(spark, sf, "part"), {"url": f"cast({P} as string)", "html": STATED})
    names = {"script": "plain", "transfer": "app-state", "indexed": "DATA", "attribute": "data-estate", "layer": "layer", "chunks": "flow"}
    number = lambda kind: F.get_json_object(F.get_json_object("state", "$.text") if kind == "chunks" else c("state"), "$.n").cast("long")
    return reduce(lambda a, b: a.unionByName(b), [page_source.extract_state(pages, n, k).select("url", lit(k).alias("kind"), number(k).alias("n")) for k, n in names.items()])


NOTICES = f"""concat('<h1>Vente aux enchères</h1><p>Tribunal judiciaire de Lille</p><p>Jeudi ', cast({P} % 28 + 1 as string), ' octobre 2026 à 14h30</p>', case when {P} % 2 = 0 then concat('<p>Lot 1 : un appartement de ', cast({P} % 80 + 20 as string), ' m², mise à prix ', cast({P} % 90 + 10 as string), ' 000 €</p><p>Lot 2 : une maison occupée, mise à prix ', cast({P} % 90 + 50 as string), ' 000 €, adjugée ', cast({P} % 90 + 60 as string), ' 000 €</p>')
  else concat('<p>Un terrain libre, mise à prix ', cast({P} % 90 + 10 as string), ' 000 €. Vente retirée</p>') end)"""


@query("""WITH p AS (SELECT p_partkey AS k FROM part) SELECT k || '-1' AS id, ((k % 90 + 10) * 1000)::DOUBLE AS price, NULL::DOUBLE AS prix_adjuge, 'à venir' AS statut, (k % 80 + 20)::DOUBLE AS surface, 'appartement' AS type_hint, NULL AS occupation, printf('2026-10-%02d 14:30', (k % 28 + 1)::INTEGER) AS day FROM p WHERE k % 2 = 0
UNION ALL SELECT k || '-2', ((k % 90 + 50) * 1000)::DOUBLE, ((k % 90 + 60) * 1000)::DOUBLE, 'adjugé', NULL, 'maison', 'occupé', printf('2026-10-%02d 14:30', (k % 28 + 1)::INTEGER) FROM p WHERE k % 2 = 0
UNION ALL SELECT k::VARCHAR, ((k % 90 + 10) * 1000)::DOUBLE, NULL, 'retiré', NULL, 'terrain', 'libre', printf('2026-10-%02d 14:30', (k % 28 + 1)::INTEGER) FROM p WHERE k % 2 = 1""")
def auction_lots(spark, sf):
    """Notices of one lot and of two. Parts' numbers are dealt out before they become pages: a file of them may be one partition."""
    parts = table(spark, sf, "part").select(P).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = api.sale_lots(dressed(parts, {"url": f"cast({P} as string)", "html": NOTICES}))
    return out.select("id", "price", "prix_adjuge", "statut", "surface", "type_hint", "occupation", F.date_format("date_vente", "yyyy-MM-dd HH:mm").alias("day"))


FIGURES = f"""concat('<h2>Éléments chiffrés</h2><table><tr><td></td><td><b>2021</b></td><td><b>2022</b></td></tr><tr><td>CA</td><td>', cast({P} * 10 as string), '</td><td>', case when {P} % 3 = 0 then '' else concat(cast({P} as string), ' 000 €') end, '</td></tr><tr><td>EBE</td><td>5</td><td>', cast({P} % 5 - 2 as string), '</td></tr></table>')"""


@query("""SELECT p_partkey::VARCHAR AS url, 'Chiffre d''affaires' AS key, CASE WHEN p_partkey % 3 = 0 THEN p_partkey * 10 ELSE p_partkey * 1000 END::DOUBLE AS value, CASE WHEN p_partkey % 3 = 0 THEN 2021 ELSE 2022 END AS year FROM part
UNION ALL SELECT p_partkey::VARCHAR, CASE WHEN p_partkey % 5 < 3 THEN 'EBE négatif' ELSE 'EBE' END, (p_partkey % 5 - 2)::DOUBLE, 2022 FROM part""")
def labelled_figures(spark, sf):
    return page_source.financial_table(dressed(table(spark, sf, "part"), {"url": f"cast({P} as string)", "html": FIGURES}))


@query("""WITH p AS (SELECT p_partkey AS k, p_retailprice * CASE p_partkey % 3 WHEN 0 THEN 10000000 WHEN 1 THEN 200000 ELSE 1 END AS ca, p_partkey % 12 AS staff FROM part)
SELECT k, CASE WHEN ca >= 1e9 OR (staff <= 5 AND ca > 1e8) THEN ca / 1000 ELSE ca END AS ca, CASE WHEN ca >= 1e9 OR (staff <= 5 AND ca > 1e8) THEN ca / 2 / 1000 ELSE ca / 2 END AS ebe FROM p""")
def scale_repair(spark, sf):
    ca = c("p_retailprice") * F.when(c("p_partkey") % 3 == 0, 10000000).when(c("p_partkey") % 3 == 1, 200000).otherwise(1)
    df = table(spark, sf, "part").select(c("p_partkey").alias("k"), ca.alias("ca"), (ca / 2).alias("ebe"), (c("p_partkey") % 12).alias("staff"))
    return page_source.fix_scale(df, "ca", "ebe", "staff").drop("staff")


# --- normalising -----------------------------------------------------------------------------------------------------

HINTS = {
    "canonical": ("case p_size % 3 when 0 then 'maison' when 1 then 'terrain' else 'villa' end", "CASE p_size % 3 WHEN 0 THEN 'maison' WHEN 1 THEN 'terrain' ELSE 'autre' END"),
    "auction": ("case p_size % 2 when 0 then 'vente immeuble' else 'location bureau' end", "CASE p_size % 2 WHEN 0 THEN 'immeuble' ELSE 'bureau' END"),
    "interactive_auction": ("'vente maison'", "'maison'"),
    "public_sale": ("'vente autre'", "'autre'"),
    "notary": ("case p_size % 4 when 0 then 'APP' when 1 then 'TER' when 2 then 'BUR' else 'XXX' end", "CASE p_size % 4 WHEN 0 THEN 'appartement' WHEN 1 THEN 'terrain' WHEN 2 THEN 'bureau' ELSE 'autre' END"),
    "search_api": ("case p_size % 3 when 0 then 'flat/vente' when 1 then 'shop/location' else 'premises/fonds' end", "CASE p_size % 3 WHEN 0 THEN 'appartement' WHEN 1 THEN 'local_commercial' ELSE 'fonds_commerce' END"),
    "attributes": ("cast(p_size % 6 as string)", "CASE p_size % 6 WHEN 1 THEN 'maison' WHEN 2 THEN 'appartement' WHEN 3 THEN 'terrain' WHEN 4 THEN 'local_commercial' WHEN 5 THEN 'local_commercial' ELSE 'autre' END"),
    "labels": ("case p_size % 3 when 0 then 'Villa' when 1 then 'Studio' else 'commerce' end", "CASE p_size % 3 WHEN 0 THEN 'maison' WHEN 1 THEN 'appartement' ELSE 'local_commercial' END"),
    "keywords": ("case p_size % 3 when 0 then 'Boutique' when 1 then 'Bureaux à louer' else 'Cession de fonds' end", "CASE p_size % 3 WHEN 0 THEN 'local_commercial' WHEN 1 THEN 'bureau' ELSE 'fonds_commerce' END"),
}
MODES = {"auction": "enchere_judiciaire", "interactive_auction": "vente_interactive", "public_sale": "cession_publique"}
RENTAL = {"auction": "p_size % 2 = 1", "search_api": "p_size % 3 = 1"}
PLOT = {"canonical": "p_size % 3 = 1", "notary": "p_size % 4 = 1", "attributes": "p_size % 6 = 3", "labels": "p_size * 20 > 500 AND (p_partkey % 4 = 0 OR p_partkey % 5 = 0)"}


@query(" UNION ALL ".join(f"""SELECT '{n}' AS source, p_partkey::VARCHAR AS external_id, CASE WHEN {RENTAL.get(n, 'false')} THEN 'location' ELSE 'vente' END AS categorie, {kind} AS type_bien, CASE WHEN NOT {RENTAL.get(n, 'false')} THEN p_retailprice END AS prix, CASE WHEN {RENTAL.get(n, 'false')} THEN p_retailprice END AS loyer,
  CASE WHEN NOT ({PLOT.get(n, 'false')}) THEN p_size * 20 END::DOUBLE AS surface_bati, CASE WHEN {PLOT.get(n, 'false')} THEN CASE WHEN p_partkey % 4 = 0 THEN p_size * 20 WHEN p_partkey % 4 = 1 THEN 77 ELSE p_size * 20 END WHEN p_partkey % 4 = 0 THEN p_size * 20 WHEN p_partkey % 4 = 1 THEN 77 END::DOUBLE AS surface_terrain,
  {f"coalesce(CASE WHEN p_partkey % 2 = 0 THEN 'gre_a_gre' END, '{MODES[n]}')" if n in MODES else "CASE WHEN p_partkey % 2 = 0 THEN 'gre_a_gre' END"} AS mode_vente, {"p_partkey % 3 > 0" if n in MODES else "true"} AS active FROM part""" for n, (_, kind) in HINTS.items()))
def normalise_profiles(spark, sf):
    """Nine profiles over the same parts: types, rentals, plots, sale modes, past auctions."""
    part = table(spark, sf, "part")

    def one(name: str, hint: str):
        b = part.select(
            c("p_partkey").alias("id"), F.expr(hint).alias("type_hint"), c("p_retailprice").alias("price"), (c("p_size") * 20).alias("surface"), F.when(c("p_partkey") % 4 == 0, c("p_size") * 20).when(c("p_partkey") % 4 == 1, 77).alias("land_surface"), F.when(c("p_partkey") % 5 > 0, 3).alias("rooms"),
            F.when(c("p_partkey") % 2 == 0, "gre_a_gre").alias("mode_vente"), F.when(c("p_partkey") % 3 == 0, "2024-01-01").when(c("p_partkey") % 3 == 1, "2024-03-01").alias("date_vente"), lit("2024-02-01").alias("_collected_at"), lit("u").alias("url"), lit("n").alias("name"), lit("").alias("body"),
        )
        return normalise.normalise(b, name, normalise.PROFILES[name], lit("2024-02-15").cast("timestamp"))

    out = reduce(lambda a, b: a.unionByName(b), [one(n, h) for n, (h, _) in HINTS.items()])
    return out.select("source", "external_id", "categorie", "type_bien", "prix", "loyer", "surface_bati", "surface_terrain", "mode_vente", "active")


TOWNS = {"id": K, "ville": "case o_custkey % 4 when 0 then 'ÉVRY ' when 1 then 'Évry' when 2 then 'Lyon' else 'Nulle part' end", "code_postal": f"case when {K} % 3 = 0 then '13001' end", "dept": f"case {K} % 5 when 0 then '69' when 1 then '91' end"}
SOLD = {"commune": "case c_custkey % 3 when 0 then 'EVRY' when 1 then 'évry' else 'LYON' end", "code_postal": "case when c_custkey % 13 > 0 then concat(case c_custkey % 4 when 0 then '910' when 1 then '690' else '910' end, '0', cast(c_custkey % 7 as string)) end"}


@query(f"""WITH a AS (SELECT {columns(TOWNS)} FROM orders), s AS (SELECT {columns(SOLD)} FROM customer
), n AS (SELECT lower(strip_accents(trim(commune))) AS town, left(code_postal, 2) AS d, code_postal AS code, count(*) AS n FROM s WHERE code_postal IS NOT NULL GROUP BY 1, 2, 3
), m AS (SELECT town, d, code FROM (SELECT *, row_number() OVER (PARTITION BY town, d ORDER BY n DESC, code) AS k FROM n) WHERE k = 1
), f AS (SELECT town, arg_min(code, d) AS code FROM m GROUP BY town)
SELECT id, coalesce(a.code_postal, CASE WHEN dept IS NOT NULL THEN m.code ELSE f.code END) AS code_postal FROM a LEFT JOIN m ON m.town = lower(strip_accents(trim(ville))) AND m.d = dept LEFT JOIN f ON f.town = lower(strip_accents(trim(ville)))""")
def postcode_imputation(spark, sf):
    return normalise.impute_postcode(dressed(table(spark, sf, "orders"), TOWNS), dressed(table(spark, sf, "customer"), SOLD), c("dept")).select("id", "code_postal")


@query("SELECT o_orderkey FROM orders WHERE NOT (o_custkey % 3 = 1 AND o_orderkey % 10 = 4)")
def legacy_purge(spark, sf):
    df = table(spark, sf, "orders").select(K, F.concat(lit("s"), c("o_custkey") % 3).alias("source"), F.when(c(K) % 7 > 0, F.concat(lit("/x/"), c(K))).when(c(K) % 10 == 4, "/x/4").alias("url"))
    return normalise.drop_urls(df, "s1", r"4$").select(K)


@query("""WITH d AS (SELECT o_orderkey AS k, o_custkey % 50 AS t, o_orderkey % 4 AS s, date_trunc('day', o_orderdate) AS day, round(o_totalprice / 50000) AS r FROM orders WHERE o_orderkey % 3 > 0)
SELECT 'tribunal-de-saint-omer|' || strftime(day, '%Y-%m-%d') || '|ville-' || t || '|' || r::BIGINT AS key, count(DISTINCT (s, k))::INTEGER AS n FROM d GROUP BY 1 HAVING count(DISTINCT (s, k)) > 1""")
def auction_pairs(spark, sf):
    """Auctions that several listings tell of: equal court, day, town and reserve."""
    df = table(spark, sf, "orders").select(
        (c(K) % 4).cast("string").alias("source"), c(K).cast("string").alias("external_id"), F.when(c(K) % 3 > 0, "enchere_judiciaire").alias("mode_vente"), c("o_orderdate").alias("day"), F.concat(F.when(c(K) % 2 == 0, "VILLE ").otherwise("Ville-"), c("o_custkey") % 50).alias("ville"), (F.round(c("o_totalprice") / 50000)).alias("reserve")
    )
    court = F.when(c("external_id").cast("long") % 2 == 0, "Tribunal de St-Omer").otherwise("tribunal de saint Omer")
    out = normalise.auction_matches(df, text_fr.auction_key(court, c("day"), c("ville"), c("reserve")))
    return out.select("key", F.size("listings").alias("n"))


# --- references, detail, alerts --------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT c_custkey % 40 AS commune, CASE WHEN c_custkey % 9 > 0 THEN '5900' || c_custkey % 3 END AS code FROM customer), n AS (SELECT commune, code, count(*) AS n FROM s WHERE code IS NOT NULL GROUP BY 1, 2
), m AS (SELECT commune, code FROM (SELECT *, row_number() OVER (PARTITION BY commune ORDER BY n DESC, code) AS k FROM n) WHERE k = 1)
SELECT p_partkey AS id, p_partkey % 60 AS code_commune, p_size - 10.0::DOUBLE AS loyer_m2, code AS code_postal FROM part LEFT JOIN m ON commune = p_partkey % 60 WHERE p_size > 10""")
def rent_reference_codes(spark, sf):
    sales = table(spark, sf, "customer").select((c("c_custkey") % 40).alias("code_commune"), F.when(c("c_custkey") % 9 > 0, F.concat(lit("5900"), c("c_custkey") % 3)).alias("code_postal"))
    rents = table(spark, sf, "part").select(c("p_partkey").alias("id"), (c("p_partkey") % 60).alias("code_commune"), (c("p_size") - 10.0).alias("loyer_m2"))
    return prices.rent_reference(rents, sales).select("id", "code_commune", "loyer_m2", "code_postal")


@query("""SELECT 'fresh' AS name, max(o_orderdate) < TIMESTAMP '2001-08-20' - INTERVAL 30 DAY AS stale FROM orders UNION ALL SELECT 'old', max(o_orderdate) < TIMESTAMP '2002-08-20' - INTERVAL 30 DAY FROM orders UNION ALL SELECT 'none', true""")
def reference_staleness(spark, sf):
    built = table(spark, sf, "orders").select(c("o_orderdate").alias("built"))
    at = {"fresh": ("2001-08-20", built), "old": ("2002-08-20", built), "none": ("2001-08-20", built.filter("false"))}
    return reduce(lambda a, b: a.unionByName(b), [prices.is_stale(d, "built", 30, lit(t).cast("timestamp")).select(lit(n).alias("name"), "stale") for n, (t, d) in at.items()])


@query(f"WITH {DEALS} SELECT source, external_id FROM deal WHERE score_global >= 60 AND first_seen_at > TIMESTAMP '2000-06-01'")
def deal_alerts(spark, sf):
    return search.new_deals(deals(spark, sf), lit("2000-06-01").cast("timestamp"), 60).select("source", "external_id")


@query(f"WITH {DEALS} SELECT external_id FROM deal ORDER BY score_global DESC NULLS LAST, CASE confiance WHEN 'fiable' THEN 0 WHEN 'indicative' THEN 1 ELSE 2 END, last_seen_at DESC NULLS LAST, source, external_id LIMIT 25")
def deal_top(spark, sf):
    return search.top_deals(deals(spark, sf), 25).select("external_id")


@query(f"WITH {DEALS} SELECT source, count(*) AS n, count(*) FILTER (WHERE active) AS active, max(last_seen_at) AS last_seen FROM deal GROUP BY source")
def source_stats(spark, sf):
    return search.pipeline_stats(deals(spark, sf))


@query(f"WITH {DEALS}, f AS (SELECT source, min(first_seen_at) AS f FROM deal GROUP BY source) " + " UNION ALL ".join(f"""SELECT '{n}' AS search, source, external_id FROM deal JOIN f USING (source) WHERE {w} AND ((first_seen_at >= TIMESTAMP '2001-05-01' AND first_seen_at > f + INTERVAL 1 DAY) OR derniere_baisse >= TIMESTAMP '2001-05-01')""" for n, (_, w) in adverts.SEARCHES.items()))
def deal_pending_alerts(spark, sf):
    """Alerts of saved query strings, read from the table that saves them."""
    saved = spark.createDataFrame([(n, q) for n, (q, _) in adverts.SEARCHES.items() if n != "none"], "id string, filtres string")
    saved = search.save_search(saved, spark.createDataFrame([("none", "city=nowhere")], "id string, filtres string"))
    state = saved.select(c("id").alias("search"), lit("2001-05-01").cast("timestamp").alias("since"))
    alerts, _ = search.pending_alerts(deals(spark, sf), search.saved_filters(saved), state, lit("2001-06-01").cast("timestamp"), source="source", first_seen="first_seen_at", last_drop="derniere_baisse")
    return alerts.select("search", "source", "external_id")


@query(f"WITH {DEALS}, own AS (SELECT * FROM deal WHERE external_id = '100') SELECT d.external_id FROM deal d JOIN own ON d.type_bien = own.type_bien AND d.code_postal = own.code_postal AND round(d.surface_bati) = round(own.surface_bati) AND d.external_id <> '100'")
def deal_copies(spark, sf):
    """Copies of one advert, as its page lists them."""
    df = deals(spark, sf)
    none = df.limit(0).withColumns({"rank": lit(1), "observed_at": lit(None).cast("timestamp")})
    own = df.filter("external_id = '100'").select("source").first()
    return search.deal_detail(df, none, none, own["source"] if own else "", "100")["copies"].select("external_id")


# --- comparables of homes --------------------------------------------------------------------------------------------

HOME = {
    "source": "'orders'", "external_id": f"cast({K} as string)", "type_bien": f"case {K} % 3 when 0 then 'appartement' when 1 then 'maison' else 'local_commercial' end", "surface_bati": f"cast(30 + {K} % 90 as double)", "nb_pieces": f"case when {K} % 4 > 0 then cast({K} % 5 + 1 as int) end", "surface_terrain": f"case when {K} % 5 > 1 then cast(200 + {K} % 300 as double) end",
    "code_postal": "concat('59', lpad(cast(o_custkey % 400 as string), 3, '0'))", "ville": "concat('Évry ', cast(o_custkey % 400 as string))", "lat": f"case when {K} % 6 > 0 then 48 + o_custkey % 400 * cast(0.01 as double) end", "lng": f"3 + {K} % 50 * cast(0.01 as double)", "details_json": f"case when {K} % 7 = 0 then '{{\"x\": \"Approximative\"}}' end",
}
SALE = {
    "id_mutation": "cast(c_custkey as string)", "date_mutation": "date '2000-01-01' - cast(c_custkey % 1900 as int)", "code_postal": "concat('59', lpad(cast(c_custkey % 400 as string), 3, '0'))", "commune": "concat('EVRY ', cast((c_custkey + c_custkey % 2) % 400 as string))", "type_local": "case c_custkey % 3 when 0 then 'Appartement' when 1 then 'Maison' else 'Local industriel. commercial ou assimilé' end",
    "surface_bati": "cast(28 + c_custkey * 7 % 95 as double)", "prix_m2": "cast(1000 + c_custkey % 900 as double)", "nombre_pieces": "case when c_custkey % 7 > 0 then cast(c_custkey % 6 as int) end", "surface_terrain": "case when c_custkey % 4 > 0 then cast(150 + c_custkey % 400 as double) end",
    "latitude": "case when c_custkey % 5 > 0 then 48 + c_custkey % 400 * cast(0.0101 as double) end", "longitude": "3 + c_custkey % 60 * cast(0.01 as double)",
}


def nearest_sql(bands: dict[str, tuple[float, float, float]], land: dict[str, tuple[float, float]], rooms: int, years: int, k: int, scale: float, unknown: float, year: float, approximate: bool) -> str:
    of = lambda i: "CASE a.type_bien " + " ".join(f"WHEN '{t}' THEN {b[i]}::DOUBLE" for t, b in bands.items()) + " END"
    plots = " AND ".join(f"(a.type_bien <> '{t}' OR coalesce(s.surface_terrain BETWEEN a.surface_terrain * {lo}::DOUBLE AND a.surface_terrain * {hi}::DOUBLE, true))" for t, (lo, hi) in land.items()) or "true"
    place = "CASE WHEN NOT coalesce(a.details_json ILIKE '%approximative%', false) AND a.lng IS NOT NULL THEN a.lat END" if approximate else "CASE WHEN a.lng IS NOT NULL THEN a.lat END"
    return f"""WITH a AS (SELECT * FROM (SELECT {columns(HOME)} FROM orders WHERE {K} % 50 = 0)), s AS (SELECT {columns(SALE)} FROM customer
), p AS (SELECT a.*, s.id_mutation, s.surface_bati AS s_size, s.nombre_pieces, s.surface_terrain AS s_land, s.date_mutation, lower(strip_accents(s.commune)) = lower(strip_accents(a.ville)) AS town, s.code_postal = a.code_postal AS code,
    111.2::DOUBLE * sqrt(pow(s.latitude - ({place}), 2) + pow((s.longitude - a.lng) * cos(radians({place})), 2)) AS km, s.prix_m2 FROM a JOIN s ON s.type_local = CASE a.type_bien WHEN 'appartement' THEN 'Appartement' WHEN 'maison' THEN 'Maison' ELSE 'Local industriel. commercial ou assimilé' END
    AND s.surface_bati BETWEEN a.surface_bati * {of(0)} AND a.surface_bati * {of(1)} AND s.date_mutation >= DATE '2000-01-01' - INTERVAL {12 * years} MONTH AND coalesce(abs(s.nombre_pieces - a.nb_pieces) <= {rooms}, true) AND {plots}
    AND (s.code_postal = a.code_postal OR coalesce(111.2::DOUBLE * sqrt(pow(s.latitude - ({place}), 2) + pow((s.longitude - a.lng) * cos(radians({place})), 2)) <= {of(2)}, false))
), d AS (SELECT external_id, id_mutation, prix_m2, abs(ln(s_size / surface_bati)) * 4 + CASE WHEN town THEN 0 WHEN code THEN 0.35::DOUBLE ELSE 1 END + CASE WHEN nombre_pieces IS NOT NULL AND nb_pieces IS NOT NULL THEN least(abs(nombre_pieces - nb_pieces), 4) * 0.12::DOUBLE ELSE 0.12::DOUBLE END
    + CASE WHEN s_land IS NOT NULL AND surface_terrain IS NOT NULL THEN least(abs(ln((s_land + 1) / (surface_terrain + 1))), 2) * 0.20::DOUBLE ELSE 0.30::DOUBLE END + CASE WHEN km IS NOT NULL THEN least(2, km / {scale}::DOUBLE) * 0.35::DOUBLE ELSE {unknown}::DOUBLE END + date_diff('day', date_mutation::DATE, DATE '2000-01-01') / 365.25::DOUBLE * {year}::DOUBLE AS distance FROM p)
SELECT external_id, id_mutation, rank, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY external_id ORDER BY distance, id_mutation, prix_m2) AS rank FROM d) WHERE rank <= {k}"""


def homes_and_sales(spark, sf):
    return dressed(table(spark, sf, "orders").filter(f"{K} % 50 = 0"), HOME), dressed(table(spark, sf, "customer"), SALE)


@query(nearest_sql({"appartement": (0.85, 1.15, 5.0), "maison": (0.80, 1.20, 12.0), "local_commercial": (0.70, 1.30, 15.0)}, {"maison": (0.65, 1.55)}, 1, 4, 15, 5.0, 0.15, 0.08, True))
def home_comparables(spark, sf):
    """The nearest sales of homes and shops (the search's queries are the orders divisible by 50, against all sales)."""
    homes, sales = homes_and_sales(spark, sf)
    out = comparables.listing_comparables(homes, sales, lit("2000-01-01").cast("date"))
    return out.select("external_id", c("v_id_mutation").alias("id_mutation"), "rank", F.round("distance", 6).alias("distance"))


@query(nearest_sql({"appartement": (0.80, 1.20, 20.0), "maison": (0.75, 1.25, 20.0), "local_commercial": (0.65, 1.35, 20.0)}, {t: (0.55, 1.80) for t in ("appartement", "maison", "local_commercial")}, 2, 5, 12, 10.0, 0.10, 0.06, False))
def home_detail_comparables(spark, sf):
    homes, sales = homes_and_sales(spark, sf)
    out = comparables.detail_comparables(homes, sales, lit("2000-01-01").cast("date"))
    return out.select("external_id", c("v_id_mutation").alias("id_mutation"), "rank", F.round("distance", 6).alias("distance"))


# --- joins before scoring --------------------------------------------------------------------------------------------


@query(f"""WITH a AS (SELECT {K} AS k, CASE {K} % 4 WHEN 0 THEN 'location' ELSE 'vente' END AS categorie, CASE {K} % 3 WHEN 0 THEN 'appartement' WHEN 1 THEN 'bureau' ELSE 'maison' END AS type_bien, CASE {K} % 5 WHEN 0 THEN 'Bar' WHEN 1 THEN 'Tabac' END AS secteur FROM orders)
SELECT k::VARCHAR AS external_id, CASE WHEN k % 2 = 0 THEN 'murs' END AS segment, CASE WHEN k % 3 = 0 THEN k % 20 END AS nb_ventes, CASE WHEN k % 5 = 0 THEN k % 9 END::DOUBLE AS loyer_m2_mois, CASE WHEN k % 7 = 0 THEN k % 4 END AS n_drops, CASE WHEN secteur = 'Bar' THEN 3.5 ELSE 2.2 END::DOUBLE AS multiple_ebe_reference, CASE WHEN secteur = 'Bar' THEN 0.9 ELSE 0.5 END::DOUBLE AS multiple_ca_reference,
  CASE type_bien WHEN 'appartement' THEN 2.5 WHEN 'maison' THEN 1.46 ELSE 1.65 END::DOUBLE AS ratio_adjudication FROM a WHERE categorie = 'vente' OR type_bien = 'bureau'""")
def scoring_inputs(spark, sf):
    """Listings with finance, comparables, rents and signals, their sector's multiples (of 30 sales or more) and their type's
    auction ratio, or what stands in for these."""
    o = table(spark, sf, "orders").select(lit("s").alias("source"), c(K).cast("string").alias("external_id"), c(K).alias("k"))
    listings = o.withColumns({
        "categorie": F.when(c("k") % 4 == 0, "location").otherwise("vente"), "type_bien": F.when(c("k") % 3 == 0, "appartement").when(c("k") % 3 == 1, "bureau").otherwise("maison"),
        "details_json": F.when(c("k") % 5 == 0, '{"Secteur": "Bar"}').when(c("k") % 5 == 1, '{"Secteur": "Tabac"}'),
    })
    part = lambda n, name, value: o.filter(f"k % {n} = 0").select("source", "external_id", value.alias(name))
    multiples = spark.createDataFrame([("Bar", 3.5, 0.9, 30, False), ("Tabac", 9.0, 9.0, 29, False), ("*", 2.2, 0.5, 80, False), (None, 2.9, 0.8, 139, True)], "sector string, multiple_ebe double, multiple_ca double, n long, total boolean")
    ratios = spark.createDataFrame([("appartement", 2.5, 20)], "type_bien string, ratio double, n long")
    out = scoring.deal_inputs(listings, part(2, "segment", lit("murs")), part(3, "nb_ventes", c("k") % 20), part(5, "loyer_m2_mois", (c("k") % 9).cast("double")), part(7, "n_drops", c("k") % 4), multiples, ratios)
    return out.select("external_id", "segment", "nb_ventes", "loyer_m2_mois", "n_drops", "multiple_ebe_reference", "multiple_ca_reference", "ratio_adjudication")
