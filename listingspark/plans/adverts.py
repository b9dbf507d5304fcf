"""Queries of the property operators on rows dressed as adverts.

Orders, customers, suppliers and parts give the numbers; the dresses below say how an advert's columns come from them, in
SQL that Spark and DuckDB read alike. What the operators do with the rows is written twice: by the operators, and in the SQL
beside each query from the definitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import comparables, search
from .catalogue import half_up, query, table

c, lit = F.col, F.lit
K = "o_orderkey"

ADVERT = {
    "source": "concat('s', cast(o_custkey % 7 as string))",
    "external_id": f"cast({K} as string)",
    "categorie": f"case when {K} % 9 = 0 then 'location' else 'vente' end",
    "segment": f"case {K} % 6 when 0 then 'residentiel' when 1 then 'immeuble' when 2 then 'murs' when 3 then 'fonds' when 4 then 'residentiel' end",
    "type_bien": f"case {K} % 6 when 0 then 'appartement' when 1 then 'immeuble' when 2 then 'local_commercial' when 3 then 'fonds_commerce' when 4 then 'maison' else 'terrain' end",
    "strategie": f"case {K} % 5 when 0 then 'decote' when 1 then 'rendement' when 2 then 'murs' when 3 then 'fonds' end",
    "niveau_affaire": f"case {K} % 7 when 0 then 'excellente' when 1 then 'bonne' when 2 then 'correcte' when 3 then 'a_verifier' else 'hors_cible' end",
    "confiance": f"case {K} % 4 when 0 then 'fiable' when 1 then 'indicative' when 2 then 'fragile' end",
    "score_global": f"case when {K} % 5 <> 4 then cast({K} * 37 % 101 as double) end",
    "titre": "concat(o_orderpriority, ' Belle Maison')",
    "description": f"case when {K} % 8 <> 0 then concat('Vue  sur', chr(10), ' le Lac ', cast({K} as string)) end",
    "ville": "case o_custkey % 5 when 0 then ' Évreux' when 1 then 'EVREUX' when 2 then 'évreux ' when 3 then 'Lyon' else 'Nîmes' end",
    "code_postal": f"case {K} % 11 when 0 then '20100' when 1 then '20250' when 2 then '97410' when 3 then '01200' when 4 then null else concat('6900', cast({K} % 10 as string)) end",
    "prix": f"case when {K} % 13 <> 0 then o_totalprice end",
    "loyer": f"case when {K} % 13 = 0 then o_totalprice / 2 end",
    "surface_bati": f"case when {K} % 17 <> 0 then cast(20 + {K} % 180 as double) end",
    "surface_terrain": f"case when {K} % 3 = 0 then cast({K} % 2000 as double) end",
    "nb_pieces": f"cast({K} % 6 + 1 as int)",
    "prix_m2": f"o_totalprice / (20 + {K} % 180)",
    "median_eur_m2": f"cast(1000 + {K} % 77 as double)",
    "nb_ventes": f"cast({K} % 15 as int)",
    "decote": f"case when {K} % 10 < 7 then cast({K} % 97 as double) / 97 - 0.5 end",
    "rendement_net": f"case when {K} % 10 <> 3 then cast({K} * 7 % 1000 as double) / 100 end",
    "rendement_brut_retenu": f"cast({K} * 7 % 1000 as double) / 80",
    "cashflow_mensuel": f"cast({K} * 11 % 2001 as double) - 1000",
    "loyer_mensuel_retenu": "o_totalprice / 150",
    "baisse_prix_pct": f"case when {K} % 4 = 1 then cast({K} % 40 as double) / 10 end",
    "jours_en_ligne": f"cast({K} % 60 as int)",
    "loyer_reel": f"{K} % 6 = 2",
    "vente_encheres": f"{K} % 10 = 7",
    "active": f"case when {K} % 19 = 0 then false when {K} % 19 <> 1 then true end",
    "rang_doublon": f"case when {K} % 12 = 5 then 2 else 1 end",
    "published_at": f"case when {K} % 3 = 0 then o_orderdate end",
    "first_seen_at": "o_orderdate",
    "last_seen_at": "o_orderdate + interval 3 day",
    "date_vente": f"case when {K} % 20 = 17 then o_orderdate + interval 30 day end",
    "derniere_baisse": f"case when {K} % 4 = 1 then o_orderdate + interval 5 day end",
    "travaux_estimes": f"cast({K} % 5 * 1000 as double)",
    "cout_total": "o_totalprice * 1.075",
    "prix_compare": "o_totalprice",
    "chiffre_affaires": f"case when {K} % 6 = 3 then o_totalprice / 3 end",
    "ebe": f"case when {K} % 6 = 3 then o_totalprice / 30 end",
    "multiple_ebe": f"case when {K} % 6 = 3 then cast(30.0 as double) end",
    "multiple_ebe_reference": "cast(2.7 as double)",
    "secteur_reference": f"case when {K} % 6 = 3 then '' end",
    "dpe": f"substr('ABCDEFG', cast({K} % 7 + 1 as int), 1)",
    "nb_publications": f"cast({K} % 3 + 1 as int)",
    "mode_vente": f"case when {K} % 10 = 7 then 'enchere_notariale' else 'gre_a_gre' end",
    "risques_evaluation": f"case when {K} % 2 = 0 then '' else 'DPE G' end",
    "sources_doublon": "cast(null as string)",
    "url": f"concat('http://x/', cast({K} as string))",
    "images_json": f"""case {K} % 5 when 0 then '["", "a.jpg"]' when 1 then '[{{"url": "b.jpg"}}]' when 2 then '[]' when 3 then 'no' end""",
}
DEALS = f"deal AS (SELECT {', '.join(f'{e} AS {n}' for n, e in ADVERT.items())} FROM orders)"
LIVE = "active IS NOT false AND rang_doublon = 1"


def dressed(df: DataFrame, dress: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} as {n}" for n, e in dress.items()])


def deals(spark, sf) -> DataFrame:
    return dressed(table(spark, sf, "orders"), ADVERT)


FOLDED_CITY = "lower(strip_accents(trim(ville)))"
#: Query strings, and what they ask for.
SEARCHES = {
    "homes": ("segment=residentiel&segment=immeuble&price_min=50000&price_max=250000&city=evreux", f"{LIVE} AND segment IN ('residentiel', 'immeuble') AND coalesce(prix, loyer) BETWEEN 50000 AND 250000 AND {FOLDED_CITY} = 'evreux'"),
    "corsica": ("department=2a&surface_min=30&surface_max=150&yield_min=2.5", f"{LIVE} AND code_postal LIKE '20%' AND surface_bati BETWEEN 30 AND 150 AND rendement_net >= 2.5"),
    "words": ("q=lac+1&new_days=30&auctions=exclude", f"{LIVE} AND (titre ILIKE '%lac 1%' OR description ILIKE '%lac 1%' OR ville ILIKE '%lac 1%') AND jours_en_ligne <= 30 AND NOT vente_encheres"),
    "auctions": ("auctions=only&include_inactive=true&include_duplicates=true&level=bonne&level=excellente", "vente_encheres AND niveau_affaire IN ('bonne', 'excellente')"),
    "rents": ("real_rent=true&scored_only=true&cashflow_positive=true&strategie=murs&strategie=fonds", f"{LIVE} AND loyer_reel AND score_global IS NOT NULL AND cashflow_mensuel >= 0 AND strategie IN ('murs', 'fonds')"),
    "drops": ("price_drop=true&land_min=100&land_max=1500&source=s1&source=s3&source=s5", f"{LIVE} AND baisse_prix_pct >= 1 AND surface_terrain BETWEEN 100 AND 1500 AND source IN ('s1', 's3', 's5')"),
    "first": ("department=1&postal_code=012&type_bien=maison&type_bien=terrain&price_min=abc&unknown=1&land_min=", f"{LIVE} AND code_postal LIKE '01%' AND code_postal LIKE '012%' AND type_bien IN ('maison', 'terrain')"),
    "none": ("city=nowhere", "false"),
}


@query(f"WITH {DEALS} " + " UNION ALL ".join(f"SELECT '{n}' AS search, source, external_id FROM deal WHERE {w}" for n, (_, w) in SEARCHES.items()))
def deal_search(spark, sf):
    """Eight query strings that use every criterion; the table is read once."""
    df = deals(spark, sf)
    met = F.array_compact(F.array(*[F.when(search.predicate(**search.criteria_of(q)), lit(n)) for n, (q, _) in SEARCHES.items()]))
    return df.select(F.explode(met).alias("search"), "source", "external_id")


SORTED = {
    "deal": "score_global DESC NULLS LAST, CASE confiance WHEN 'fiable' THEN 0 WHEN 'indicative' THEN 1 ELSE 2 END, last_seen_at DESC NULLS LAST", "yield": "rendement_net DESC NULLS LAST", "cashflow": "cashflow_mensuel DESC NULLS LAST", "discount": "decote ASC NULLS LAST", "drop": "baisse_prix_pct DESC NULLS LAST",
    "recent": "coalesce(published_at, first_seen_at) DESC NULLS LAST", "price_asc": "prix ASC NULLS LAST", "price_desc": "prix DESC NULLS LAST", "surface": "surface_bati DESC NULLS LAST", "auction_date": "date_vente ASC NULLS LAST",
}


def ranked(parts: dict[str, tuple[DataFrame, str]], n: int) -> DataFrame:
    """name, rank and external_id of the first ``n`` of each sorted table (of a fixed size, by its nature)."""
    first = [d.limit(n).select(lit(name).alias("name"), F.row_number().over(Window.orderBy(*search.ORDERS[o](), "source", "external_id")).alias("rank"), "external_id") for name, (d, o) in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), first)


@query(f"WITH {DEALS} " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{n}' AS name, row_number() OVER (ORDER BY {o}, source, external_id) AS rank, external_id FROM deal WHERE {LIVE}) WHERE rank <= 30" for n, o in SORTED.items()))
def deal_orders(spark, sf):
    df = search.deal_filter(deals(spark, sf))
    return ranked({n: (search.deal_sort(df, n), n) for n in search.ORDERS}, 30)


HOME = "segment = 'residentiel' AND NOT vente_encheres"
TABS = {"all": ("true", "deal"), "decote": (HOME, "discount"), "locatif": (HOME, "deal"), "immeuble": ("segment = 'immeuble'", "deal"), "murs": ("segment = 'murs'", "deal"), "fonds": ("segment = 'fonds'", "deal"), "encheres": ("vente_encheres", "auction_date")}


@query(f"WITH {DEALS} " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{n}' AS name, row_number() OVER (ORDER BY {SORTED[o]}, source, external_id) AS rank, external_id FROM deal WHERE {LIVE} AND {w}) WHERE rank <= 10" for n, (w, o) in TABS.items()))
def deal_presets(spark, sf):
    df = deals(spark, sf)
    return ranked({n: (search.preset(df, n), o) for n, (_, o) in search.PRESETS.items()}, 10)


@query(f"""WITH {DEALS} SELECT count(*) AS total, count(*) FILTER (WHERE niveau_affaire = 'excellente') AS excellent, count(*) FILTER (WHERE niveau_affaire = 'bonne') AS good, count(*) FILTER (WHERE score_global IS NOT NULL) AS scored,
  count(*) FILTER (WHERE score_global IS NULL) AS unscored, round(avg(decote), 6) AS average_discount, count(*) FILTER (WHERE baisse_prix_pct >= 1) AS price_drops, count(*) FILTER (WHERE jours_en_ligne <= 2) AS new, round(median(rendement_net), 4) AS median_net_yield FROM deal WHERE {LIVE}""")
def deal_summary(spark, sf):
    out = search.deal_summary(search.deal_filter(deals(spark, sf)))
    return out.withColumns({"average_discount": F.round("average_discount", 6), "median_net_yield": F.round("median_net_yield", 4)})


@query(f'WITH {DEALS} SELECT count(*) AS "all", count(*) FILTER (WHERE {HOME}) AS decote, count(*) FILTER (WHERE {HOME}) AS locatif, count(*) FILTER (WHERE segment = \'immeuble\') AS immeuble, count(*) FILTER (WHERE segment = \'murs\') AS murs, count(*) FILTER (WHERE segment = \'fonds\') AS fonds, count(*) FILTER (WHERE vente_encheres) AS encheres FROM deal WHERE {LIVE} AND coalesce(prix, loyer) >= 30000')
def deal_tab_counts(spark, sf):
    """Segment and auctions of the criteria don't count for the tabs."""
    return search.deal_tabs(deals(spark, sf), segment="murs", auctions="only", price_min=30000)


@query(f"""WITH {DEALS}, d AS (SELECT * FROM deal WHERE categorie = 'vente' OR type_bien IN ('fonds_commerce', 'local_commercial'))
SELECT count(*) AS total, count(DISTINCT code_postal) AS postal_codes, max(last_seen_at) AS last_seen_at, max(prix) FILTER (WHERE prix > 0 AND categorie = 'vente') AS price_max_observed, round(quantile_cont(prix, 0.99) FILTER (WHERE prix > 0 AND categorie = 'vente'), 4) AS price_p99,
  (SELECT count(DISTINCT p_size % 20) FROM part) AS reference_count, (SELECT arg_max(event_type, ts) FROM events) AS run_source, (SELECT count(*) FROM events WHERE event_type = (SELECT arg_max(event_type, ts) FROM events)) AS run_rows FROM d""")
def deal_volumes(spark, sf):
    """With the number of postcodes of a reference and the run that began last: of each type of event, at its last one."""
    runs = table(spark, sf, "events").groupBy(c("event_type").alias("source")).agg(lit("ok").alias("status"), F.max("ts").alias("started_at"), F.max("ts").alias("finished_at"), F.count(lit(1)).alias("rows_collected"))
    out = search.volumes(deals(spark, sf), table(spark, sf, "part").select((c("p_size") % 20).alias("code_postal")), runs)
    return out.withColumns({"price_p99": F.round("price_p99", 4), "run_source": c("latest_run.source"), "run_rows": c("latest_run.rows_collected")}).drop("latest_run")


@query(f"""WITH {DEALS}, d AS (SELECT trim(ville) AS v, code_postal FROM deal WHERE code_postal LIKE '20%' AND lower(strip_accents(ville)) LIKE '%evre%' AND (categorie = 'vente' OR type_bien IN ('fonds_commerce', 'local_commercial')))
SELECT min(CASE WHEN v = upper(v) THEN 'b' ELSE 'a' END || v)[2:] AS city, min(code_postal) AS postal_code, count(*) AS n FROM d GROUP BY lower(strip_accents(v))""")
def deal_cities(spark, sf):
    return search.cities(deals(spark, sf), "ville", like=" Évre ", department="2B")


AS_OF = "2001-06-15"


@query(f"WITH {DEALS}, f AS (SELECT source, min(first_seen_at) AS f FROM deal GROUP BY source) " + " UNION ALL ".join(f"""SELECT '{n}' AS search, count(*) AS total, count(*) FILTER (WHERE (first_seen_at >= TIMESTAMP '{AS_OF}' - INTERVAL 2 DAY AND first_seen_at > f + INTERVAL 1 DAY) OR derniere_baisse >= TIMESTAMP '{AS_OF}' - INTERVAL 2 DAY) AS recent
FROM deal JOIN f USING (source) WHERE {w}""" for n, (_, w) in SEARCHES.items()))
def deal_search_counts(spark, sf):
    return search.search_counts(deals(spark, sf), [(n, search.predicate(**search.criteria_of(q))) for n, (q, _) in SEARCHES.items()], lit(AS_OF).cast("timestamp"), source="source", first_seen="first_seen_at", last_drop="derniere_baisse")


def export_sql(name: str) -> str:
    if name in ("loyer_reel",):
        return f"CASE WHEN {name} THEN 'oui' ELSE 'non' END"
    if name in ("score_global", "prix", "surface_bati", "surface_terrain", "prix_m2", "median_eur_m2", "decote", "loyer_mensuel_retenu", "rendement_brut_retenu", "rendement_net", "cashflow_mensuel", "chiffre_affaires", "ebe", "multiple_ebe", "baisse_prix_pct"):
        x, digits = (f"{name} * 100", 1) if name == "decote" else (name, 2)
        return f"replace(regexp_replace(printf('%.{digits}f', {half_up(x, digits)}), '(\\.\\d+?)0+$', '\\1'), '.', ',')"
    return f"{name}::VARCHAR"


@query(f"""WITH {DEALS} SELECT {", ".join(f'{export_sql(n)} AS "{label}"' for n, label in search.EXPORT.items())} FROM deal WHERE {LIVE} AND score_global IS NOT NULL ORDER BY {SORTED["yield"]}, source, external_id LIMIT 5000""")
def deal_export(spark, sf):
    """The export's thirty columns, as the strings that stand in the file."""
    return search.export_deals(deals(spark, sf), "yield", scored_only=True)


FED = [*search.FEED, "extrait", "image"]
FEED_SQL = f"""{DEALS}, fed AS (SELECT *, left(regexp_replace(coalesce(description, ''), '\\s+', ' ', 'g'), 420) AS extrait,
    CASE images_json WHEN '["", "a.jpg"]' THEN 'a.jpg' WHEN '[{{"url": "b.jpg"}}]' THEN 'b.jpg' END AS image FROM deal
  WHERE {LIVE} AND (niveau_affaire IN ('excellente', 'bonne') OR (vente_encheres AND (date_vente IS NULL OR date_vente >= TIMESTAMP '1999-01-01'))) ORDER BY score_global DESC NULLS LAST, source, external_id LIMIT 15000)"""


@query(f"""WITH {FEED_SQL} SELECT source, external_id, array_to_string(list_sort(list_filter([{", ".join(f"CASE WHEN {n} IS NOT NULL AND {n}::VARCHAR <> '' THEN '{n}' END" for n in FED)}], lambda x: x IS NOT NULL)), ',') AS keys,
  extrait, image, {half_up('prix_m2', 4)} AS prix_m2, strftime(date_vente, '%Y-%m-%dT%H:%M:%S') AS date_vente, vente_encheres FROM fed""")
def deal_feed(spark, sf):
    """The feed's rows: which keys each has, and the values that are shaped."""
    out = search.feed_deals(deals(spark, sf), lit("1999-01-01").cast("timestamp"))
    at = lambda x: F.get_json_object("json", f"$.{x}")
    keys = F.array_join(F.array_sort(F.json_object_keys("json")), ",").alias("keys")
    return out.select("source", "external_id", keys, F.coalesce(at("extrait"), lit("")).alias("extrait"), at("image").alias("image"), at("prix_m2").cast("double").alias("prix_m2"), at("date_vente").alias("date_vente"), (at("vente_encheres") == "true").alias("vente_encheres"))


DEPARTMENT = "CASE WHEN code_postal LIKE '97%' THEN left(code_postal, 3) WHEN code_postal LIKE '20%' THEN CASE WHEN code_postal::INTEGER < 20200 THEN '2A' ELSE '2B' END ELSE left(code_postal, 2) END"
READERS = {
    "corsica": ({"department": "2B", "price_min": 20000, "price_max": 300000, "surface_min": 25}, f"{DEPARTMENT} = '2B' AND prix BETWEEN 20000 AND 300000 AND surface_bati >= 25"),
    "overseas": ({"department": "974", "yield_min": 1.5, "new_days": 40, "surface_max": 180}, f"{DEPARTMENT} = '974' AND rendement_net >= 1.5 AND jours_en_ligne <= 40 AND surface_bati <= 180"),
    "place": ({"place": "evreux 69", "q": "LAC 1", "cashflow": True}, "lower(coalesce(ville, '') || ' ' || coalesce(code_postal, '')) LIKE '%evreux 69%' AND lower(coalesce(titre, '') || ' ' || extrait || ' ' || coalesce(ville, '')) LIKE '%lac 1%' AND cashflow_mensuel >= 0"),
    "best": ({"source": "s2", "drop": True}, "source = 's2' AND baisse_prix_pct >= 1"),
    "let": ({"real_rent": True, "excellent": True}, "loyer_reel AND niveau_affaire = 'excellente'"),
    "blocks": ({"kind": "Immeuble"}, "(segment = 'immeuble' OR (segment IS DISTINCT FROM 'fonds' AND type_bien = 'immeuble'))"),
    "houses": ({"kind": "Maison", "price_max": 200000}, "type_bien = 'maison' AND segment NOT IN ('immeuble', 'fonds') AND prix <= 200000"),
}


@query(f"WITH {FEED_SQL} " + " UNION ALL ".join(f"""SELECT '{n}' AS name, count(*) AS total, count(*) FILTER (WHERE niveau_affaire = 'excellente') AS excellent, count(*) FILTER (WHERE niveau_affaire = 'bonne') AS good, count(*) FILTER (WHERE baisse_prix_pct >= 1) AS drops,
  count(*) FILTER (WHERE jours_en_ligne <= 2) AS new, (list_sort(list(rendement_net) FILTER (WHERE rendement_net IS NOT NULL)))[count(rendement_net) // 2 + 1] AS middle_yield FROM fed WHERE {w}""" for n, (_, w) in READERS.items()))
def deal_feed_filter(spark, sf):
    """Seven readers of the feed, each with the six figures that it sees."""
    coming = c("vente_encheres") & (c("date_vente").isNull() | (c("date_vente") >= lit("1999-01-01").cast("timestamp")))
    fed = deals(spark, sf).filter(search.predicate() & (c("niveau_affaire").isin("excellente", "bonne") | coming)).withColumn("extrait", search.excerpt(c("description")))
    fed = fed.orderBy(c("score_global").desc_nulls_last(), "source", "external_id").limit(15000)
    return reduce(lambda a, b: a.unionByName(b), [search.feed_summary(search.feed_filter(fed, **f)).select(lit(n).alias("name"), "*") for n, (f, _) in READERS.items()])


FEED_SORTED = {"score": "coalesce(score_global, -1) DESC", "yield": "coalesce(rendement_net, -99) DESC", "cashflow": "coalesce(cashflow_mensuel, -1e9) DESC", "discount": "coalesce(decote, 9) ASC", "drop": "coalesce(baisse_prix_pct, 0) DESC", "recent": "coalesce(jours_en_ligne, 1000000000) ASC", "price_asc": "coalesce(prix, 1e12) ASC", "price_desc": "coalesce(prix, 0) DESC", "auction": "coalesce(date_vente, DATE '9999-01-01') ASC"}


@query(f"WITH {DEALS} " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{n}' AS name, row_number() OVER (ORDER BY {o}, score_global DESC NULLS LAST, source, external_id) AS rank, external_id FROM deal WHERE {LIVE}) WHERE rank <= 30" for n, o in FEED_SORTED.items()))
def deal_feed_orders(spark, sf):
    """The first thirty of each of the nine orders that a reader of the feed may choose."""
    df = search.deal_filter(deals(spark, sf))
    own = lambda n: Window.orderBy(*search.FEED_ORDERS[n](), c("score_global").desc_nulls_last(), "source", "external_id")
    first = [search.feed_sort(df, n).limit(30).select(lit(n).alias("name"), F.row_number().over(own(n)).alias("rank"), "external_id") for n in search.FEED_ORDERS]
    return reduce(lambda a, b: a.unionByName(b), first)


# --- rents ---------------------------------------------------------------------------------------------------------

HOMES = {
    "source": "concat('s', cast(o_orderkey % 3 as string))", "external_id": f"cast({K} as string)", "categorie": f"case when {K} % 9 = 0 then 'location' else 'vente' end",
    "type_bien": f"case {K} % 5 when 0 then 'appartement' when 1 then 'maison' when 2 then 'immeuble' when 3 then 'autre' else 'terrain' end", "segment": f"case when {K} % 5 in (2, 3) and {K} % 4 > 0 then 'immeuble' when {K} % 5 < 2 then 'residentiel' end",
    "nb_pieces": f"case when {K} % 8 > 0 then cast({K} % 8 as int) end", "surface_bati": f"cast({K} % 60 as double)", "code_postal": "case when o_custkey % 10 <> 9 then lpad(cast(o_custkey % 99990 as string), 5, '0') end", "ville": "concat('Évry ', cast(o_custkey % 500 as string))",
}
RENTS = {
    "code_commune": "concat(lpad(cast(c_custkey % 99990 as string), 5, '0'), '-', cast(c_custkey as string))", "commune": "case when c_custkey % 4 = 0 then concat('AUTRE ', cast(c_custkey as string)) else concat('EVRY ', cast(c_custkey % 500 as string)) end",
    "type_bien": "kind", "typologie": "typology", "code_postal": "case when c_custkey % 3 > 0 then lpad(cast(c_custkey % 99990 as string), 5, '0') end", "loyer_m2": "10 + c_custkey % 17 * 0.5 + length(typology)", "loyer_m2_bas": "8 + c_custkey % 17 * 0.5", "loyer_m2_haut": "14 + c_custkey % 17 * 0.5",
    "niveau": "'commune'", "n": "cast(c_custkey % 90 as int)", "r2": "0.5",
}
KINDS = "(VALUES ('appartement', 'tous'), ('appartement', '1_2_pieces'), ('appartement', '3_pieces_plus'), ('maison', 'tous')) AS k(kind, typology)"


def columns(dress: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in dress.items())


@query(f"""WITH a AS (SELECT {columns(HOMES)} FROM orders), r AS (SELECT {columns(RENTS)} FROM customer, {KINDS}
), p AS (SELECT *, CASE WHEN segment = 'immeuble' THEN 'appartement' ELSE type_bien END AS kind, CASE WHEN type_bien = 'appartement' AND nb_pieces BETWEEN 1 AND 2 THEN '1_2_pieces' WHEN type_bien = 'appartement' AND nb_pieces >= 3 THEN '3_pieces_plus' ELSE 'tous' END AS typology
  FROM a WHERE categorie = 'vente' AND (type_bien IN ('appartement', 'maison') OR segment = 'immeuble') AND surface_bati > 0 AND code_postal IS NOT NULL
), m AS (SELECT p.source, p.external_id, r.loyer_m2, r.n, row_number() OVER (PARTITION BY p.source, p.external_id ORDER BY CASE WHEN lower(strip_accents(r.commune)) <> lower(strip_accents(p.ville)) THEN 2 WHEN r.code_postal IS NULL THEN 1 ELSE 0 END, r.code_commune) AS k
  FROM p JOIN r ON r.type_bien = p.kind AND r.typologie = p.typology AND r.code_postal = p.code_postal
    OR r.type_bien = p.kind AND r.typologie = p.typology AND r.code_postal IS NULL AND left(r.code_commune, 2) = left(p.code_postal, 2) AND lower(strip_accents(r.commune)) = lower(strip_accents(p.ville)))
SELECT p.source, p.external_id, m.loyer_m2::DOUBLE AS loyer_m2_mois, m.n AS nb_observations FROM p LEFT JOIN m ON p.source = m.source AND p.external_id = m.external_id AND m.k = 1""")
def rent_best_match(spark, sf):
    kinds = [("appartement", "tous"), ("appartement", "1_2_pieces"), ("appartement", "3_pieces_plus"), ("maison", "tous")]
    each = F.explode(F.array(*[F.struct(lit(a).alias("kind"), lit(b).alias("typology")) for a, b in kinds])).alias("k")
    rents = dressed(table(spark, sf, "customer").select("*", each).select("*", "k.*"), RENTS)
    out = comparables.rent_matches(dressed(table(spark, sf, "orders"), HOMES), rents)
    return out.select("source", "external_id", c("loyer_m2_mois").cast("double").alias("loyer_m2_mois"), c("nb_observations_loyer").alias("nb_observations"))


SHOPS = {
    "source": f"case {K} % 3 when 0 then 'geolocaux' when 1 then 'cbre' else 'bureauxlocaux' end", "external_id": f"cast({K} as string)", "categorie": f"case when {K} % 2 = 0 then 'location' else 'vente' end", "type_bien": f"case {K} % 4 when 0 then 'local_commercial' when 1 then 'local_commercial' when 2 then 'bureau' else 'bureau' end",
    "segment": f"case {K} % 7 when 0 then 'fonds' when 1 then null else 'murs' end", "surface_bati": f"cast(30 + {K} * 13 % 400 as double)", "loyer": f"cast({K} * 7 % 30000 as double)", "code_postal": "case when o_custkey % 10 <> 9 then lpad(cast(o_custkey % 9000 as string), 5, '0') end",
    "ville": "concat('Évry ', cast(o_custkey % 3000 as string))", "last_seen_at": "o_orderdate", "details_json": f"case when {K} % 4 = 2 then '{{\"Nature\": \"LOCATION Pure\"}}' end",
}


@query(f"""WITH a AS (SELECT {columns(SHOPS)} FROM orders), near AS (
  SELECT a.source, a.external_id, r.loyer / r.surface_bati AS ratio, row_number() OVER (PARTITION BY a.source, a.external_id ORDER BY CASE WHEN r.code_postal = a.code_postal THEN 0 ELSE 1 END, abs(ln(r.surface_bati / a.surface_bati)), r.source, r.external_id) AS k
  FROM a JOIN a r ON r.type_bien = a.type_bien AND (r.code_postal = a.code_postal OR lower(strip_accents(r.ville)) = lower(strip_accents(a.ville)))
  WHERE a.categorie = 'vente' AND a.type_bien IN ('local_commercial', 'bureau') AND coalesce(a.segment, 'murs') = 'murs' AND a.surface_bati > 0 AND a.code_postal IS NOT NULL
    AND r.categorie = 'location' AND r.loyer > 0 AND r.surface_bati > 0 AND r.loyer / r.surface_bati BETWEEN 2 AND 200 AND (r.details_json ILIKE '%Location pure%' OR r.source IN ('geolocaux', 'bureauxlocaux'))
    AND r.last_seen_at >= TIMESTAMP '2000-01-01' - INTERVAL 18 MONTH AND r.surface_bati BETWEEN a.surface_bati * 0.40 AND a.surface_bati * 2.50)
SELECT source, external_id, count(*) AS n, {half_up("quantile_cont(ratio, 0.25)", 6)} AS q1, {half_up("quantile_cont(ratio, 0.5)", 6)} AS median, {half_up("quantile_cont(ratio, 0.75)", 6)} AS q3 FROM near WHERE k <= 20 GROUP BY 1, 2 HAVING count(*) >= 3""")
def commercial_rent_neighbours(spark, sf):
    own = dressed(table(spark, sf, "orders"), SHOPS)
    out = comparables.commercial_rents(own, own, lit("2000-01-01").cast("timestamp"))
    return out.withColumns({x: F.round(x, 6) for x in ("q1", "median", "q3")})
