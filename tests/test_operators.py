"""Operators on hand-made rows."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from listingspark.functions import text_fr
from listingspark.operators import comparables, history, prices, scoring, search, tables
from listingspark.sources import files, pages

D = dt.date
NOW = "2026-10-01"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("said", "value"),
    [("48 500,00 €", 48500.0), ("20.000 €", 20000.0), ("11 587.00 €", 11587.0), ("1.315,17 m²", 1315.17), ("350 k€", 350000.0), ("1,2 millions d'euros", 1200000.0), ("12 milliers", 12000.0), ("1 234,50", 1234.5), ("rien", None)],
)
def test_amount(spark, said, value):
    assert one(spark, text_fr.amount(F.lit(said))) == value


@pytest.mark.parametrize(("said", "value"), [("jeudi 1er octobre 2026 à 14h30", dt.datetime(2026, 10, 1, 14, 30)), ("23/09/2026 à 09:30", dt.datetime(2026, 9, 23, 9, 30)), ("2026-01-05", dt.datetime(2026, 1, 5)), ("bientôt", None)])
def test_date(spark, said, value):
    assert one(spark, text_fr.parse_date(F.lit(said))) == value


@pytest.mark.parametrize(("said", "value"), [("Un bâtiment à usage commercial", "local_commercial"), ("Un local à usage d'habitation", "appartement"), ("Un emplacement de parking", "autre"), ("Maison avec terrain", "maison"), ("", "autre")])
def test_type(spark, said, value):
    assert one(spark, text_fr.type_from_text(F.lit(said))) == value


def test_small_texts(spark):
    get = lambda x: one(spark, x)
    assert get(text_fr.occupancy(F.lit("libre de toute occupation"))) == "libre"
    assert get(text_fr.occupancy(F.lit("Occupé par la propriétaire"))) == "occupé"
    assert get(text_fr.postcode_from_city(F.lit("Paris 6ème"))) == "75006" and get(text_fr.postcode_from_city(F.lit("Marseille 13e"))) == "13013"
    key = text_fr.auction_key(F.lit("St Etienne"), F.lit(D(2025, 10, 16)), F.lit("SAINT-ÉTIENNE"), F.lit(45000.0))
    assert get(key) == "saint-etienne|2025-10-16|saint-etienne|45000"
    assert [get(text_fr.department_of(F.lit(p))) for p in ("59000", "20100", "20200", "97110")] == ["59", "2A", "2B", "971"]
    assert get(text_fr.cadastral_m2(F.lit("1 ha 2 a 3 ca"))) == 10203.0 and get(text_fr.surface_m2(F.lit("surface 45,5 m²"))) == 45.5
    assert get(text_fr.rooms(F.lit("Beau T3"))) == 3 and get(text_fr.rooms(F.lit("deux pièces"))) == 2
    assert get(text_fr.dpe_letter(F.lit(200), F.lit(60), F.lit(80.0))) == "E" and get(text_fr.dpe_letter(F.lit(200), F.lit(60), F.lit(30.0))) is None
    assert get(text_fr.auction_status(F.lit("Vente reportée"), F.lit(None))) == "reporté"


def test_bronze_keeps_conflicting_types(spark):
    a = spark.createDataFrame([("a", 165000.0)], "id string, price double")
    b = spark.createDataFrame([("b", [165000, 205000], "x")], "id string, price array<int>, extra string")
    out = tables.append_bronze(tables.append_bronze(None, a, F.lit("t1")), b, F.lit("t2")).orderBy("id").collect()
    assert [(r["id"], r["price"], r["extra"]) for r in out] == [("a", "165000.0", None), ("b", "[165000,205000]", "x")]


def test_upsert_policies(spark):
    old = spark.createDataFrame([(1, "a", "x", 10), (2, "b", "y", 20)], "k int, name string, keep string, first int")
    new = spark.createDataFrame([(2, "B", None, 99), (3, "C", "z", 30)], "k int, name string, keep string, first int")
    out = tables.upsert(old, new, ["k"], {"keep": "keep", "first": "insert"}).orderBy("k").collect()
    assert [tuple(r) for r in out] == [(1, "a", "x", 10), (2, "B", "y", 20), (3, "C", "z", 30)]


def test_history(spark):
    h = spark.createDataFrame([("s", "1", dt.datetime(2026, 1, d), p) for d, p in ((1, 100.0), (2, 90.0), (3, 95.0), (4, 80.0))], "source string, external_id string, observed_at timestamp, prix double")
    r = history.price_signals(h, ["source", "external_id"], "prix", "observed_at").first()
    assert (r["first_value"], r["most"], r["n_drops"], r["last_drop"]) == (100.0, 100.0, 2, dt.datetime(2026, 1, 4))
    now = spark.createDataFrame([("s", "1", 80.0), ("s", "2", None)], "source string, external_id string, prix double")
    out = history.price_changes(now, h, ["source", "external_id"], ["prix"], "observed_at", F.lit(NOW).cast("timestamp")).collect()
    assert [r["external_id"] for r in out] == ["2"]


def test_verdicts_rest_on_accepted_runs(spark):
    """100 is accepted, 60 refused; when 100 has left the window nothing is held against 60."""
    day = lambda d: dt.datetime(2026, 1, 1) + dt.timedelta(days=d)
    runs = spark.createDataFrame([("s", day(0), 100, True), ("s", day(10), 60, True), ("s", day(31), 60, True), ("s", day(32), 43, True), ("s", day(33), 41, True), ("t", day(0), 0, True), ("t", day(1), 5, None)], "source string, run_at timestamp, url_count long, complete boolean")
    got = [(r["url_count"], r["accepted"]) for r in history.inventory_verdicts(runs).orderBy("source", "run_at").collect()]
    assert got == [(100, True), (60, False), (60, True), (43, True), (41, False), (0, False), (5, False)]


def test_inventory_guard(spark):
    runs = spark.createDataFrame([("s", dt.datetime(2026, 1, d), n, ok) for d, n, ok in ((1, 100, True), (2, 60, True), (3, 80, True), (4, 90, False), (5, 0, True))], "source string, run_at timestamp, url_count long, complete boolean")
    assert [r["accepted"] for r in history.inventory_verdicts(runs).orderBy("run_at").collect()] == [True, False, True, False, False]


def sales(spark):
    rows = [(f"m{i}", "Vente", "59", "59350", "59000", "LILLE", "Appartement", 58.0 + i % 5, 4000.0 * (58 + i % 5), 3, None) for i in range(12)]
    rows += [(f"h{i}", "Vente", "59", "59350", "59000", "LILLE", "Maison", 88.0 + i % 5, 3500.0 * (88 + i % 5), 4, 180.0) for i in range(12)]
    df = spark.createDataFrame(rows, "id_mutation string, nature string, code_departement string, code_commune string, code_postal string, commune string, type_local string, surface_bati double, valeur_fonciere double, nombre_pieces int, surface_terrain double")
    return df.select("*", F.date_sub(F.lit(NOW).cast("date"), 200).alias("date_mutation"), F.expr("valeur_fonciere / surface_bati").alias("prix_m2"), F.lit(50.63).alias("latitude"), F.lit(3.06).alias("longitude"))


def listings(spark):
    long = "Bel appartement lumineux en centre ville, proche de toutes les commodités, écoles, commerces et transports, avec balcon et cave en sous-sol."
    rows = [("lbc", "apt-deal", "appartement", 156000.0, 60.0, 3, None, long), ("lbc", "house-deal", "maison", 236250.0, 90.0, 4, 180.0, long), ("lbc", "market", "appartement", 240000.0, 60.0, 3, None, "")]
    df = spark.createDataFrame(rows, "source string, external_id string, type_bien string, prix double, surface_bati double, nb_pieces int, surface_terrain double, description string")
    return df.select(
        "*", F.lit("vente").alias("categorie"), F.lit("59000").alias("code_postal"), F.lit("Lille").alias("ville"), F.lit(50.63).alias("lat"), F.lit(3.06).alias("lng"), F.lit("Annonce").alias("titre"), F.lit("{}").alias("details_json"), F.lit(None).cast("string").alias("mode_vente"),
        F.lit(None).cast("double").alias("prix_adjuge"), F.lit(None).cast("string").alias("dpe"), F.lit(True).alias("active"), F.lit(1).alias("image_count"), F.lit("2026-09-01").cast("date").alias("published_at"), F.lit("2026-09-01").cast("date").alias("first_seen_at"),
    )


FINANCE = "source string, external_id string, segment string, loyer_annuel_declare double, rendement_declare double, chiffre_affaires double, ebe double, resultat double, taxe_fonciere double, travaux_annonces double, nb_lots int, bien_loue boolean, droit_au_bail boolean, charges_copro_annuelles double"
RENTS = "source string, external_id string, loyer_m2_mois double, loyer_m2_bas double, loyer_m2_haut double, niveau string, nb_observations_loyer int, r2_loyer double"


def scored(spark, finance=()):
    as_of = F.lit(NOW).cast("date")
    own = listings(spark)
    near = comparables.listing_comparables(own, sales(spark), as_of)
    key = ["source", "external_id"]
    stats = comparables.comparable_stats(comparables.iqr_trim(near, key, "v_prix_m2"), key, "v_prix_m2", "v_surface_bati", "v_date_mutation")
    stats = stats.select(*key, F.col("n").alias("nb_ventes"), F.col("q1").alias("q1_eur_m2"), F.col("median").alias("median_eur_m2"), F.col("q3").alias("q3_eur_m2"), F.col("first_day").alias("premiere_vente"), F.col("last_day").alias("derniere_vente"), F.col("median_size").alias("surface_mediane_reference"), F.col("mean_distance").alias("score_comparabilite"))
    empty = lambda schema: spark.createDataFrame([], schema)
    inputs = scoring.deal_inputs(
        own, spark.createDataFrame(list(finance), FINANCE), stats, empty(RENTS), empty("source string, external_id string, prix_initial double, prix_max_observe double, nb_baisses long, derniere_baisse timestamp"),
        empty("sector string, multiple_ebe double, multiple_ca double, n long, total boolean"), empty("type_bien string, ratio double, n long"),
    )
    return {r["external_id"]: r for r in scoring.analyse_deals(inputs, as_of).collect()}


def test_end_to_end_scores(spark):
    got = scored(spark)
    assert round(got["apt-deal"]["decote"] * 100, 1) == -35.0 and got["apt-deal"]["niveau_affaire"] == "excellente" and got["apt-deal"]["strategie"] == "decote"
    assert round(got["house-deal"]["decote"] * 100, 1) == -25.0 and got["house-deal"]["niveau_affaire"] == "bonne"
    assert got["market"]["niveau_affaire"] == "hors_cible"
    assert got["apt-deal"]["plafond_excellente"] == 180000.0 and got["apt-deal"]["plafond_bonne"] == 204000.0
    assert got["apt-deal"]["rank"] == 1 and got["apt-deal"]["confiance"] == "indicative"


def test_rented_flat_scores_its_yield(spark):
    row = ("lbc", "market", None, 24000.0, None, None, None, None, 1000.0, None, None, True, False, 500.0)
    r = scored(spark, [row])["market"]
    cost = 240000 * 1.075
    income = 24000 * 11 / 12 - 1000 - 500 * 0.35 - 200 - 24000 * 11 / 12 * 0.05
    assert abs(r["rendement_net"] - 100 * income / cost) < 1e-9 and r["loyer_reel"]
    # occupied: compared with 85 % of the free value, so that it costs more than the market
    over = 240000 / (60 * 4000 * 0.85) - 1
    assert abs(r["decote"] - over) < 1e-9
    assert r["score_rendement"] == round((100 * income / cost - 3) / 5 * 100 * (1 - over) * 0.8) and r["strategie"] == "rendement"


def test_business_scores(spark):
    row = ("lbc", "market", "fonds", None, None, 400000.0, 200000.0, None, None, None, None, False, False, None)
    r = scored(spark, [row])["market"]
    want = (1 - 240000 / 200000 / 2.7) / 0.72 * 100 * 0.6
    assert r["score_fonds"] == round(want) and r["strategie"] == "fonds" and r["decote"] is None


def test_grid_finds_neighbours_across_postcodes(spark):
    own = listings(spark).filter("external_id = 'apt-deal'").withColumn("code_postal", F.lit("59100"))
    as_of = F.lit(NOW).cast("date")
    for shift, n in ((0.0, 12), (0.03, 12), (0.06, 0)):
        moved = own.withColumn("lat", F.lit(50.63 + shift))
        assert comparables.listing_comparables(moved, sales(spark), as_of).count() == n
    unclear = own.withColumn("details_json", F.lit('{"Localisation": "approximative"}'))
    assert comparables.listing_comparables(unclear, sales(spark), as_of).count() == 0


def test_near_cells_cover_the_circle(spark):
    pts = spark.createDataFrame([(la, ln, dla, dln) for la in (-60.0, 0.01, 48.85) for ln in (-179.9, 0.0, 2.35) for dla in (-0.04, 0.0, 0.04) for dln in (-0.06, 0.0, 0.05)], "lat double, lng double, a double, b double")
    pts = pts.withColumn("id", F.monotonically_increasing_id()).withColumns({"lat2": F.col("lat") + F.col("a"), "lng2": F.col("lng") + F.col("b")})
    inside = pts.filter(comparables.flat_km(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2")) <= 5)
    met = inside.select("id", "lat2", "lng2", comparables.near_cells(F.col("lat"), F.col("lng"), 5, 5).alias("cell")).filter(F.col("cell") == comparables.cell(F.col("lat2"), F.col("lng2"), 5))
    assert met.select("id").distinct().count() == inside.count() > 20


def raw(**over):
    base = dict.fromkeys(files.SALES) | {"nature_mutation": "Vente", "date_mutation": "2025-01-01", "valeur_fonciere": "200000", "code_postal": "59000", "code_departement": "59", "nom_commune": "Lille", "type_local": "Appartement", "surface_reelle_bati": "50"}
    return tuple((base | over)[c] for c in files.SALES)


def test_clean_sales(spark):
    shop = prices.PREMISES
    rows = [raw(id_mutation="1"), raw(id_mutation="2"), raw(id_mutation="2"), raw(id_mutation="3", surface_reelle_bati="5"), raw(id_mutation="4", type_local=shop), raw(id_mutation="4", type_local="Dépendance"), raw(id_mutation="5", type_local=shop), raw(id_mutation="5"), raw(id_mutation="6", valeur_fonciere="x")]
    detail = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in files.SALES))
    assert [r["id_mutation"] for r in prices.clean_sales_residential(detail).collect()] == ["1"]
    assert [(r["id_mutation"], r["prix_m2"]) for r in prices.clean_sales_commercial(detail).collect()] == [("4", 4000.0)]


def test_rent_files(spark, tmp_path):
    f = tmp_path / "r.csv"
    f.write_bytes('"INSEE_C";"LIBGEO";"loypredm2";"lwr.IPm2";"upr.IPm2";"TYPPRED";"nbobs_com";"R2_adj"\n"59350";"Évry";"12,5";"10,1";"15";"commune";"42";"0,8"\n'.encode("latin-1"))
    r = files.read_rents(spark, {("appartement", "tous"): str(f)}).first()
    assert (r["commune"], r["loyer_m2"], r["loyer_m2_haut"], r["n"]) == ("Évry", 12.5, 15.0, 42)


def test_sales_files_of_different_headers(spark, tmp_path):
    """Columns are found by each file's own header; a file that isn't there is left out."""
    (tmp_path / "a.csv").write_text("id_mutation,code_postal,type_local\nm1,59000,Maison\n")
    (tmp_path / "b.csv").write_text("type_local,id_mutation,extra\nAppartement,m2,x\n")
    (tmp_path / "c.csv").write_text("id_mutation,code_postal,type_local\nm3,59001\n")
    out = files.read_sales(spark, [f"{tmp_path}/{n}.csv" for n in ("a", "missing", "b", "c")]).orderBy("id_mutation")
    assert out.columns == files.SALES and [(r["id_mutation"], r["code_postal"], r["type_local"]) for r in out.collect()] == [("m1", "59000", "Maison"), ("m2", None, "Appartement"), ("m3", "59001", None)]
    assert files.read_sales(spark, [f"{tmp_path}/missing.csv"]).count() == 0


def test_published_tables(spark, tmp_path):
    """Readers see the last version whose write ended, also after a write that failed."""
    at = f"{tmp_path}/gold"
    for n in (3, 4, 5):
        files.publish_table(spark.range(n), at)
        assert files.published(spark, at).count() == n
    with pytest.raises(Exception, match="broken"):
        files.publish_table(spark.range(9).select(F.raise_error(F.lit("broken")).alias("id")), at)
    assert files.published(spark, at).count() == 5
    files.publish_table(spark.range(7), at)
    assert files.published(spark, at).count() == 7 and len(list((tmp_path / "gold").glob("v=*/_SUCCESS"))) == 2


def test_saved_searches(spark):
    t = lambda d: dt.datetime(2026, 9, 30) - dt.timedelta(days=d)
    df = spark.createDataFrame([("orpi", "ancienne", t(10), None), ("orpi", "recente", t(1), None), ("neuf", "premier-jour", t(1), None), ("orpi", "baisse", t(9), t(1))], "source string, external_id string, first_seen_at timestamp, derniere_baisse timestamp")
    state = spark.createDataFrame([("s", t(3))], "search string, since timestamp")
    cols = {"source": "source", "first_seen": "first_seen_at", "last_drop": "derniere_baisse"}
    alerts, after = search.pending_alerts(df, [("s", F.lit(True))], state, F.lit("2026-09-30").cast("timestamp"), **cols)
    assert sorted(r["external_id"] for r in alerts.collect()) == ["baisse", "recente"]
    assert search.search_matches(df, [("s", F.lit(True))], after, **cols).count() == 0


def test_filters(spark):
    df = spark.createDataFrame([("a", "1", "immeuble", 8.0, "59000", 10.0, True), ("a", "2", "immeuble", 6.0, "59000", 10.0, True), ("b", "3", "immeuble", 9.0, "20200", 1.0, None), ("b", "4", "immeuble", 9.0, "20100", 1.0, False)], "source string, external_id string, segment string, rendement_net double, code_postal string, cashflow_mensuel double, active boolean").withColumn("rang_doublon", F.lit(1))
    ids = lambda d: [r["external_id"] for r in d.orderBy("external_id").collect()]
    assert ids(search.filter_from_query(df, "segment=immeuble&yield_min=7&department=59&cashflow_positive=true")) == ["1"]
    assert ids(search.deal_filter(df, department="2B")) == ["3"] and ids(search.deal_filter(df, department="2a", include_inactive=True)) == ["3", "4"]
    assert ids(search.filter_from_query(df, "source=a&source=b&yield_min=x&nothing=1&segment=")) == ["1", "2", "3"]
    with pytest.raises(ValueError, match="unknown"):
        search.deal_filter(df, nothing=1)


def test_export_file(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, True)], "id long, prix double, loue boolean")
    search.write_export(search.export_rows(df, {"id": "Id", "prix": "Prix", "loue": "Loué"}, order=[F.asc("id")]), str(tmp_path / "x"))
    data = next((tmp_path / "x").glob("*.csv")).read_bytes().decode("utf-8")
    assert data == "﻿Id;Prix;Loué\n1;2,5;oui\n"


def test_jsonld(spark):
    page = '<script type="application/ld+json">{"@graph": [{"@type": "House", "name": "Maison", "offers": {"price": "250 000"}, "address": {"postalCode": "59000"}, "floorSize": {"value": 90}}, {"@type": "Person"}]}</script><script type="application/ld+json">{bad</script>'
    out = pages.extract_jsonld(spark.createDataFrame([("u", page), ("v", None)], "url string, html string")).collect()
    assert [(r["url"], r["name"], r["price"], r["surface"], r["zipcode"]) for r in out] == [("u", "Maison", 250000.0, 90.0, "59000")]


def test_page_state(spark):
    page = '<script id="react-context" type="application/json">{"global": {"listing": {"id": 5, "label": "Murs", "is_sale": true, "sale_price": "80000", "total_surface": "67", "monthly_rent": "800", "realty_type": "Commerce", "characteristics_json": {"is_occupied": true}}}}</script>'
    r = pages.premises_listing(spark.createDataFrame([("u", page), ("v", "<p>"), ("w", '<script id="react-context">{no</script>')], "url string, html string")).collect()
    assert len(r) == 1 and (r[0]["type_hint"], r[0]["price"], r[0]["yearly_rent"], r[0]["occupied"]) == ("vente local_commercial", 80000.0, 9600.0, "oui")


STATES = [
    ("transfer", "app-state", '<script id="app-state" type="application/json">{&q;a&q;: &q;x &a; y&q;}</script>', {"a": "x & y"}),
    ("attribute", "data-estate", """<div data-estate="{&quot;price&quot;: 5, &quot;t&quot;: &quot;l&#233;&quot;}"></div><p data-estate='{"price": 6}'>""", [{"price": 5, "t": "lé"}, {"price": 6}]),
    ("layer", "dataLayer", '<script>dataLayer.push({"id": 7, "in": {"b": [1]}});</script>', {"id": 7, "in": {"b": [1]}}),
    ("layer", "window.state", '<script>window.state = [1, {"a": 2}];\n</script>', [1, {"a": 2}]),
    ("chunks", "self.__next_f", r'<script>self.__next_f.push([1,"a \"b"])</script><script>self.__next_f.push([0])</script><script>self.__next_f.push([1,"\u00e9\n"])</script>', {"text": 'a "bé\n'}),
    ("indexed", "DATA", '<script id="DATA">[{"ref": 1, "place": 2, "seen": 4, "me": 0, "set": 6, "map": 7, "wrap": 8}, "R1", {"city": 3}, "Lille", ["Date", "2026-01-01"], 12, ["Set", 1, 5], ["Map", 1, 5], ["Reactive", 2]]</script>', {"ref": "R1", "place": {"city": "Lille"}, "seen": "2026-01-01", "me": None, "set": ["R1", 12], "map": {"R1": 12}, "wrap": {"city": "Lille"}}),
]


@pytest.mark.parametrize("kind, name, html, want", STATES)
def test_states(spark, kind, name, html, want):
    df = spark.createDataFrame([("u", html), ("v", "<p>nothing</p>"), ("w", None), ("x", html.replace("{", "{{"))], "url string, html string")
    got = [json.loads(r["state"]) for r in pages.extract_state(df, name, kind).filter("url = 'u'").collect()]
    assert got == (want if kind == "attribute" else [want])
    assert pages.extract_state(df, name, kind).filter("url in ('v', 'w')").count() == 0


def test_financial_table(spark):
    html = "<h2>Éléments chiffrés</h2><table><tr><td></td><td><b>2021</b></td><td><b> 2022 </b></td><td><b>2023</b></td></tr><tr><td>CA</td><td>100 000</td><td>120&nbsp;000,5 €</td><td> </td></tr><tr><td>EBE</td><td>5</td><td>-3 000</td><td></td></tr><tr><td>Res. net</td><td></td><td></td><td>7</td></tr><tr><td>Autre</td><td>1</td></tr></table>"
    out = pages.financial_table(spark.createDataFrame([("u", html), ("v", "<table></table>"), ("w", None)], "url string, html string"))
    assert sorted((r["url"], r["key"], r["value"], r["year"]) for r in out.collect()) == [("u", "Chiffre d'affaires", 120000.5, 2022), ("u", "EBE négatif", -3000.0, 2022), ("u", "Résultat net", 7.0, 2023)]


def test_html_text(spark):
    html = "<html><head><style>p{}</style><script>var a='<p>';</script></head><body><p>Un&nbsp;prix : 5&euro;</p><!-- x --><div>deux   mots<br>fin</div></body></html>"
    assert one(spark, pages.html_to_text(F.lit(html))).split("\n") == ["Un prix : 5€", "deux mots", "fin"]
    coded = "L&#8217;&eacute;t&#xE9; &amp;lt; &hearts; &#55296; &nonsense; &lt;b&gt;"
    assert one(spark, pages.html_to_text(F.lit(coded))) == "L’été &lt; ♥ &#55296; &nonsense; <b>"


def test_fix_scale(spark):
    df = spark.createDataFrame([(2e9, 1e8, 50), (2e8, 1e7, 3), (2e8, 1e7, 50)], "ca double, ebe double, staff int")
    assert [(r["ca"], r["ebe"]) for r in pages.fix_scale(df, "ca", "ebe", "staff").collect()] == [(2e6, 1e5), (2e5, 1e4), (2e8, 1e7)]


def test_detail_is_wider(spark):
    own = listings(spark).filter("external_id = 'apt-deal'").withColumns({"code_postal": F.lit("59100"), "lat": F.lit(50.63 + 0.12), "details_json": F.lit("approximative")})
    as_of = F.lit(NOW).cast("date")
    assert comparables.listing_comparables(own, sales(spark), as_of).count() == 0
    assert comparables.detail_comparables(own, sales(spark), as_of).count() == 12


def test_rent_matches(spark):
    rents = spark.createDataFrame([("59350", "Lille", "59000", "appartement", "3_pieces_plus", 12.0), ("59351", "Autre", "59000", "appartement", "3_pieces_plus", 11.0), ("59352", "Tôt", None, "maison", "tous", 9.0)], "code_commune string, commune string, code_postal string, type_bien string, typologie string, loyer_m2 double")
    rents = rents.withColumns({x: F.lit(None).cast("double") for x in ("loyer_m2_bas", "loyer_m2_haut", "r2")} | {"niveau": F.lit("commune"), "n": F.lit(40)})
    own = listings(spark).withColumns({"ville": F.when(F.col("type_bien") == "maison", "TOT").otherwise(F.col("ville")), "segment": F.lit(None).cast("string"), "categorie": F.lit("vente")})
    got = {r["external_id"]: r["loyer_m2_mois"] for r in comparables.rent_matches(own, rents).collect()}
    assert got == {"apt-deal": 12.0, "market": 12.0, "house-deal": 9.0}


def test_commercial_rents(spark):
    seen = F.lit("2026-08-01").cast("date")
    shops = spark.createDataFrame([(f"r{i}", "local_commercial", 1200.0 * (i + 1), 100.0, "59000", "Lille") for i in range(4)] + [("x", "local_commercial", 1e6, 100.0, "59000", "Lille")], "external_id string, type_bien string, loyer double, surface_bati double, code_postal string, ville string").withColumn("last_seen_at", seen)
    shops = shops.withColumns({"source": F.lit("geolocaux"), "categorie": F.lit("location"), "details_json": F.lit(None).cast("string")})
    own = spark.createDataFrame([("s", "1", "local_commercial", 80.0, "59100", "LILLE"), ("s", "2", "local_commercial", 10.0, "59000", "Lille")], "source string, external_id string, type_bien string, surface_bati double, code_postal string, ville string").withColumns({"categorie": F.lit("vente"), "segment": F.lit(None).cast("string")})
    out = comparables.commercial_rents(own, shops, F.lit(NOW).cast("date")).collect()
    assert [(r["external_id"], r["n"], r["median"]) for r in out] == [("1", 4, 30.0)]


def test_reasons(spark):
    r = scored(spark, [("lbc", "market", None, None, None, None, None, None, None, None, None, True, False, 3000.0)])["market"]
    assert r["motif_verification"] is None and r["risques_evaluation"] == "Bien vendu occupé · Charges de copropriété élevées" and r["signaux"] == ""
    assert "Terrain" not in scored(spark)["house-deal"]["risques_evaluation"]


def test_searches_are_saved(spark):
    saved = spark.createDataFrame([("a", "segment=immeuble")], "id string, filtres string")
    two = search.save_search(saved, spark.createDataFrame([("b", "price_max=10")], "id string, filtres string"))
    assert [i for i, _ in search.saved_filters(two)] == ["a", "b"] and search.delete_search(two, ["a"]).count() == 1
    assert search.save_search(saved, spark.createDataFrame([("a", "nix=1")], "id string, filtres string")).count() == 1


def test_trade_kind(spark):
    said = {"Cession de bail, pas de porte": "droit_au_bail", "Vente des murs loués": "murs", "Murs et fonds à vendre": "fonds_commerce", "Location pure d'un local": "location", "Boulangerie, affaire saine": "fonds_commerce"}
    assert {t: one(spark, text_fr.trade_kind(F.lit(t), F.lit(None).cast("string"))) for t in said} == said
