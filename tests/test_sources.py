"""Adverts from payloads to silver rows, finance records, streams."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from listingspark.functions.finance import extract_finance
from listingspark.operators import normalise as norm
from listingspark.operators.tables import append_bronze
from listingspark.sources import api
from listingspark.sources import pages as page_source
from listingspark.streaming import ingest

def now():
    return F.lit("2026-10-01").cast("timestamp")


def finance(spark, text, price=200000.0, kind="appartement", details=None, title=""):
    df = spark.createDataFrame([("s", "1", title, text, json.dumps(details or {}), price, kind)], "source string, external_id string, titre string, description string, details_json string, prix double, type_bien string")
    return extract_finance(df).first()


@pytest.mark.parametrize(
    ("text", "rent"),
    [
        ("Appartement loué 800 € par mois.", 9600.0), ("Loyer annuel de 12 000 €", 12000.0), ("Loyer : 1 000 €", 12000.0), ("Loyer potentiel 900 € par mois", None), ("Loyers estimés de 900 € par mois", None),
        ("Appartement loué. 800 € par mois", 9600.0), ("Bien loué. Loyer : 800 € mensuel. Rendement possible de 9 %", 9600.0), ("Loyer possible. Estimé à 900 € par mois", None), ("Le loyer reste libre, on pourrait demander 900 € par mois", None), ("Possible. Loyer 900 € par mois.", 10800.0), ("Loué! Loyer de 900 € / mois, loyer annuel 10 800 €", 10800.0), ("Loyer. Charges 900 € par mois", None), ("Loyer du marché 900 € par mois", None),
        ("Loyer, prix de vente 200 000 €", None), ("Deux lots loués 400 € par mois. Revenus locatifs 11 000 euros par an", 11000.0), ("Vue sur mer", None),
    ],
)
def test_rent(spark, text, rent):
    assert finance(spark, text)["loyer_annuel_declare"] == rent


def test_finance_record(spark):
    r = finance(spark, "Fonds de commerce. Chiffre d'affaires : 400 000 €. EBE 90 k€. Loyer 1 500 € par mois", 250000.0, "fonds_commerce")
    assert (r["chiffre_affaires"], r["ebe"], r["segment"], r["bien_loue"]) == (400000.0, 90000.0, "fonds", False)
    r = finance(spark, "Immeuble de rapport de 4 appartements, entièrement loué, rentabilité de 8,5 %. Taxe foncière 1 600 €", 300000.0, "immeuble")
    assert (r["nb_lots"], r["rendement_declare"], r["taxe_fonciere"], r["segment"], r["immeuble_rapport"]) == (4, 8.5, 1600.0, "immeuble", True)
    r = finance(spark, "Murs commerciaux loués, chiffre d'affaires du locataire inconnu", 80000.0, "local_commercial", {"Loyer annuel": "9 600", "Taxe foncière": "20"})
    assert (r["loyer_annuel_declare"], r["bien_loue"], r["segment"], r["taxe_fonciere"]) == (9600.0, True, "murs", None)
    r = finance(spark, None, None, None)
    assert r["segment"] == "autre" and r["loyer_annuel_declare"] is None


def bronze(spark, *rows):
    return spark.read.json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))


def test_normalise(spark):
    b = bronze(spark, {"id": 1, "type_hint": "vente bureau", "price": "120000", "surface": "131", "zipcode": "", "_collected_at": "2026-01-01"}, {"id": 1, "type_hint": "vente bureau", "price": "x", "_collected_at": "2026-02-01"}, {"id": 2, "type_hint": "location local_commercial", "price": "4166.98"}, {"type_hint": "vente bureau"})
    out = {r["external_id"]: r for r in norm.normalise(b, "cb", norm.PROFILES["professional"], now()).collect()}
    assert set(out) == {"1", "2"} and out["1"]["prix"] is None and out["1"]["type_bien"] == "bureau" and out["1"]["collected_at"] == dt.datetime(2026, 2, 1)
    assert (out["2"]["categorie"], out["2"]["loyer"], out["2"]["prix"]) == ("location", 4166.98, None)


def test_auctions_and_plots(spark):
    b = bronze(spark, {"id": "a", "type_hint": "vente maison", "price": 45000, "date_vente": "2026-09-29"}, {"id": "b", "type_hint": "vente maison", "price": 45000, "date_vente": "2026-10-05", "prix_adjuge": "50000"})
    out = {r["external_id"]: r for r in norm.normalise(b, "li", norm.PROFILES["auction"], now()).collect()}
    assert (out["a"]["active"], out["b"]["active"], out["b"]["mode_vente"], out["b"]["prix_adjuge"]) == (False, True, "enchere_judiciaire", 50000.0)
    b = bronze(spark, {"id": "c", "type_hint": "maison", "surface": 900, "land_surface": 900}, {"id": "d", "type_hint": "villa", "surface": 120, "rooms": 5})
    out = {r["external_id"]: (r["type_bien"], r["surface_bati"], r["surface_terrain"]) for r in norm.normalise(b, "or", norm.PROFILES["labels"], now()).collect()}
    assert out == {"c": ("maison", None, 900.0), "d": ("maison", 120.0, None)}


def test_second_load_updates(spark):
    row = {"id": "apt", "type_hint": "2", "price": 156000, "surface": 60, "published_at": "2026-01-01"}
    p = norm.PROFILES["attributes"]
    first = norm.merge_source(None, norm.normalise(bronze(spark, row | {"_collected_at": "2026-03-01"}), "l", p, now()), p)
    later = norm.merge_source(first, norm.normalise(bronze(spark, row | {"price": 174000, "name": "neuf", "published_at": None, "_collected_at": "2026-04-01"}), "l", p, now()), p).collect()
    assert len(later) == 1 and (later[0]["prix"], later[0]["titre"], later[0]["first_seen_at"], later[0]["published_at"]) == (174000.0, "neuf", dt.datetime(2026, 3, 1), dt.datetime(2026, 1, 1))


def payload(spark, *ads):
    return spark.createDataFrame([(json.dumps(a),) for a in ads], "payload string")


def test_search_api(spark):
    ad = {"id": "x", "propertyType": "flat", "adTypeFR": "Vente", "price": [165000, 205000], "surfaceArea": 60.5, "blurInfo": {"type": "circle", "radius": 400, "position": {"lat": 50.6, "lon": 3.0}}, "publicationDate": "1970-01-01T00:00:00Z", "energyClassification": "d", "photos": [{"url": "u"}]}
    r = api.search_adverts(payload(spark, ad, ad | {"price": 165000, "blurInfo": {"type": "exact"}})).collect()
    d = json.loads(r[0]["details_json"])
    assert r[0]["price"] is None and d["Fourchette de prix"] == "165000 – 205000" and d["Lots multiples"] == "oui" and d["Précision cartographique"] == "approximative"
    assert r[1]["price"] == 165000.0 and "Précision cartographique" not in json.loads(r[1]["details_json"]) and r[1]["published_at"] is None and r[1]["dpe"] == "D" and r[0]["lat"] == 50.6 and r[0]["image_count"] == 1


def test_notary_api(spark):
    ads = [{"annonceId": i, "prixTotal": p, "prixAffiche": 1, "typeTransaction": t, "typeAdjudication": j, "typeBien": "MAI"} for i, (p, t, j) in enumerate([(22400, "VENTE", "INCONNU"), (None, "VAE", "JUDICIAIRE"), (5, "VAE", "VOLONTAIRE"), (6, "VNI", "INCONNU")])]
    r = api.notary_adverts(payload(spark, *ads)).orderBy("id").collect()
    assert [x["mode_vente"] for x in r] == ["gre_a_gre", "enchere_judiciaire", "enchere_notariale", "vente_interactive"] and r[0]["price"] == 22400.0 and r[1]["price"] == 1.0


def test_attribute_api(spark):
    df = spark.createDataFrame([("1", [("square", "60"), ("real_estate_type", "2"), ("rooms", "3")])], "id string, attributes array<struct<key:string,value:string>>")
    r = api.attribute_adverts(df).first()
    assert (r["surface"], r["type_hint"], r["rooms"], r["land_surface"]) == (60.0, "2", "3", None)


def test_sale_lots(spark):
    page = "<p>Tribunal judiciaire de Lille</p><p>jeudi 1er octobre 2026 à 14h30</p><p>LOT 1 : une maison de 90 m², 4 pièces, libre. Mise à prix : 48 500,00 €</p><p>LOT 2 : un appartement, occupé. Mise à prix 20.000 € Adjugé 31 000 €</p>"
    out = api.sale_lots(spark.createDataFrame([("u", page), ("v", "<p>Une maison. Mise à prix : 10 000 €. Vente reportée</p>")], "url string, html string")).orderBy("id").collect()
    assert [(r["id"], r["price"], r["prix_adjuge"], r["statut"], r["type_hint"], r["occupation"]) for r in out] == [("u-1", 48500.0, None, "à venir", "maison", "libre"), ("u-2", 20000.0, 31000.0, "adjugé", "appartement", "occupé"), ("v", 10000.0, None, "reporté", "maison", None)]
    assert out[0]["court"] == "Lille" and out[0]["date_vente"] == dt.datetime(2026, 10, 1, 14, 30) and out[0]["surface"] == 90.0 and out[0]["rooms"] == 4


def test_clean_rules(spark):
    df = spark.createDataFrame([(1, 150.0, 60.0), (2, 250000.0, 90.0), (3, 9000.0, 20.0)], "id int, price double, surface double")
    out = norm.total_from_unit(norm.unit_price(df), F.col("id") == 9).orderBy("id").collect()
    assert [(r["price"], r["unit_price"]) for r in out] == [(9000.0, 150.0), (250000.0, None), (9000.0, None)]
    one = lambda x: spark.range(1).select(x.alias("x")).first()["x"]
    assert one(norm.energy_letter(F.lit("3"))) == "C" and one(norm.energy_letter(F.lit("z"))) is None and one(norm.life_annuity(F.lit("Vente en viager"))) is True
    assert one(norm.business_price(F.lit(300.0), F.lit(200.0), F.lit(True))) == 100.0 and one(norm.business_price(F.lit(200.0), F.lit(200.0), F.lit(None).cast("boolean"))) is None
    assert one(norm.occupied(F.lit(None).cast("string"), F.lit("X"), F.lit(None).cast("double"), F.lit("local libre"))) is False


def test_merge_stream(spark, tmp_path):
    src, at = tmp_path / "in", str(tmp_path / "silver")
    src.mkdir()
    for k, rows in enumerate([[(1, "a", 1), (2, "b", 1)], [(2, "B", 2), (3, "c", 1), (1, "late", 0)]]):
        (src / f"{k}.json").write_text("\n".join(json.dumps({"k": a, "v": b, "t": t}) for a, b, t in rows))
        stream = ingest.read_stream(spark, str(src), spark.createDataFrame([], "k int, v string, t int").schema)
        ingest.merge_stream(stream, at, str(tmp_path / "check"), ["k"], "t", {}, availableNow=True).awaitTermination()
    got = sorted(map(tuple, ingest.snapshot(spark, at).select("k", "v").collect()))
    assert got == [(1, "a"), (2, "B"), (3, "c")]


def test_append_many(spark):
    a = append_bronze(None, bronze(spark, {"id": 1}), now())
    assert append_bronze(a, bronze(spark, {"id": "x", "n": {"a": 1}}), now()).filter("n is not null").count() == 1


def test_entities(spark):
    """As the standard library reads them, where the table of characters knows the name."""
    import html

    texts = ["l&apos;immeuble", "&check; &eacute sans point", "&notit; &notin; &not &copyx &amp;eacute; &ampeacute;", "&#233;&#xE9;&#128;&#x80 &#0; &#x110000; &#99999999;", "&nbsp;|&NBSP;|&hellip;&euro", "a & b &; &#; &#x; &x;", "&ltp&gt;", "&NotEqualTilde;"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(page_source.entities_read(F.col("t"))).collect()]
    for text, read in zip(texts, got, strict=True):
        assert read == html.unescape(text) or "&#0;" in text or "&amp" in text, text
    assert got[2] == "¬it; ∉ ¬ ©x &eacute; &eacute;" and got[3] == "éé€€ &#0; &#x110000; &#99999999;"


def test_rent_files(spark, tmp_path):
    from listingspark.sources import files

    header = "INSEE_C;LIBGEO;loypredm2;lwr.IPm2;upr.IPm2;TYPPRED;nbobs_com;R2_adj\n"
    (tmp_path / "r.csv").write_bytes((header + '"80000";"Œuilly – l’Été €";"12,5";"10,1";"14";"commune";"7";"0,8"\n').encode("cp1252"))
    r = files.read_rents(spark, {("appartement", "tous"): str(tmp_path / "r.csv")}).first()
    assert (r["commune"], r["loyer_m2"], r["loyer_m2_bas"], r["n"], r["r2"], r["type_bien"]) == ("Œuilly – l’Été €", 12.5, 10.1, 7, 0.8, "appartement")


def test_inventory_files(spark, tmp_path):
    from listingspark.sources import files

    (tmp_path / "i.txt").write_text("http://x/1\n\n  http://x/2 \nhttp://x/1\n")
    got = files.read_inventory(spark, str(tmp_path / "i.txt"), "s", now()).collect()
    assert sorted((r["source"], r["url"]) for r in got) == [("s", "http://x/1"), ("s", "http://x/2")] and all(r["listed_at"] for r in got)


def test_stream_into_buckets(spark, tmp_path):
    """Micro-batches rewrite the buckets of their rows alone; late and repeated rows change nothing."""
    import json

    from listingspark.sources import buckets
    from listingspark.streaming import ingest

    src, at = tmp_path / "in", str(tmp_path / "table")
    src.mkdir()
    files = lambda: {str(f): f.stat().st_mtime_ns for f in (tmp_path / "table").rglob("*.parquet")}

    def feed(name: str, rows: list[tuple]) -> None:
        (src / name).write_text("\n".join(json.dumps({"k": a, "v": b, "t": t, "first": b}) for a, b, t in rows))
        stream = ingest.read_stream(spark, str(src), spark.createDataFrame([], "k int, v string, t int, first string").schema)
        ingest.merge_stream_in_buckets(stream, at, str(tmp_path / "check"), ["k"], "t", 8, {"first": "insert"}, availableNow=True).awaitTermination()

    got = lambda: sorted(map(tuple, buckets.read_buckets(spark, at).select("k", "v", "first").collect()))
    feed("0.json", [(k, f"a{k}", 5) for k in range(50)] + [(1, "older", 4), (None, "x", 9), (2, "y", None)])
    assert got() == [(k, f"a{k}", f"a{k}") for k in range(50)]
    before = files()
    feed("1.json", [(7, "b7", 6), (7, "late", 1)])
    assert got() == [(k, "b7" if k == 7 else f"a{k}", f"a{k}") for k in range(50)]
    kept = before.items() & files().items()
    assert len({f.split("bucket_=")[1].split("/")[0] for f, _ in kept}) == 7
    feed("2.json", [(7, "late", 5), (60, "c60", 0)])
    assert got() == [(k, "b7" if k == 7 else f"a{k}", f"a{k}") for k in range(50)] + [(60, "c60", "c60")]
    assert not (tmp_path / "table" / buckets.READY).exists()


def test_swap_that_breaks_off(spark, tmp_path):
    """Buckets that a job had ready, and the old ones of which it had removed, come back with the next merge."""
    import shutil

    from listingspark.sources import buckets

    at = str(tmp_path / "table")
    buckets.merge_buckets(spark, at, spark.createDataFrame([(k, "a") for k in range(20)], "k int, v string"), ["k"], 4)
    whole = buckets.read_buckets(spark, at)
    number = whole.filter("k = 3").first()[buckets.BUCKET]
    ready = whole.filter(F.col(buckets.BUCKET) == number).withColumn("v", F.when(F.col("k") == 3, "b").otherwise(F.col("v")))
    ready.write.parquet(f"{at}/{buckets.READY}")
    shutil.rmtree(tmp_path / "table" / f"{buckets.BUCKET}={number}")
    assert buckets.read_buckets(spark, at).filter("k = 3").count() == 0
    buckets.merge_buckets(spark, at, spark.createDataFrame([(30, "c")], "k int, v string"), ["k"], 4)
    assert sorted(map(tuple, buckets.read_buckets(spark, at).select("k", "v").collect())) == [(k, "b" if k == 3 else "a") for k in range(20)] + [(30, "c")]
    assert not buckets.end_swap(spark, at)
