"""Each function of SQL gives what the function of Columns gives that it is named after."""

from __future__ import annotations

from pyspark.sql import functions as F

from listingspark.functions import sql_names, text_fr
from listingspark.operators.comparables import flat_km
from listingspark.sources import pages

TEXTS = [
    None, "", " ", "x" * 100_000, "1 234,50 €", "1.234.567", "12,345", "1.234,5", "1,234.56", "2,5 millions", "3 k€", "450 m€", "12 milliers", "1 200 000 €", "0,5", "prix 12. ", "120 m²", "4 pièces 85,5 m2", "T3 lumineux", "F4 bis", "studio", "six pièces", "deux pieces",
    "2 ha 30 a 15 ca", "12 a", "5 ca", "1er octobre 2026 à 14h30", "le 3 février 2025", "23/09/2026 à 09:30", "2026-13-45", "2026-03-04T10:20:00", "31/02/2026", "Maison avec garage", "Appartement T2 dans immeuble", "local d'habitation", "local à usage d'habitation", "fonds de commerce", "terrain, vignes et bois", "bail commercial, murs",
    "Libre", "inoccupé", "loué", "St-Étienne", "Ste Foy lès Lyon", "Paris 5e", "LYON 3ème", "Marseille 13", "Bordeaux 2", "--", "Carence d'enchères", "vente retirée", "reportée", "prix non communiqué", "adjugé 120 000 €", "location pure", "à louer avec fonds", "Cession de bail", "Vente des murs", "murs et fonds", "murs loués",
    "20090", "20200", "97420", "69001", "2", "a'b\"c\\d $1 ${x} :p",
]


def test_texts(spark):
    names = sql_names.register_sql(spark)
    assert names == sql_names.register_sql(spark) and len(set(names)) == len(names)
    t, none = F.col("t"), F.lit(None)
    same = {
        "ls_fold(t)": text_fr.fold(t), "ls_amount(t)": text_fr.amount(t), "ls_surface(t)": text_fr.surface_m2(t), "ls_plot(t)": text_fr.cadastral_m2(t), "ls_date(t)": text_fr.parse_date(t), "ls_type(t)": text_fr.type_from_text(t), "ls_occupancy(t)": text_fr.occupancy(t), "ls_rooms(t)": text_fr.rooms(t),
        "ls_city_key(t)": text_fr.city_key(t), "ls_arrondissement(t)": text_fr.postcode_from_city(t), "ls_department(t)": text_fr.department_of(t), "ls_auction_status(t, cast(null as double))": text_fr.auction_status(t, none.cast("double")), "ls_auction_status(t, 1.0)": text_fr.auction_status(t, F.lit(1.0)),
        "ls_trade(t, cast(null as string))": text_fr.trade_kind(t, none.cast("string")), "ls_trade(t, 'Murs')": text_fr.trade_kind(t, F.lit("Murs")),
    }
    df = spark.createDataFrame([(x,) for x in TEXTS], "t string")
    for said, column in same.items():
        rows = df.select("t", F.expr(said).alias("a"), column.alias("b")).collect()
        assert [(r["t"], r["a"]) for r in rows] == [(r["t"], r["b"]) for r in rows], said


def test_numbers(spark):
    sql_names.register_sql(spark)
    rows = [(a, b, s) for a in (None, 0.0, 70.0, 70.5, 500.0) for b in (None, 6.0, 101.0) for s in (None, 39.9, 40.0)]
    df = spark.createDataFrame(rows, "kwh double, co2 double, s double")
    out = df.select(F.expr("ls_energy_letter(kwh, co2, s)").alias("a"), text_fr.dpe_letter(F.col("kwh"), F.col("co2"), F.col("s")).alias("b"), F.expr("ls_km(kwh, co2, s, 3.0)").alias("c"), flat_km(F.col("kwh"), F.col("co2"), F.col("s"), F.lit(3.0)).alias("d"))
    assert all(r["a"] == r["b"] and r["c"] == r["d"] for r in out.collect())


def test_tables(spark):
    sql_names.register_sql(spark)
    block = '<script type="application/ld+json">{}</script>'
    html = [
        None, "", "<p>none</p>", block.format('{"@type": "House", "name": "a"}'), block.format('[{"@type": ["Offer", "x"], "name": "b", "offers": [{"price": "1 200,5"}]}, {"@type": "Person"}, 3]') + block.format("{broken"),
        '<script id="a.b">{"n": 1}</script>', '<script id="axb">{"n": 2}</script>', '<script id="a.b">{broken</script>',
    ]
    df = spark.createDataFrame([(str(i), h) for i, h in enumerate(html)], "url string, html string")
    df.createOrReplaceTempView("some_pages")
    by = lambda d: sorted(map(str, d.collect()))
    assert by(spark.sql("select url, l.* from some_pages p, lateral ls_linked_data(p.html) as l")) == by(pages.extract_jsonld(df)) != []
    assert by(spark.sql("select url, s.state from some_pages p, lateral ls_page_state(p.html, 'a.b') as s")) == by(pages.extract_state(df, "a.b")) != []
    left = spark.sql("select count(*), count(s.state) from some_pages p left join lateral ls_page_state(p.html, 'a.b') as s").first()
    assert tuple(left) == (len(html), 1)
