"""Scores of adverts under investment strategies: decote, rendement, murs, fonds.

``analyse_deals`` is a chain of projections: each step adds columns to the one before, and Catalyst folds them into a
few. It takes one row for each listing with its finance record, comparables, rent reference and price signals joined.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text_fr import FLAGS, fold, json_text, quick
from .ranks import spread_quantiles


@dataclass(frozen=True)
class Assumptions:
    """Default assumptions, in percent, euros or as named."""

    notary: float = 7.5
    business_fees: float = 5.0
    credit_rate: float = 3.4
    credit_years: float = 20.0
    deposit: float = 10.0
    vacant_months: float = 1.0
    management: float = 0.0
    upkeep: float = 5.0
    insurance: float = 200.0
    land_tax_months: float = 1.2
    condo_m2: float = 25.0
    condo_owner_share: float = 0.35
    works_m2: float = 600.0
    works_dpe_f_m2: float = 200.0
    works_dpe_g_m2: float = 350.0
    auction_ratio: float = 1.65
    same_price: float = 0.03

    def annuity(self) -> float:
        """Monthly instalment of a loan of 1."""
        months, rate = int(self.credit_years * 12), self.credit_rate / 1200
        return rate / (1 - (1 + rate) ** -months) if rate else 1 / months


#: Auction ratios by type where too few results are known.
AUCTION_RATIOS = {"appartement": 2.06, "maison": 1.46}
#: Multiples of a business's result and turnover where no sector is known.
EBE_MULTIPLE, CA_MULTIPLE = 2.7, 0.7
#: Sale modes that are auctions.
AUCTIONS = ("enchere_judiciaire", "enchere_notariale", "vente_interactive", "cession_publique")
SEGMENTS = {"appartement": "residentiel", "maison": "residentiel", "fonds_commerce": "fonds", "local_commercial": "murs", "bureau": "murs", "immeuble": "immeuble", "terrain": "terrain"}

c, lit, when = F.col, F.lit, F.when


def clamp(x: Column, lo: float = 0.0, hi: float = 100.0) -> Column:
    return F.greatest(lit(lo), F.least(lit(hi), x))


def true(x: Column) -> Column:
    return F.coalesce(x, lit(False))


def auction_ratio(listings: DataFrame, *, min_n: int = 20, bounds: tuple[float, float] = (0.3, 15.0)) -> DataFrame:
    """ratio: median of hammer price over reserve by type, from types with enough results."""
    ratio = F.try_divide("prix_adjuge", "prix")
    df = listings.filter("prix_adjuge > 0 and prix > 0 and mode_vente like 'enchere%'").withColumn("ratio", ratio).filter(c("ratio").between(*bounds))
    return spread_quantiles(df, ["type_bien"], "ratio", [0.5]).filter(c("n") >= min_n).select("type_bien", c("q")[0].alias("ratio"), "n")


def sector_multiples(deals: DataFrame, *, sector: str, price: str, ebe: str, turnover: str, bounds: tuple[float, float] = (0.5, 15.0)) -> DataFrame:
    """Median price over result, and over turnover where it is known, of each sector and of all (grouping sets; ``total``
    tells the grand total from the group of rows without a sector, '*')."""
    multiple = F.try_divide(price, ebe)
    df = deals.filter((c(ebe) > 0) & (c(price) > 0)).withColumns({"_m": multiple, "_sector": F.coalesce(sector, lit("*"))}).filter(c("_m").between(*bounds))
    df = df.withColumn("_t", when(c(turnover) > 0, F.try_divide(price, turnover)))
    # each row for its sector and for the total, its measures one below the other: grouping sets whose medians are spread
    kinds = F.explode(F.array(F.struct(c("_sector").alias("sector"), lit(False).alias("total")), F.struct(lit(None).cast("string").alias("sector"), lit(True).alias("total")))).alias("g")
    measures = F.explode(F.array(*[F.struct(lit(x).alias("name"), c(x).alias("value")) for x in ("_m", "_t")])).alias("m")
    long = df.select(kinds, "_m", "_t").select("g.*", measures).select("sector", "total", "m.*")
    found = spread_quantiles(long, ["sector", "total", "name"], "value", [0.5])
    of = lambda name, x: F.max(when(c("name") == name, x))
    return found.groupBy("sector", "total").agg(of("_m", c("q")[0]).alias("multiple_ebe"), of("_t", c("q")[0]).alias("multiple_ca"), of("_m", c("n")).alias("n")).select("sector", "multiple_ebe", "multiple_ca", "n", "total")


def deal_inputs(listings: DataFrame, finance: DataFrame, comparables: DataFrame, rents: DataFrame, signals: DataFrame, multiples: DataFrame, ratios: DataFrame) -> DataFrame:
    """One row for each listing in scope (sales, and businesses, shops and offices of any kind)."""
    key = ["source", "external_id"]
    df = listings.filter("categorie = 'vente' or type_bien in ('fonds_commerce', 'local_commercial', 'bureau')")
    df = df.join(finance, key, "left").join(comparables, key, "left").join(rents, key, "left").join(signals, key, "left")
    df = df.withColumn("secteur", json_text(c("details_json"), "Secteur"))
    own = multiples.filter("not total and sector <> '*' and n >= 30").select(c("sector").alias("secteur"), c("multiple_ebe").alias("_own_ebe"), c("multiple_ca").alias("_own_ca"))
    rest = multiples.filter("not total and sector = '*'").select(c("multiple_ebe").alias("_rest_ebe"), c("multiple_ca").alias("_rest_ca"), lit(True).alias("_one"))
    df = df.join(own, "secteur", "left").withColumn("_one", lit(True)).join(rest, "_one", "left").join(ratios.select("type_bien", c("ratio").alias("_ratio")), "type_bien", "left")
    default = reduce(lambda a, kv: when(c("type_bien") == kv[0], kv[1]).otherwise(a), AUCTION_RATIOS.items(), lit(Assumptions().auction_ratio))
    return df.select(
        *[x for x in df.columns if not x.startswith("_")],
        F.coalesce("_own_ebe", "_rest_ebe", lit(EBE_MULTIPLE)).alias("multiple_ebe_reference"),
        F.coalesce("_own_ca", "_rest_ca", lit(CA_MULTIPLE)).alias("multiple_ca_reference"),
        F.coalesce("_ratio", default).alias("ratio_adjudication"),
    )


def flags(df: DataFrame) -> DataFrame:
    """Segment, text flags and the price that compares."""
    text = fold(F.concat_ws(" ", F.coalesce("titre", lit("")), F.coalesce("description", lit(""))))
    details = F.lower(F.coalesce("details_json", lit("")))
    has = lambda name: c("_text").rlike(quick(FLAGS[name]))
    kind = reduce(lambda a, kv: when(c("type_bien") == kv[0], kv[1]).otherwise(a), SEGMENTS.items(), lit("autre"))
    business = F.expr("try_cast(_business as double)")
    df = df.withColumns({"_text": text, "segment": F.coalesce("segment", kind), "_business": json_text(c("details_json"), "Prix du fonds"), "_nature": F.lower(F.coalesce(json_text(c("details_json"), "Nature"), lit("")))})
    df = df.withColumns(
        {
            "prix_fonds": when(business > 0, business).when(c("_nature").contains("murs") | has("murs_et_fonds"), None).otherwise(c("prix")),
            "prix_m2": when(c("categorie") == "vente", F.try_divide("prix", F.nullif("surface_bati", lit(0.0)))),
            "localisation_approximative": details.contains("approximative"),
            "transaction_atypique": has("atypique"),
            "vente_encheres": F.coalesce(c("mode_vente").isin(*AUCTIONS), has("enchere")),
            "bien_occupe": has("occupe") | true(c("bien_loue")),
            "bien_non_habitable": has("non_habitable"),
            "residence_geree": has("residence_geree"),
            "non_disponible": has("non_disponible") | details.contains('"sous compromis": "oui"'),
            "surface_atypique": fold(F.coalesce("description", lit(""))).rlike(FLAGS["surface_atypique"]),
            "_works": has("travaux") & ~has("sans_travaux"),
            "_heavy": has("travaux_lourds") & ~has("sans_travaux"),
            "procedure_copropriete": F.lower(F.coalesce(json_text(c("details_json"), "Procédure de copropriété en cours"), lit("non"))) == "oui",
            "loyer_bail": F.expr("try_cast(get_json_object(details_json, \"$['Loyer du bail annuel']\") as double)"),
        }
    )
    likely = when(c("vente_encheres") & c("prix_adjuge").isNull(), c("prix") * c("ratio_adjudication")).otherwise(F.coalesce("prix_adjuge", "prix"))
    unsized = ~c("segment").isin("fonds", "terrain") & (F.coalesce("surface_bati", lit(0.0)) <= 0)
    tiny = (c("segment") == "residentiel") & true(c("surface_bati") < 14)
    broken = (F.coalesce("prix", lit(0.0)) <= 0) | unsized | tiny | c("bien_non_habitable") | c("non_disponible") | c("transaction_atypique")
    df = df.withColumns({"travaux_probables": c("_works") | true(c("travaux_annonces") > 0), "prix_compare": likely, "donnees_invalides": broken})
    value = c("surface_bati") * c("median_eur_m2")
    return df.withColumn("prix_trop_bas", c("donnees_invalides") | ((c("segment") == "residentiel") & true(c("prix_compare") <= value * 0.55)))


def rents_and_costs(df: DataFrame, a: Assumptions) -> DataFrame:
    """Rent estimates, works, what is kept of the rent, costs and income."""
    flat, house = c("type_bien") == "appartement", c("type_bien") == "maison"
    premises = c("type_bien").isin("local_commercial", "bureau") | (c("segment") == "murs")
    usual = when(flat & c("nb_pieces").between(1, 2), 37.0).when(flat & (c("nb_pieces") >= 3), 72.0).when(flat, 52.0).when(house, 92.0).otherwise(c("surface_bati"))
    bend = when(flat, 0.75).when(house, 0.80).otherwise(1.0)
    df = df.withColumn("_usual", usual)
    curve = c("loyer_m2_mois") * c("_usual") * F.pow(clamp(F.try_divide("surface_bati", "_usual"), 0.25, 1.6), bend)
    spread = lambda edge: F.exp(F.ln(F.try_divide(F.nullif(edge, lit(0.0)), F.nullif("loyer_m2_mois", lit(0.0)))) * 0.654)
    lived_in = c("segment").isin("residentiel", "immeuble")
    per_m2 = lambda x: c("surface_bati") * x
    dpe = F.upper(F.coalesce("dpe", lit("")))
    works = (
        when(c("travaux_annonces") > 0, c("travaux_annonces"))
        .when(c("_heavy") & lived_in, per_m2(a.works_m2))
        .when(c("_works") & lived_in, per_m2(a.works_m2 * 0.4))
        .when((dpe == "G") & lived_in, per_m2(a.works_dpe_g_m2))
        .when((dpe == "F") & lived_in, per_m2(a.works_dpe_f_m2))
        .otherwise(0.0)
    )
    real = c("segment").isin("residentiel", "immeuble", "murs") & true(c("loyer_annuel_declare") > 0) & true(c("bien_loue"))
    df = df.withColumns(
        {
            "loyer_mensuel_estime": when(premises, c("loyer_m2_mois") * c("surface_bati")).otherwise(curve),
            "loyer_mensuel_bas": when(premises, c("loyer_m2_bas") * c("surface_bati")).otherwise(curve * spread("loyer_m2_bas")),
            "loyer_mensuel_haut": when(premises, c("loyer_m2_haut") * c("surface_bati")).otherwise(curve * spread("loyer_m2_haut")),
            "loyer_mensuel_bas_officiel": c("loyer_m2_bas") * c("surface_bati"),
            "loyer_mensuel_haut_officiel": c("loyer_m2_haut") * c("surface_bati"),
            "travaux_estimes": works,
            "loyer_reel": real,
        }
    )
    odd = lived_in & true((F.try_divide("prix", F.nullif("surface_bati", lit(0.0))) < 300) | (c("surface_bati") > when(c("segment") == "immeuble", 1500).otherwise(400)))
    kept = when(real, c("loyer_annuel_declare") / 12).when(odd, None).when(c("segment") == "immeuble", c("loyer_mensuel_bas") * 0.85).otherwise(c("loyer_mensuel_bas"))
    fees = when(c("segment") == "fonds", a.business_fees).otherwise(a.notary)
    df = df.withColumns({"loyer_mensuel_retenu": kept, "cout_total": c("prix") * (1 + fees / 100) + c("travaux_estimes")})
    condo = when(flat & (c("segment") == "residentiel"), F.coalesce(c("charges_copro_annuelles"), per_m2(a.condo_m2)) * a.condo_owner_share).otherwise(0.0)
    df = df.withColumns({"taxe_fonciere_retenue": F.coalesce(c("taxe_fonciere"), c("loyer_mensuel_retenu") * a.land_tax_months), "copro_non_recuperable": condo, "loyer_annuel_encaisse": c("loyer_mensuel_retenu") * 12 * ((12 - a.vacant_months) / 12)})
    income = c("loyer_annuel_encaisse") - c("taxe_fonciere_retenue") - c("copro_non_recuperable") - a.insurance - c("loyer_annuel_encaisse") * (a.upkeep + a.management) / 100
    return df.withColumns({"revenu_net_annuel": income, "mensualite_credit": c("cout_total") * (1 - a.deposit / 100) * a.annuity()})


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part, F.nullif(whole, lit(0.0)))


def measures(df: DataFrame, as_of: Column) -> DataFrame:
    """Yields, multiples, discount, age, ceilings, confidence."""
    priced = ~c("prix_trop_bas")
    built = c("segment").isin("residentiel", "immeuble", "murs")
    home = c("segment") == "residentiel"
    worth = c("surface_bati") * c("median_eur_m2")
    paid = c("prix_compare") + when(home, c("travaux_estimes")).otherwise(0.0)
    spread = percent(c("q3_eur_m2") - c("q1_eur_m2"), c("median_eur_m2"))
    clean = reduce(lambda x, y: x & ~true(c(y)), ("bien_occupe", "bien_non_habitable", "residence_geree", "non_disponible", "surface_atypique", "travaux_probables", "procedure_copropriete"), ~c("localisation_approximative"))
    sure = (
        (c("nb_ventes") >= 10) & (c("score_comparabilite") <= 0.65) & (spread <= 0.28)
        & c("surface_mediane_reference").between(c("surface_bati") * 0.85, c("surface_bati") * 1.15)
        & (c("derniere_vente") >= F.add_months(as_of, -24)) & clean
        & F.upper(F.coalesce("dpe", lit(""))).between("A", "E") & (F.length(F.coalesce("description", lit(""))) >= 250)
        & (F.coalesce("details_json", lit("{}")) != "{}")
        & ~true(percent(c("charges_copro_annuelles"), c("surface_bati")) > 35)
        & ((c("type_bien") != "maison") | c("surface_terrain").isNotNull())
    )
    fair = (c("nb_ventes") >= 7) & (c("score_comparabilite") <= 1.05) & (spread <= 0.45)
    known = c("nb_ventes").isNotNull()
    trust = (
        when(c("prix_trop_bas") | ~built, "indisponible").when(~home & known, "indicative").when(sure, "fiable").when(fair, "indicative").when(known, "fragile").otherwise("indisponible")
    )
    return df.withColumns(
        {
            "rendement_brut_affiche": percent(c("loyer_mensuel_estime") * 1200, c("prix")),
            "rendement_brut_prudent": percent(c("loyer_mensuel_bas") * 1200, c("prix")),
            "rendement_brut_haut": percent(c("loyer_mensuel_haut") * 1200, c("prix")),
            "rendement_brut_marche": percent(c("loyer_mensuel_estime") * 1200, worth),
            "rendement_brut_retenu": percent(c("loyer_mensuel_retenu") * 1200, c("prix")),
            "rendement_net": percent(c("revenu_net_annuel") * 100, c("cout_total")),
            "cashflow_mensuel": c("revenu_net_annuel") / 12 - c("mensualite_credit"),
            "multiple_ca": percent(c("prix"), c("chiffre_affaires")),
            "multiple_ebe": percent(c("prix_fonds"), c("ebe")),
            "poids_loyer_ca": percent(F.coalesce(c("loyer_bail"), when(c("segment") == "fonds", c("loyer_annuel_declare"))), c("chiffre_affaires")),
            "decote": when(priced & built, percent(paid, worth * when(home & c("bien_occupe"), 0.85).otherwise(1.0)) - 1),
            "decote_brute": when(priced & built, percent(percent(c("prix_compare"), c("surface_bati")) - c("median_eur_m2"), c("median_eur_m2"))),
            "baisse_prix_pct": percent((c("prix_max_observe") - c("prix")) * 100, c("prix_max_observe")),
            "jours_en_ligne": F.datediff(as_of, F.coalesce("published_at", "first_seen_at")),
            "plafond_q1": when(priced, c("surface_bati") * c("q1_eur_m2")),
            "plafond_excellente": when(priced, worth * 0.75),
            "plafond_bonne": when(priced, worth * 0.85),
            "confiance": trust,
        }
    )


def scores(df: DataFrame) -> DataFrame:
    """A score from 0 to 100 for each strategy that applies."""
    short = when(F.length(F.coalesce("description", lit(""))) < 120, 0.8).otherwise(1.0)
    trust = when(c("confiance") == "fiable", 1.0).when(c("confiance") == "indicative", 0.75).otherwise(0.45)
    landless = when((c("type_bien") == "maison") & c("surface_terrain").isNull(), 0.85).otherwise(1.0)
    discount = clamp(c("decote") * -100 / 0.30) * trust * landless * short
    scale = lambda lo, hi: clamp((c("rendement_net") - lo) / (hi - lo) * 100)
    over = when(c("decote") > 0, F.greatest(lit(0.35), 1 - c("decote"))).otherwise(1.0)
    rent_trust = when(c("loyer_reel"), 1.0).when((c("nb_observations_loyer") >= 30) & (F.coalesce("r2_loyer", lit(1.0)) >= 0.5), 0.85).otherwise(0.65)
    yielding = F.least(when(c("loyer_reel"), 100.0).otherwise(70.0), scale(3, 8) * over * rent_trust * short)
    walls = scale(4, 10) * when(c("loyer_reel"), 1.0).when(c("nb_observations_loyer") >= 8, 0.6).otherwise(0.45)
    dear = when(c("poids_loyer_ca") > 0.12, 0.7).otherwise(1.0)
    unlikely = when(percent(c("ebe"), c("chiffre_affaires")) > 0.45, 0.6).otherwise(1.0)
    cheap = lambda multiple, usual: clamp((1 - multiple / usual) / 0.72 * 100)
    by_ebe, by_ca = F.try_divide("prix_fonds", F.nullif("ebe", lit(0.0))), F.try_divide("prix_fonds", F.nullif("chiffre_affaires", lit(0.0)))
    business = (
        when((c("ebe") > 0) & by_ebe.between(0.8, 30), F.round(cheap(by_ebe, c("multiple_ebe_reference")) * dear * unlikely))
        .when((c("chiffre_affaires") > 0) & (c("prix_fonds") > 0), F.round(F.least(lit(60.0), cheap(by_ca, c("multiple_ca_reference"))) * dear))
    )
    known = c("rendement_net").isNotNull()
    return df.withColumns(
        {
            "score_decote": when(c("decote").isNotNull() & c("median_eur_m2").isNotNull() & (c("segment") == "residentiel"), F.round(discount)),
            "score_rendement": when(c("segment").isin("residentiel", "immeuble") & ~c("prix_trop_bas") & known & ~c("residence_geree"), F.round(yielding)),
            "score_murs": when((c("segment") == "murs") & ~c("donnees_invalides") & known, F.round(walls)),
            "score_fonds": when((c("segment") == "fonds") & (c("prix") > 0), business),
        }
    )


#: Strategies in the order that wins ties.
STRATEGIES = ("fonds", "murs", "rendement", "decote")


def levels(df: DataFrame) -> DataFrame:
    """Best score, its strategy, bonus, global score and level."""
    best = F.greatest(*[c(f"score_{s}") for s in STRATEGIES])
    strategy = reduce(lambda a, s: when(c(f"score_{s}") == best, s).otherwise(a), reversed(STRATEGIES), lit(None).cast("string"))
    bonus = when(c("baisse_prix_pct") >= 10, 8).when(c("baisse_prix_pct") >= 5, 5).otherwise(0) + when(c("jours_en_ligne") <= 2, 3).otherwise(0)
    df = df.withColumns({"strategie": strategy, "bonus": bonus, "score_global": when(best.isNotNull(), F.least(lit(100.0), best + bonus))})
    level = (
        when((c("categorie") != "vente") & (c("segment") != "fonds"), "a_analyser")
        .when(c("prix_trop_bas") & ~c("segment").isin("terrain", "autre"), "a_verifier")
        .when(c("score_global").isNull(), "a_analyser")
        .otherwise(level_of(c("score_global")))
    )
    return df.withColumn("niveau_affaire", level)


def level_of(score: Column) -> Column:
    return when(score >= 75, "excellente").when(score >= 55, "bonne").when(score >= 30, "correcte").otherwise("hors_cible")


# Messages of checks, risks and signals.
GROUNDS = {
    "price": "Prix de vente nul ou absent",
    "surface": "Surface absente ou incohérente",
    "tiny": "Surface inférieure à 14 m² : parking, cave ou chambre de service probable",
    "odd": "Viager, nue-propriété ou parts : comparaison directe non valable",
    "uninhabitable": "Le bien n’est pas encore un logement habitable comparable aux ventes DVF résidentielles",
    "taken": "L’annonce indique qu’une offre ou un compromis est déjà en cours",
    "low": "Décote supérieure à 45 % : prix, état ou nature de la vente à contrôler",
}
RISKS = {
    "auction": ("Vente aux enchères : prix final probable ≈ ", " × mise à prix (médiane des adjudications observées)"),
    "occupied": "Bien vendu occupé",
    "managed": "Résidence gérée ou bail commercial",
    "carrez": "Surface Carrez différente de la surface annoncée",
    "works": "Travaux probables",
    "procedure": "Procédure de copropriété en cours",
    "charges": "Charges de copropriété élevées",
    "g": "DPE G : location interdite sans travaux",
    "f": "DPE F : location interdite à partir de 2028",
    "land": "Terrain non renseigné",
    "place": "Localisation approximative",
    "turnover": "Chiffre d’affaires non publié",
    "ebe": "EBE supérieur à 45 % du chiffre d’affaires : à justifier par la liasse fiscale",
    "rent": "Loyer élevé au regard du chiffre d’affaires",
}
SIGNALS = {"drop": ("Prix baissé de ", " %"), "new": "Nouvelle annonce", "rent": "Loyer réel publié", "auction": "Enchère"}


def reasons(df: DataFrame) -> DataFrame:
    """motif_verification (the first ground for a check), risques_evaluation and signaux (all that apply)."""
    dpe, home = F.upper(F.coalesce("dpe", lit(""))), c("segment") == "residentiel"
    business = c("segment") == "fonds"
    said = lambda p, text: when(true(p), lit(text) if isinstance(text, str) else text)
    around = lambda text, x: F.concat(lit(text[0]), x.cast("string"), lit(text[1]))
    ground = F.coalesce(
        said(F.coalesce("prix", lit(0.0)) <= 0, GROUNDS["price"]),
        said(F.coalesce("surface_bati", lit(0.0)) <= 0, GROUNDS["surface"]),
        said(home & (c("surface_bati") < 14), GROUNDS["tiny"]),
        said(c("transaction_atypique"), GROUNDS["odd"]),
        said(c("bien_non_habitable"), GROUNDS["uninhabitable"]),
        said(c("non_disponible"), GROUNDS["taken"]),
        said(home & (c("prix_compare") <= c("surface_bati") * c("median_eur_m2") * 0.55), GROUNDS["low"]),
    )
    risks = F.concat_ws(
        " · ",
        said(c("vente_encheres"), around(RISKS["auction"], F.round("ratio_adjudication", 2))),
        said(c("bien_occupe") & home, RISKS["occupied"]),
        said(c("residence_geree"), RISKS["managed"]),
        said(c("surface_atypique"), RISKS["carrez"]),
        said(c("travaux_probables"), RISKS["works"]),
        said(c("procedure_copropriete"), RISKS["procedure"]),
        said(percent(c("charges_copro_annuelles"), c("surface_bati")) > 35, RISKS["charges"]),
        said(dpe == "G", RISKS["g"]),
        said(dpe == "F", RISKS["f"]),
        said((c("type_bien") == "maison") & c("surface_terrain").isNull(), RISKS["land"]),
        said(c("localisation_approximative"), RISKS["place"]),
        said(business & c("chiffre_affaires").isNull(), RISKS["turnover"]),
        said(business & (percent(c("ebe"), c("chiffre_affaires")) > 0.45), RISKS["ebe"]),
        said(business & (c("poids_loyer_ca") > 0.12), RISKS["rent"]),
    )
    signs = F.concat_ws(
        " · ",
        said(c("baisse_prix_pct") >= 1, around(SIGNALS["drop"], F.round("baisse_prix_pct", 1))),
        said(c("jours_en_ligne") <= 2, SIGNALS["new"]),
        said(c("loyer_reel"), SIGNALS["rent"]),
        said(c("vente_encheres"), SIGNALS["auction"]),
    )
    return df.withColumns({"motif_verification": ground, "risques_evaluation": risks, "signaux": signs})


def analyse_deals(inputs: DataFrame, as_of: Column, assumptions: Assumptions = Assumptions()) -> DataFrame:
    """The whole chain, and the groups of adverts that are one property."""
    from .duplicates import duplicate_groups, representatives

    df = reasons(levels(scores(measures(rents_and_costs(flags(inputs), assumptions), as_of))))
    eligible = c("active").eqNullSafe(False)
    df = df.withColumn("_rounded", F.round("surface_bati"))
    df = duplicate_groups(df, block=["type_bien", "code_postal", "_rounded"], value="prix", tie=["source", "external_id"], ratio=1 + assumptions.same_price, eligible=~eligible & (c("prix") > 0) & (c("surface_bati") > 0) & c("code_postal").isNotNull())
    richness = F.length(F.coalesce("description", lit(""))) + 200 * F.coalesce("image_count", lit(0)) + when(c("lat").isNotNull(), 500).otherwise(0)
    df = representatives(df, group=["type_bien", "code_postal", "_rounded", "group"], richness=richness, tie=["source", "external_id"], source="source")
    return df.drop("_text", "_business", "_nature", "_works", "_heavy", "_usual", "_rounded")


def annuity(rate_percent: Column, years: Column) -> Column:
    """Monthly instalment of a loan of 1; without interest, the loan in equal parts."""
    r, n = rate_percent / 1200, years * 12
    return when(r > 0, F.try_divide(r, 1 - F.pow(1 + r, -n))).otherwise(F.try_divide(lit(1.0), n))


def financing(deals: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Every deal under every scenario (scenarios: name, fees, works, deposit, rate, years; a few rows): the product is
    the result itself. deals: price and rent (a month)."""
    df = deals.crossJoin(F.broadcast(scenarios))
    cost = c("price") * (1 + c("fees") / 100) + c("works")
    df = df.withColumn("cost", cost).withColumn("instalment", c("cost") * (1 - c("deposit") / 100) * annuity(c("rate"), c("years")))
    return df.withColumns({"gross_yield": percent(c("rent") * 1200, c("price")), "cash_flow": c("rent") - c("instalment")})


def negotiation(df: DataFrame, price: str, ceilings: list[str], rent: str) -> DataFrame:
    """For each ceiling the percent to take off the price (0 where it is below already) and the gross yield there."""
    out = {}
    for x in ceilings:
        out[f"cut_{x}"] = F.greatest(lit(0.0), percent((c(price) - c(x)) * 100, c(price)))
        out[f"yield_{x}"] = percent(c(rent) * 1200, c(x))
    return df.withColumns(out)


def yield_band(x: Column) -> Column:
    return when(x >= 10, "exceptionnel").when(x >= 8, "eleve").when(x >= 6, "correct").when(x >= 4, "faible").when(x.isNotNull(), "insuffisant")


def partition_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.withColumn("median", F.percentile(value, lit(0.5)).over(Window.partitionBy(*keys)))
