"""Financial figures of advert texts and their structured details, as Column expressions.

An amount belongs to the keyword before it if no other money word stands between: one pattern whose gap may not start
such a word says so. Sentences that speak of possible figures are left out before anything is searched in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text_fr import amount, first_of, fold, json_text

# Words that give an amount another meaning, and words of sentences that only suppose.
OTHER_MONEY = r"prix|honoraires|frais|depot|caution|charges|taxe|bouquet|valeur"
SUPPOSED = r"potentiel|estim|possible|envisag|pourrait|projection|prevision|simulation|colocation|location saisonniere|airbnb|courte duree|apres travaux|objectif|jusqu.a"
MONEY = r"\d[\d ., ]*(?:k|m|millions?|milliers?)?\s*(?:€|euros?|eur\b)"
RENT = r"(?<!sans )(?<!hors )\b(?:loyers?|revenus? locatifs?|loues?|louees?|rapportant|rapporte)\b(?!\s+(?:potentiel|estime|envisage|possible|de marche))"
MONTHLY, YEARLY = r"mois\b|mensuel|/m\b", r"/\s*an\b|par an\b|annuel|l.an\b|annee"

# Keys of the details that stand above the text, and keywords of amounts with their windows.
STRUCTURED = {"loyer_annuel_declare": "Loyer annuel", "rendement_declare": "Rentabilité brute", "chiffre_affaires": "Chiffre d'affaires", "ebe": "EBE", "resultat": "Résultat net", "taxe_fonciere": "Taxe foncière", "charges_copro_annuelles": "Charges annuelles de copropriété", "travaux_annonces": "Travaux à prévoir"}
AFTER = {
    "chiffre_affaires": (r"chiffre d.affaires?(?: annuel)?(?: ht)?(?: \d{4})?|\bc\.?a\.?(?: ht)?(?: \d{4})?\s*[:=]", 60),
    "ebe": (r"\bebe\b|excedent brut d.exploitation", 60),
    "resultat": (r"resultat (?:net|d.exploitation|courant)|benefice(?: net)?", 60),
    "taxe_fonciere": (r"taxe fonciere", 40),
    "travaux_annonces": (r"travaux (?:a prevoir|estimes?|chiffres?|evalues?)(?: a)?", 50),
}
LET = r"vendu[es]? loue|actuellement loue|deja loue|bien loue|murs (?:loues|occupes)|locataires? en place|(?<!aucun )(?<!pas de )(?<!sans )bail (?:en cours|commercial en cours|3.6.9)|occupe par|investissement locatif cle en main|loyer (?:actuel|en place|percu)"
BLOCK_OF_FLATS = r"immeuble de rapport|immeuble (?:entierement |integralement )?loue|vendu en bloc|vente en bloc|immeuble (?:de|compose de|comprenant) \d+ (?:appartements|logements|studios)|(?:ensemble|immeuble) (?:de|compose de|comprenant) (?:plusieurs|\d+) (?:appartements|logements)"
BUSINESS = r"fonds? de commerce|cession de fonds|vente (?:du|d.un) fonds|droit au bail|pas.de.porte|cession de bail|fonds a ceder|cede (?:son|le) fonds|licence (?:iv|4)|clientele|chiffre d.affaires|\bebe\b|affaire a reprendre|reprise d.activite"
BUSINESS_TITLE = r"^vente (?:bar|restaurant|restauration|hotel|tabac|boulangerie|boucherie|coiffure|esthetique|pressing|epicerie|fleuriste|pizzeria|camping|commerce|fonds)"
WALLS = r"murs (?:commerciaux|occupes|loues|libres|d.un|de la|du)|vente des murs|vendus? (?:avec|sans) (?:le )?fonds|investissement (?:locatif|murs)|locataire en place"
BOTH = r"murs et (?:le )?fonds|fonds et (?:les )?murs"
FARM = r"haras|equestre|ecurie|corps de ferme|exploitation agricole|batiment agricole|hangar|grange|elevage"
INDUSTRY = r"activite|entrepot|atelier|bureaux|industriel|logistique|stockage"


def gap(window: int, without: str = OTHER_MONEY) -> str:
    return rf"(?:(?!{without})[\s\S]){{0,{window}}}?"


def amount_after(text: Column, keyword: str, window: int = 90) -> Column:
    """The first amount within ``window`` characters of a keyword, no other money word between."""
    return amount(first_of(text, rf"(?:{keyword}){gap(window)}({MONEY})"))


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"[\n!]|\.(?!\d)"), lambda s: ~s.rlike(SUPPOSED))


def declared_rent(text: Column, price: Column) -> Column:
    """Yearly rent: monthly amounts times twelve; without a unit whichever reading yields 2.5 to 20 percent of the price if
    only one does. Of the plausible ones (1.5 to 25 percent) the greatest, as totals come with their parts. The amount may
    stand in the sentence after its keyword; the keyword's own sentence tells whether it only supposes."""
    # the text from each keyword on, with its sentence's part before it: pieces between the ends of keywords
    ends = F.regexp_replace(text, F.lit(rf"({RENT})"), F.lit("$1\x01"))
    pieces = F.split(ends, "\x01")
    places = F.transform(
        F.slice(pieces, 1, F.size(pieces) - 1),
        lambda p, i: F.struct(
            F.concat(F.regexp_extract(F.array_join(F.slice(pieces, F.greatest(i - 3, F.lit(0)) + 1, F.least(i, F.lit(3)) + 1), ""), r"([^.\n!]*)$", 1), F.regexp_extract(F.array_join(F.slice(pieces, i + 2, 4), ""), r"^([^.\n]*)", 1)).alias("sentence"),
            F.substring(F.array_join(F.slice(pieces, i + 2, 12), ""), 1, 150).alias("after"),
        ),
    )
    sure = F.filter(places, lambda x: ~x["sentence"].rlike(SUPPOSED))
    found = F.filter(F.transform(sure, lambda x: F.regexp_extract(x["after"], rf"^({gap(90, OTHER_MONEY + '|marche')}{MONEY}.{{0,30}})", 1)), lambda s: s != "")
    usual = lambda x: F.try_divide(x, price).between(0.025, 0.20)

    def annual(said: Column) -> Column:
        x = amount(first_of(said, rf"({MONEY})"))
        return F.when(said.rlike(MONTHLY), x * 12).when(said.rlike(YEARLY), x).when(usual(x * 12) & ~usual(x), x * 12).when(usual(x) & ~usual(x * 12), x)

    return F.array_max(F.filter(F.transform(found, annual), lambda x: F.try_divide(x, price).between(0.015, 0.25)))


def declared_percent(text: Column, keyword: str) -> Column:
    """A percentage of 1.5 to 25 next to the keyword, after it or before."""
    number = r"(\d{1,2}(?:[.,]\d{1,2})?)\s*%"
    both = F.flatten(F.transform(sentences(text), lambda s: F.concat(F.regexp_extract_all(s, F.lit(rf"(?:{keyword})[^%\d]{{0,40}}?{number}"), F.lit(1)), F.regexp_extract_all(s, F.lit(rf"{number}[^.\n]{{0,25}}?(?:{keyword})"), F.lit(1)))))
    return F.get(F.filter(F.transform(both, lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("double")), lambda x: x.between(1.5, 25)), 0)


def detail_number(details: Column, *names: str) -> Column:
    """The number at the first of the keys that has one."""
    def one(name: str) -> Column:
        digits = F.replace(F.regexp_replace(json_text(details, name), r"[^\d,.]", ""), F.lit(","), F.lit("."))
        return digits.try_cast("double")

    return F.coalesce(*map(one, names))


def segment_of(kind: Column, text: Column, block: Column) -> Column:
    """The strategy that applies, whatever the source calls the property."""
    trade = kind.isin("local_commercial", "bureau", "autre")
    business = (text.rlike(BUSINESS) | text.rlike(BUSINESS_TITLE)) & (~text.rlike(WALLS) | text.rlike(BOTH))
    farm = F.substring(text, 1, 400).rlike(FARM)
    titled = text.rlike(r"^(?:vente )?immeuble") & ~F.substring(text, 1, 300).rlike(INDUSTRY)
    return (
        F.when(kind == "fonds_commerce", "fonds").when(kind.isin("terrain", "immeuble"), kind)
        .when(trade & business, "fonds").when(trade & farm, "autre").when((kind == "autre") & (block | titled), "immeuble").when(kind.isin("local_commercial", "bureau"), "murs")
        .when(kind.isin("appartement", "maison") & block & text.rlike(r"^(?:vente )?(?:immeuble|ensemble)|immeuble de rapport|en bloc"), "immeuble")
        .when(kind.isin("appartement", "maison"), "residentiel").otherwise("autre")
    )


def extract_finance(listings: DataFrame) -> DataFrame:
    """source, external_id, fingerprint and the finance record of each listing(titre, description, details_json, prix,
    type_bien). Details stand above the text; figures out of scale are dropped."""
    c = F.col
    text = fold(F.concat_ws(" ", F.nullif("titre", F.lit("")), F.nullif("description", F.lit(""))))
    df = listings.select("source", "external_id", "prix", "type_bien", "details_json", text.alias("t"), F.xxhash64(F.lit(1), "titre", "description", "details_json", "prix", "type_bien").alias("fingerprint"))
    d, t = c("details_json"), c("t")
    monthly = detail_number(d, "Loyer hors charges mensuel")
    said = {k: amount_after(t, *v) for k, v in AFTER.items()}
    said["loyer_annuel_declare"] = F.when(c("prix").isNotNull(), F.coalesce(monthly * 12, declared_rent(t, c("prix"))))
    said["rendement_declare"] = declared_percent(t, r"rentabilite|rendement|renta\b")
    said["charges_copro_annuelles"] = F.coalesce(detail_number(d, "Montant des charges prévisionnelles annuelles moyen"), detail_number(d, "Charges mensuelles copro") * 12)
    structured = {k: F.when(detail_number(d, name) > 0, detail_number(d, name)) for k, name in STRUCTURED.items()}
    lots = first_of(t, r"(\d{1,2})\s+(?:lots|appartements|logements|studios)\b").try_cast("int")
    let = t.rlike(LET) | F.coalesce(F.lower(json_text(d, "Occupé")).startswith("oui"), F.lit(False)) | F.coalesce(F.lower(d).contains("murs occupés"), F.lit(False))
    df = df.withColumns({k: F.coalesce(structured[k], said[k]) for k in STRUCTURED} | {"nb_lots": F.when(lots.between(2, 60), lots), "immeuble_rapport": t.rlike(BLOCK_OF_FLATS), "_let": let, "droit_au_bail": t.rlike(r"droit au bail|cession de bail")})
    business = c("type_bien") == "fonds_commerce"
    let = c("_let") | (~business & structured["loyer_annuel_declare"].isNotNull())
    rent = F.coalesce("loyer_annuel_declare", F.when(c("_let"), c("prix") * c("rendement_declare") / 100))
    df = df.withColumns({"segment": segment_of(c("type_bien"), t, c("immeuble_rapport")), "_let": let, "loyer_annuel_declare": rent})
    ratio = F.try_divide("loyer_annuel_declare", "prix")
    turnover = F.when(F.coalesce(F.try_divide("prix", "chiffre_affaires").between(0.05, 20), F.lit(True)), c("chiffre_affaires"))
    return df.withColumn("chiffre_affaires", turnover).select(
        "source", "external_id", "fingerprint",
        F.when(business | F.coalesce(ratio.between(0.015, 0.25), F.lit(True)), c("loyer_annuel_declare")).alias("loyer_annuel_declare"),
        "rendement_declare", "chiffre_affaires", F.when(c("chiffre_affaires").isNull() | (c("ebe") <= c("chiffre_affaires")), c("ebe")).alias("ebe"), "resultat",
        F.when(c("taxe_fonciere").between(50, 60000), c("taxe_fonciere")).alias("taxe_fonciere"), "charges_copro_annuelles",
        F.when(c("prix").isNull() | (c("travaux_annonces") <= c("prix") * 1.5), c("travaux_annonces")).alias("travaux_annonces"),
        "nb_lots", (c("_let") & (c("segment") != "fonds")).alias("bien_loue"), "immeuble_rapport", "droit_au_bail", "segment",
    )
