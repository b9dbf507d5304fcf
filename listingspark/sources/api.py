"""API payloads as bronze rows: three shapes, by projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.normalise import energy_letter

c, lit, when = F.col, F.lit, F.when


def scalar(payload: str, path: str) -> Column:
    """The number at a path; null for ranges."""
    return F.get_json_object(payload, path).try_cast("double")


def span(payload: str, path: str) -> Column:
    """The text of a range given as an array; null for numbers."""
    text = F.get_json_object(payload, path)
    return when(text.startswith("["), F.array_join(F.from_json(text, "array<string>"), " – "))


def details(**values: Column) -> Column:
    """A JSON object of the values that aren't null or empty; underscores stand for blanks."""
    return F.to_json(F.struct(*[F.nullif(v.cast("string"), lit("")).alias(k) for k, v in values.items()]))


def search_adverts(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Adverts of a search API, one JSON text a row."""
    g = lambda path: F.get_json_object(payload, f"$.{path}")
    radius = g("blurInfo.radius").try_cast("double")
    blurred = (F.coalesce(g("blurInfo.type"), lit("")) != "exact") & (radius.isNull() | (radius > 150))
    day = g("publicationDate").try_cast("timestamp")
    photos = F.from_json(g("photos"), "array<struct<url:string>>")
    ranges = [span(payload, f"$.{p}") for p in ("price", "surfaceArea", "roomsQuantity")]
    return payloads.select(
        g("id").alias("id"), g("title").alias("name"), scalar(payload, "$.price").alias("price"), scalar(payload, "$.surfaceArea").alias("surface"), scalar(payload, "$.landSurfaceArea").alias("land_surface"),
        scalar(payload, "$.roomsQuantity").alias("rooms"), scalar(payload, "$.bedroomsQuantity").alias("bedrooms"), g("postalCode").alias("zipcode"), g("city").alias("city"),
        F.coalesce(g("blurInfo.position.lat"), g("blurInfo.centroid.lat")).try_cast("double").alias("lat"), F.coalesce(g("blurInfo.position.lon"), g("blurInfo.centroid.lon")).try_cast("double").alias("lng"),
        F.concat_ws("/", F.coalesce(g("propertyType"), lit("")), F.lower(F.coalesce(g("adTypeFR"), lit("")))).alias("type_hint"), g("description").alias("body"), g("accountDisplayName").alias("seller_name"), g("accountType").alias("seller_type"),
        energy_letter(g("energyClassification")).alias("dpe"), energy_letter(g("greenhouseGazClassification")).alias("ges"), F.coalesce(F.size(photos), lit(0)).cast("long").alias("image_count"),
        when(F.year(day) >= 1990, day).alias("published_at"), g("reference").alias("reference_annonce"), F.to_json(F.transform(photos, lambda x: x["url"])).alias("images_json"),
        details(**{
            "Précision cartographique": when(blurred, "approximative"), "Rayon de floutage (m)": when(blurred, radius), "Fourchette de prix": ranges[0], "Fourchette de surface": ranges[1], "Fourchette de pièces": ranges[2],
            "Lots multiples": when(F.coalesce(*ranges).isNotNull(), "oui"), "Charges annuelles de copropriété": g("annualCondominiumFees"), "Viager": when(F.coalesce(g("lifeAnnuityMonthlyAllowance"), g("lifeAnnuityAgeOfMan")).isNotNull(), "oui"),
            "Loyer annuel": F.coalesce(scalar(payload, "$.annualRent"), scalar(payload, "$.rent") * 12), "Taxe foncière": scalar(payload, "$.propertyTax"), "Chiffre d'affaires": scalar(payload, "$.turnover"),
        }).alias("details_json"),
    )


#: Sale modes of the notaries' API.
NOTARY = {("VAE", "JUDICIAIRE"): "enchere_judiciaire", ("VAE", "VOLONTAIRE"): "enchere_notariale", ("VNI", None): "vente_interactive", ("VENTE", None): "gre_a_gre"}


def notary_adverts(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Adverts of the notaries' API: total prices, sale modes, auction dates."""
    g = lambda path: F.get_json_object(payload, f"$.{path}")
    mode = lit(None).cast("string")
    for (kind, sort), name in NOTARY.items():
        mode = F.coalesce(when((g("typeTransaction") == kind) & (lit(True) if sort is None else g("typeAdjudication") == sort), name), mode)
    return payloads.select(
        g("annonceId").alias("id"), F.coalesce(scalar(payload, "$.prixTotal"), scalar(payload, "$.prixAffiche"), scalar(payload, "$.premiereOffrePossible")).alias("price"), scalar(payload, "$.surface").alias("surface"), scalar(payload, "$.surfaceTerrain").alias("land_surface"),
        g("nbPieces").alias("rooms"), g("nbChambres").alias("bedrooms"), g("codePostal").alias("zipcode"), F.coalesce(g("communeNom"), g("localiteNom")).alias("city"), g("typeBien").alias("type_hint"), g("descriptionFr").alias("body"),
        g("urlDetailAnnonceFr").alias("url"), g("reference").alias("reference_annonce"), g("nbPhoto").alias("image_count"), F.coalesce(mode, lit("gre_a_gre")).alias("mode_vente"), F.coalesce(g("seanceDate"), g("dateFinEncheres")).alias("date_vente"), g("dateCreation").alias("published_at"),
    )


def attribute_adverts(df: DataFrame, attributes: str = "attributes") -> DataFrame:
    """Adverts whose attributes are an array of key and value: the named ones become columns."""
    m = F.map_from_entries(F.transform(attributes, lambda x: F.struct(x["key"], x["value"])))
    at = lambda k: F.try_element_at(m, lit(k))
    return df.withColumns({"surface": at("square").try_cast("double"), "rooms": at("rooms"), "land_surface": at("land_plot_surface").try_cast("double"), "type_hint": at("real_estate_type"), "dpe": energy_letter(at("energy_rate"))}).drop(attributes)


def sale_lots(pages: DataFrame) -> DataFrame:
    """Auction notices(url, html): a row for each lot, with status, reserve, hammer price, court, date, surface, type."""
    from ..functions import text_fr as t
    from .pages import html_to_text

    df = pages.select("url", html_to_text(c("html")).alias("text"))
    lots = F.filter(F.split("text", r"(?i)(?=\blot(?: n°| numero)? ?\d+\b)"), lambda x: F.length(F.trim(x)) > 0)
    titled = F.when(F.size(lots) > 1, F.filter(lots, lambda x: x.rlike(r"(?i)^\s*lot"))).otherwise(F.array(c("text")))
    df = df.select("url", "text", F.size(titled).alias("n"), F.posexplode(titled).alias("pos", "lot"))
    # each text that is looked at often is a column of its own before, so that it is made once
    said = lambda p: t.first_of(c("_folded"), rf"(?:{p})[^\d]{{0,25}}(\d[\d ., ]*(?: ?€| ?euros?)?)")
    day = t.first_of(c("text"), r"(?i)((?:lundi|mardi|mercredi|jeudi|vendredi|samedi|dimanche)[^\n]{5,40})")
    df = df.withColumn("_folded", t.fold(c("lot")))
    df = df.withColumns({"_reserve": said("mise a prix"), "_hammer": said("adjuge[e]?(?: a| pour)?|prix d.adjudication"), "_day": t.fold(day)})
    df = df.withColumn("_hammer", t.amount(c("_hammer")))
    return df.select(
        when(c("n") > 1, F.concat_ws("-", "url", (c("pos") + 1).cast("string"))).otherwise(c("url")).alias("id"), "url", t.amount(c("_reserve")).alias("price"), c("_hammer").alias("prix_adjuge"), t.auction_status(c("lot"), c("_hammer")).alias("statut"),
        t.first_of(c("text"), r"(?i)tribunal judiciaire (?:de |d')([\p{L}\- ]+)").alias("court"), t.parse_date(c("_day")).alias("date_vente"),
        t.surface_m2(c("lot")).alias("surface"), t.rooms(c("lot")).alias("rooms"), t.type_from_text(c("lot")).alias("type_hint"), t.occupancy(c("lot")).alias("occupation"),
    )
