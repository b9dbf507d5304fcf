"""Bronze to silver: one projection with a profile for each kind of source, and clean-up rules over bronze rows."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text_fr import fold
from .tables import ensure_columns, latest_per_key, upsert

c, lit, when = F.col, F.lit, F.when

#: Types of property.
TYPES = ("appartement", "maison", "immeuble", "terrain", "local_commercial", "fonds_commerce", "bureau", "autre")

#: Silver columns that keep the old value where a new one is null, and those only set on insert.
POLICY = {"first_seen_at": "insert", "published_at": "keep"}

STRINGS = T.StructType([T.StructField(n, T.StringType()) for n in "id name price surface land_surface rooms bedrooms zipcode city lat lng type_hint url body seller_name seller_type dpe ges published_at details_json images_json reference_annonce mode_vente date_vente prix_adjuge _collected_at image_count".split()])


@dataclass(frozen=True)
class Profile:
    """How a kind of source says category, type and sale mode."""

    hint: str = "canonical"  # canonical: the hint is the type; split: '<category> <type>'; labels: looked up; keywords
    labels: dict[str, str] = field(default_factory=dict)
    keywords: dict[str, str] = field(default_factory=dict)
    rental: str | None = None  # pattern of hints and urls of rentals
    auction_mode: str | None = None  # sale mode where an auction source gives none
    keep: tuple[str, ...] = ()  # further columns that keep old values
    repair_surface: bool = False  # a surface above 500 equal to the land, or without rooms, is land


PROFILES = {
    "canonical": Profile(),
    "professional": Profile(hint="split"),
    "auction": Profile(hint="split", auction_mode="enchere_judiciaire"),
    "interactive_auction": Profile(hint="split", auction_mode="vente_interactive"),
    "public_sale": Profile(hint="split", auction_mode="cession_publique"),
    "notary": Profile(hint="labels", labels={"APP": "appartement", "MAI": "maison", "IMM": "immeuble", "TER": "terrain", "FON": "fonds_commerce", "COM": "local_commercial", "BUR": "bureau"}, keep=("lat", "lng", "dpe", "ges")),
    "search_api": Profile(hint="labels", labels={"flat": "appartement", "house": "maison", "building": "immeuble", "terrain": "terrain", "shop": "local_commercial", "premises": "local_commercial", "office": "bureau"}, rental=r"location|rent"),
    "attributes": Profile(hint="labels", labels={"1": "maison", "2": "appartement", "3": "terrain", "4": "local_commercial", "5": "local_commercial"}),
    "labels": Profile(hint="labels", labels={t: t for t in TYPES} | {"villa": "maison", "studio": "appartement", "loft": "appartement", "commerce": "local_commercial"}, repair_surface=True),
    "keywords": Profile(hint="keywords", keywords={"fonds_commerce": r"fonds de commerce|cession", "bureau": r"bureau", "local_commercial": r"local|boutique|murs|commerce", "immeuble": r"immeuble", "terrain": r"terrain"}),
}


def kind_of(profile: Profile) -> Column:
    hint = F.lower(F.coalesce("type_hint", lit("")))
    match profile.hint:
        case "split":
            kind = F.split_part(hint, lit(" "), lit(2))
        case "labels":
            key = F.split_part(hint, lit("/"), lit(1))
            trade = fold(F.concat_ws(" ", hint, "name")).rlike("fonds|cession de bail")
            kind = reduce(lambda a, kv: when(key == kv[0].lower(), kv[1]).otherwise(a), profile.labels.items(), lit("autre"))
            kind = when(trade & (kind == "local_commercial"), "fonds_commerce").otherwise(kind)
        case "keywords":
            text = fold(F.concat_ws(" ", hint, "url", "name", "body"))
            kind = reduce(lambda a, kv: when(text.rlike(kv[1]), kv[0]).otherwise(a), reversed(profile.keywords.items()), lit("autre"))
        case _:
            kind = hint
    return when(kind.isin(*TYPES), kind).otherwise("autre")


def normalise(bronze: DataFrame, source: str, profile: Profile, as_of: Column) -> DataFrame:
    """Silver rows of a source: typed, the latest observation of each id. Values that can't be read are null."""
    df = ensure_columns(bronze, STRINGS).filter("id is not null")
    df = df.withColumn("_at", F.coalesce(c("_collected_at").try_cast("timestamp"), as_of))
    df = latest_per_key(df.withColumn("id", c("id").cast("string")), ["id"], [F.desc("_at")])
    number = lambda name: c(name).cast("string").try_cast("double")
    whole = lambda name: c(name).cast("string").try_cast("double").cast("int")
    full = lambda name: F.nullif(c(name).cast("string"), lit(""))
    split = F.split_part(F.lower(F.coalesce("type_hint", lit(""))), lit(" "), lit(1)) == "location" if profile.hint == "split" else lit(False)
    rental = split | (F.lower(F.concat_ws(" ", "type_hint", "url")).rlike(profile.rental) if profile.rental else lit(False))
    df = df.withColumns({"_kind": kind_of(profile), "_rental": rental, "_surface": number("surface"), "_land": number("land_surface")})
    plot = c("_kind") == "terrain"
    if profile.repair_surface:
        plot = plot | ((c("_surface") > 500) & (c("_surface").eqNullSafe(c("_land")) | number("rooms").isNull()))
    mode = F.coalesce(full("mode_vente"), lit(profile.auction_mode)) if profile.auction_mode else full("mode_vente")
    day = c("date_vente").try_cast("timestamp")
    return df.select(
        lit(source).alias("source"), c("id").alias("external_id"), when(c("_rental"), "location").otherwise("vente").alias("categorie"), c("_kind").alias("type_bien"),
        when(~c("_rental"), number("price")).alias("prix"), when(c("_rental"), number("price")).alias("loyer"),
        when(~plot, c("_surface")).alias("surface_bati"), when(plot, F.coalesce("_land", "_surface")).otherwise(c("_land")).alias("surface_terrain"),
        full("zipcode").alias("code_postal"), full("city").alias("ville"), number("lat").alias("lat"), number("lng").alias("lng"), c("name").alias("titre"), "url",
        c("_at").alias("collected_at"), c("_at").alias("first_seen_at"), c("_at").alias("last_seen_at"),
        (F.coalesce(day >= as_of - F.expr("interval 1 day"), lit(True)) if profile.auction_mode else lit(True)).alias("active"),
        c("body").alias("description"), whole("rooms").alias("nb_pieces"), whole("bedrooms").alias("nb_chambres"), full("dpe").alias("dpe"), full("ges").alias("ges"),
        "seller_type", "seller_name", whole("image_count").alias("image_count"), c("published_at").try_cast("timestamp").alias("published_at"), "details_json", "images_json", "reference_annonce",
        mode.alias("mode_vente"), day.alias("date_vente"), number("prix_adjuge").alias("prix_adjuge"),
    )


def merge_source(silver: DataFrame | None, incoming: DataFrame, profile: Profile) -> DataFrame:
    return incoming if silver is None else upsert(silver, incoming, ["source", "external_id"], POLICY | dict.fromkeys(profile.keep, "keep"))


def drop_rentals(silver: DataFrame) -> DataFrame:
    """Rentals other than of businesses and shops aren't kept."""
    return silver.filter("categorie <> 'location' or type_bien in ('fonds_commerce', 'local_commercial')")


def drop_urls(silver: DataFrame, source: str, pattern: str) -> DataFrame:
    return silver.filter(~((c("source") == source) & F.coalesce(c("url").rlike(pattern), lit(False))))


def impute_postcode(silver: DataFrame, sales: DataFrame, department: Column | None = None) -> DataFrame:
    """Missing postcodes from the sales of the commune of that folded name: the most frequent one there, ties the least. A
    department (of the details, say) narrows the choice; where it isn't known and several departments have such a commune,
    the least department's is taken. sales: code_postal, commune."""
    named = sales.filter("code_postal is not null").select(fold(F.trim("commune")).alias("_town"), F.substring("code_postal", 1, 2).alias("_dept"), c("code_postal").alias("_code"))
    modes = latest_per_key(named.groupBy("_town", "_dept", "_code").count(), ["_town", "_dept"], [F.desc("count"), F.asc("_code")]).drop("count")
    any_dept = modes.groupBy("_town").agg(F.min_by("_code", "_dept").alias("_any"))
    known = lit(None).cast("string") if department is None else department
    df = silver.withColumns({"_town": when(c("code_postal").isNull(), fold(F.trim("ville"))), "_dept": known})
    df = df.join(modes, ["_town", "_dept"], "left").join(any_dept, "_town", "left")
    code = F.coalesce("code_postal", when(c("_dept").isNotNull(), c("_code")).otherwise(c("_any")))
    return df.withColumn("code_postal", code).select(*silver.columns)


def auction_matches(silver: DataFrame, key: Column) -> DataFrame:
    """Pairs of one auction on two sites: equal keys, a row for each group with its listings."""
    return silver.filter("mode_vente is not null").withColumn("key", key).filter("key is not null").groupBy("key").agg(F.array_sort(F.collect_set(F.struct("source", "external_id"))).alias("listings")).filter(F.size("listings") > 1)


# Clean-up rules: each takes and gives bronze rows.


def unit_price(df: DataFrame, price: str = "price", surface: str = "surface") -> DataFrame:
    """A price under 10 000 and under 50 times the surface, or said to be by square metre or period, is no total."""
    said = F.lower(F.coalesce("price_text", lit(""))).rlike(r"/\s*m|m²|m2|par an|/\s*an|par mois|/\s*mois") if "price_text" in df.columns else lit(False)
    unit = said | F.coalesce((c(price) < 10000) & (c(price) < c(surface) * 50), lit(False))
    return df.withColumns({"unit_price": when(unit, c(price)), price: when(~unit, c(price))})


def total_from_unit(df: DataFrame, divisible: Column, price: str = "price", surface: str = "surface") -> DataFrame:
    return df.withColumn(price, F.coalesce(c(price), when(~F.coalesce(divisible, lit(False)), c("unit_price") * c(surface))))


def approximate_location(kind: Column, radius: Column, lat: Column, lng: Column) -> Column:
    """Whether a place is blurred: not exact and of an unknown radius or one above 150 m, or of two decimals or fewer."""
    coarse = (F.round(lat, 2) == lat) & (F.round(lng, 2) == lng)
    return ((F.coalesce(kind, lit("")) != "exact") & (radius.isNull() | (radius > 150))) | F.coalesce(coarse, lit(False))


def in_scope(text: Column, status: Column) -> Column:
    t = fold(text)
    return ~F.coalesce(t.rlike(r"programme neuf|parking|garage\b|\bbox\b"), lit(False)) & ~F.coalesce(fold(status).rlike(r"vendu|retire|loue"), lit(False))


def annual(value: Column, period: Column) -> Column:
    return when(fold(period).rlike("mois|mensuel"), value * 12).otherwise(value)


def land_not_surface(df: DataFrame, kind: str = "type_hint") -> DataFrame:
    same = c(kind).isin("appartement", "immeuble") & (c("land_surface") == c("surface"))
    return df.withColumn("land_surface", when(~F.coalesce(same, lit(False)), c("land_surface")))


def business_price(price: Column, walls: Column, included: Column) -> Column:
    return when(F.coalesce(included, lit(False)), price - walls).when(~price.eqNullSafe(walls), price)


def energy_letter(x: Column) -> Column:
    u = F.upper(F.trim(x.cast("string")))
    return when(u.rlike("^[A-G]$"), u).when(u.rlike("^[1-7]$"), F.translate(u, "1234567", "ABCDEFG"))


def life_annuity(text: Column) -> Column:
    return fold(text).rlike(r"viager|bouquet|rente viagere")


def occupied(badge: Column, tenant: Column, rent: Column, text: Column) -> Column:
    free = fold(text).rlike(r"\blibre\b")
    return ~F.coalesce(free, lit(False)) & (F.coalesce(fold(badge).rlike("occupe|loue"), lit(False)) | tenant.isNotNull() | F.coalesce(rent > 0, lit(False)))


def not_older(df: DataFrame, posted: str, as_of: Column, days: int) -> DataFrame:
    return df.filter(c(posted).isNull() | (F.datediff(as_of, c(posted)) <= days))


def owner_share(share: Column, whole: Column) -> Column:
    return F.coalesce(share, whole)
