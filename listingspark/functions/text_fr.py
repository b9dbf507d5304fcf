"""French advert texts: folding, flags, amounts, dates, surfaces, types. All are Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with marks and the letters they fold to.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝŸ "
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUYY "

# Patterns of folded advert texts.
FLAGS = {
    "atypique": r"viager|bouquet|rente viag|nue.?propriete|vente a terme|parts sociales|quote.?part|usufruit",
    "enchere": r"adjudication|enchere|mise a prix|vente interactive",
    "non_habitable": r"ancien garage|garage.?atelier|garages attenants|plateau brut|plateaux.{0,50}a rendre habitable|a rendre habitable|volume brut|local a transformer|transformation complete en espace habitable|a transformer en habitation|changement de destination|raccordement.{0,40}a prevoir|assainissement.{0,40}a prevoir|pouvant etre transforme|transformable en (?:habitation|logement)|a amenager entierement|grange a renover|ruine",
    "non_disponible": r"compromis en cours|sous compromis|sous offre|offre acceptee|vente realisee|bien vendu",
    "occupe": r"vendu loue|vendue louee|vendus loues|vendues louees|bien occupe|logement occupe|occupes par un|occupees par un|locataire en place|locataires en place|bail en cours",
    "residence_geree": r"residence (?:hoteliere|seniors?|services?|etudiante|de tourisme|d.affaires|de vacances|geree)|ehpad|loyer garanti|lmnp|lmp\b|bail commercial (?:avec|aupres d)",
    "travaux_lourds": r"a renover entierement|renovation complete|rehabilitation|gros travaux|refection complete|entierement a renover|tout a refaire|a restaurer|gros oeuvre|toiture a refaire",
    "travaux": r"a renover|a finir de renover|travaux.{0,60}a prevoir|travaux restants|quelques travaux|necessitant.{0,30}travaux|renovation.{0,40}a prevoir|renovation complete|rehabilitation|gros travaux|refection complete|remise au gout|a rafraichir",
    "sans_travaux": r"aucuns? travaux|sans travaux|pas de travaux|aucun gros travaux|travaux (?:deja )?realises|travaux recents|entierement renove|refait a neuf|renove recemment|renovation recente",
    "surface_atypique": r"loi carrez.{0,80}loggia|loggia.{0,80}loi carrez|ancienne loggia",
    "murs_et_fonds": r"murs et (?:le )?fonds|fonds et (?:les )?murs|murs inclus",
}

# Words of a property's type in folded texts.
TYPES = (
    (r"fonds? de commerce|droit au bail", "fonds_commerce"),
    (r"local (?:a usage )?d'habitation|chambre de service|\bchambres? independante", "appartement"),
    (r"(?:batiment|immeuble|ensemble immobilier) a usage (?:commercial|industriel|professionnel|de bureaux?)", "local_commercial"),
    (r"\bappartements?\b|\bstudios?\b|\bduplex\b|\btriplex\b|\blogements?\b|\bt[1-6]\b|\bf[1-6]\b", "appartement"),
    (r"\bmaisons?\b|\bpavillons?\b|\bvillas?\b|\bproprietes?\b|\bfermes?\b|\blongeres?\b|\bmas\b|\bchalets?\b|\bbastides?\b|\bmoulin\b|\bchateau\b", "maison"),
    (r"\bimmeubles?\b|\bbatiments?\b|ensemble immobilier", "immeuble"),
    (r"\bterrains?\b|\bparcelles?\b|\bbois\b|\bvignes?\b|\bpres?\b|\bterres\b|\bforet\b", "terrain"),
    (r"\bbureaux?\b|\bplateau de bureaux", "bureau"),
    (r"\blocal\b|\blocaux\b|\bcommerces?\b|\bboutiques?\b|\bentrepots?\b|\bhangars?\b|\bateliers?\b|\bhotel\b|\brestaurant\b|murs commerciaux|\bcommercial\b|\bindustriel", "local_commercial"),
    (r"\bparkings?\b|\bbox\b|\bgarages?\b|\bcaves?\b|\bemplacements?\b|\bstationnement", "autre"),
)

# Months.
MONTHS = {"janvier": 1, "fevrier": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7, "aout": 8, "septembre": 9, "octobre": 10, "novembre": 11, "decembre": 12}


def fold(text: Column) -> Column:
    """Lower case without marks, hard blanks as blanks."""
    return F.lower(F.translate(text, MARKED, PLAIN))


def quick(pattern: str) -> str:
    """The pattern behind a look at the letter that each of its alternatives begins with, so that other places of a text are
    passed by at once; the pattern itself where one doesn't begin with a letter."""
    firsts, depth, at = set(), 0, True
    for x in pattern:
        if at:
            firsts.add(x)
        depth += (x == "(") - (x == ")")
        at = x == "|" and depth == 0
    return f"(?=[{''.join(sorted(firsts))}])(?:{pattern})" if all("a" <= x <= "z" for x in firsts) else pattern


def json_text(details: Column, key: str) -> Column:
    """Text at a top-level key; null for texts that aren't JSON."""
    return F.get_json_object(details, f"$['{key}']")


def first_of(text: Column, pattern: str, group: int = 1) -> Column:
    """The group's first match, null without one."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def to_double(text: Column) -> Column:
    return text.try_cast("double")


def amount(text: Column) -> Column:
    """A French or English amount: blanks part thousands; of comma and point the last is the decimal mark, unless three
    digits follow it and no other mark is there. k, M, milliers and millions multiply."""
    t = fold(text)
    number = first_of(t, r"(\d[\d ., ]*)")
    digits = F.regexp_replace(number, r"[  ]", "")
    digits = F.regexp_replace(digits, r"[.,]+$", "")
    decimals = first_of(digits, r"[.,](\d+)$")
    marks = F.length(digits) - F.length(F.translate(digits, ".,", ""))
    whole = decimals.isNull() | ((F.length(decimals) == 3) & (marks == 1)) | ((F.length(decimals) == 3) & ~(digits.contains(".") & digits.contains(",")))
    plain = F.translate(digits, ".,", "")
    value = F.when(whole, to_double(plain)).otherwise(to_double(F.concat(F.translate(F.regexp_replace(digits, r"[.,]\d+$", ""), ".,", ""), F.lit("."), decimals)))
    unit = first_of(t, r"\d[\d .,]*\s*(millions?|milliers?|k|m)(?![a-z0-9²])")
    return value * F.when(unit.startswith("million") | (unit == "m"), 1e6).when(unit.startswith("millier") | (unit == "k"), 1e3).otherwise(1.0)


def surface_m2(text: Column) -> Column:
    return amount(first_of(fold(text), r"(\d[\d .,]*)\s*m(?:2|²)"))


def cadastral_m2(text: Column) -> Column:
    """Hectares, ares and centiares as square metres; null if none is named."""
    t = fold(text)
    part = lambda unit: to_double(first_of(t, rf"(\d+)\s*{unit}\b"))
    ha, a, ca = part("ha"), part("a"), part("ca")
    total = F.coalesce(ha * 10000, F.lit(0.0)) + F.coalesce(a * 100, F.lit(0.0)) + F.coalesce(ca, F.lit(0.0))
    return F.when(ha.isNotNull() | a.isNotNull() | ca.isNotNull(), total)


def parse_date(text: Column) -> Column:
    """'1er octobre 2026 à 14h30', '23/09/2026 à 09:30', ISO: a timestamp without zone; null for others."""
    t = fold(text)
    month = first_of(t, r"\d{1,2}(?:er)?\s+(" + "|".join(MONTHS) + r")\s+\d{4}")
    number = reduce(lambda x, kv: F.when(month == kv[0], kv[1]).otherwise(x), MONTHS.items(), F.lit(None).cast("int"))
    named = F.when(month.isNotNull(), F.concat_ws("-", first_of(t, r"\d{1,2}(?:er)?\s+[a-z]+\s+(\d{4})"), F.lpad(number.cast("string"), 2, "0"), F.lpad(first_of(t, r"(\d{1,2})(?:er)?\s+[a-z]+\s+\d{4}"), 2, "0")))
    slashed = F.when(t.rlike(r"\d{1,2}/\d{1,2}/\d{4}"), F.concat_ws("-", first_of(t, r"\d{1,2}/\d{1,2}/(\d{4})"), F.lpad(first_of(t, r"\d{1,2}/(\d{1,2})/\d{4}"), 2, "0"), F.lpad(first_of(t, r"(\d{1,2})/\d{1,2}/\d{4}"), 2, "0")))
    iso = first_of(t, r"(\d{4}-\d{2}-\d{2})")
    day = F.coalesce(named, slashed, iso)
    hour, minute = first_of(t, r"(\d{1,2})\s*[h:]\s*\d{0,2}"), first_of(t, r"\d{1,2}\s*[h:]\s*(\d{2})")
    return F.concat(day, F.lit(" "), F.lpad(F.coalesce(hour, F.lit("0")), 2, "0"), F.lit(":"), F.coalesce(minute, F.lit("00")), F.lit(":00")).try_cast("timestamp_ntz")


def type_from_text(text: Column) -> Column:
    """The type whose word stands first; of words at one place the longest. 'autre' without any."""
    t = fold(text)
    found = [F.struct(F.regexp_instr(t, F.lit(p)).alias("at"), (-F.length(F.regexp_substr(t, F.lit(p)))).alias("longest"), F.lit(k).alias("kind")) for p, k in TYPES]
    best = F.array_min(F.filter(F.array(*found), lambda x: x["at"] > 0))
    return F.coalesce(best["kind"], F.lit("autre"))


def occupancy(text: Column) -> Column:
    t = fold(text)
    return F.when(t.rlike(r"\blibre\b|inoccup|vacant"), "libre").when(t.rlike(r"\boccup|\bloue|locataire"), "occupé")


def rooms(text: Column) -> Column:
    """From digits, words or codes such as T3 and F4."""
    t = fold(text)
    spelled = {"studio": 1, "une piece": 1, "deux pieces": 2, "trois pieces": 3, "quatre pieces": 4, "cinq pieces": 5, "six pieces": 6}
    words = reduce(lambda x, kv: F.when(t.contains(kv[0]), kv[1]).otherwise(x), spelled.items(), F.lit(None).cast("int"))
    return F.coalesce(first_of(t, r"(\d{1,2})\s*pieces?\b").try_cast("int"), first_of(t, r"\b[tf]\s?(\d)\b").try_cast("int"), words)


def postcode_from_city(city: Column) -> Column:
    """Of arrondissements of Paris, Lyon and Marseille."""
    t = fold(city)
    n = F.lpad(first_of(t, r"(\d{1,2})\s*(?:er|e|eme|ieme)?\b"), 2, "0")
    base = F.when(t.startswith("paris"), "750").when(t.startswith("lyon"), "690").when(t.startswith("marseille"), "130")
    return F.concat(base, n)


def city_key(city: Column) -> Column:
    """Folded words joined by hyphens, 'st' as 'saint'."""
    t = F.regexp_replace(fold(city), r"[^a-z0-9]+", "-")
    return F.regexp_replace(F.regexp_replace(F.trim(t, F.lit("-")), r"(^|-)st(?=-)", "$1saint"), r"(^|-)ste(?=-)", "$1sainte")


def auction_key(court: Column, day: Column, city: Column, reserve: Column) -> Column:
    return F.concat_ws("|", city_key(court), F.date_format(day, "yyyy-MM-dd"), city_key(city), F.round(reserve).cast("long").cast("string"))


def department_of(postcode: Column) -> Column:
    head = F.substring(postcode, 1, 2)
    corsica = F.when(F.substring(postcode, 3, 3).try_cast("int") < 200, "2A").otherwise("2B")
    return F.when(head == "97", F.substring(postcode, 1, 3)).when(head == "20", corsica).otherwise(head)


# Upper bounds of energy (kWh) and carbon (kg) a square metre and year for each letter.
DPE = {"A": (70, 6), "B": (110, 11), "C": (180, 30), "D": (250, 50), "E": (330, 70), "F": (420, 100)}


def dpe_letter(kwh: Column, co2: Column, surface: Column) -> Column:
    """The worse of both; none below 40 square metres, where other bounds hold."""
    def grade(x: Column, i: int) -> Column:
        return reduce(lambda y, kv: F.when(x <= kv[1][i], kv[0]).otherwise(y), reversed(DPE.items()), F.when(x.isNotNull(), "G"))

    return F.when(F.coalesce(surface, F.lit(40.0)) >= 40, F.greatest(grade(kwh, 0), grade(co2, 1)))


def auction_status(text: Column, price: Column) -> Column:
    t = fold(text)
    return (
        F.when(t.rlike(r"carence|desertee|faute d.enchere"), "carence").when(t.rlike(r"retire|annule"), "retiré").when(t.rlike(r"report"), "reporté").when(t.rlike(r"non communique"), "non communiqué").when((price > 0) | t.rlike(r"adjuge"), "adjugé").otherwise("à venir")
    )


def days_between(a: Column, b: Column) -> Column:
    """Calendar days from a to b."""
    return F.datediff(b, a)


def trade_kind(text: Column, sector: Column) -> Column:
    """What a trade advert sells: the lease, the walls, a rental, or else the business."""
    t, s = fold(text), fold(F.coalesce(sector, F.lit("")))
    return (
        F.when(t.rlike(r"location pure|a louer") & ~t.rlike(r"fonds"), "location")
        .when(t.rlike(r"droit au bail|cession de bail|pas.de.porte"), "droit_au_bail")
        .when((t.rlike(r"murs (?:commerciaux|loues|occupes|libres)|vente des murs") | s.rlike("murs")) & ~t.rlike(r"murs et (?:le )?fonds|fonds et (?:les )?murs"), "murs")
        .otherwise("fonds_commerce")
    )
