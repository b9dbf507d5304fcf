"""The text functions, distances and page readers by name in SQL: ``register_sql(spark)``, then ``spark.sql``.

Scalar functions are SQL functions, which Catalyst inlines. Tables of linked data come from a Python table function, tables of
page state from a SQL one; both are joined by LATERAL. Tests hold each to the function of Columns that it is named after."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..plans.shared import ship_package
from ..sources.pages import LD, LISTING, PROPERTY_TYPES, listing_of, nodes, read_json
from .text_fr import DPE, MARKED, MONTHS, PLAIN, TYPES


def got(text: str, pattern: str, group: int = 1) -> str:
    """A group's first match, null without one."""
    return f'nullif(regexp_extract({text}, r"{pattern}", {group}), "")'


def found(text: str, pattern: str) -> str:
    return f'{text} rlike r"{pattern}"'


def grade(value: str, i: int) -> str:
    return f"case {' '.join(f'when {value} <= {bounds[i]} then {chr(39)}{letter}{chr(39)}' for letter, bounds in DPE.items())} when {value} is not null then 'G' end"


def part(text: str, unit: str) -> str:
    return f"try_cast({got(text, rf'(\d+)\s*{unit}\b')} as double)"


TEXT = "t string"
KINDS = ", ".join(f'struct(regexp_instr(t, r"{p}") as at, -length(regexp_substr(t, r"{p}")) as longest, "{kind}" as kind)' for p, kind in TYPES)
SPELLED = {"studio": 1, "une piece": 1, "deux pieces": 2, "trois pieces": 3, "quatre pieces": 4, "cinq pieces": 5, "six pieces": 6}
MONTH = r"\d{1,2}(?:er)?\s+(" + "|".join(MONTHS) + r")\s+\d{4}"
DAY = f"""coalesce(
  case when {found("t", MONTH)} then concat_ws('-', {got("t", r"\d{1,2}(?:er)?\s+[a-z]+\s+(\d{4})")}, lpad(map({", ".join(f"'{m}', {n}" for m, n in MONTHS.items())})[{got("t", MONTH)}], 2, '0'), lpad({got("t", r"(\d{1,2})(?:er)?\s+[a-z]+\s+\d{4}")}, 2, '0')) end,
  case when {found("t", r"\d{1,2}/\d{1,2}/\d{4}")} then concat_ws('-', {got("t", r"\d{1,2}/\d{1,2}/(\d{4})")}, lpad({got("t", r"\d{1,2}/(\d{1,2})/\d{4}")}, 2, '0'), lpad({got("t", r"(\d{1,2})/\d{1,2}/\d{4}")}, 2, '0')) end,
  {got("t", r"(\d{4}-\d{2}-\d{2})")})"""

NUMBER, UNIT = r"(\d[\d .,\x{202F}]*)", r"\d[\d .,]*\s*(millions?|milliers?|k|m)(?![a-z0-9²])"
BLANK, MARKS = r"""r'[ \x{202F}]'""", """r'[.,]+$'"""

#: name, arguments, type, expression; those named ..._folded take folded text, for the functions below them.
SCALARS = [
    ("ls_fold", TEXT, "string", f"lower(translate(t, '{MARKED}', '{PLAIN}'))"),
    ("ls_number", "d string", "double", f"""case when {got("d", r"[.,](\d+)$")} is null or (length({got("d", r"[.,](\d+)$")}) = 3 and (length(d) - length(translate(d, '.,', '')) = 1 or not (contains(d, '.') and contains(d, ','))))
      then try_cast(translate(d, '.,', '') as double) else try_cast(concat(translate(regexp_replace(d, r"[.,]\\d+$", ''), '.,', ''), '.', {got("d", r"[.,](\d+)$")}) as double) end"""),
    ("ls_unit", "u string", "double", "case when u = 'm' or startswith(u, 'million') then 1e6 when u = 'k' or startswith(u, 'millier') then 1e3 else 1.0 end"),
    ("ls_amount_folded", TEXT, "double", f"ls_number(regexp_replace(regexp_replace({got('t', NUMBER)}, {BLANK}, ''), {MARKS}, '')) * ls_unit({got('t', UNIT)})"),
    ("ls_amount", TEXT, "double", "ls_amount_folded(ls_fold(t))"),
    ("ls_surface", TEXT, "double", f"ls_amount({got('ls_fold(t)', r'(\d[\d .,]*)\s*m(?:2|²)')})"),
    ("ls_plot_folded", TEXT, "double", f"case when coalesce({part('t', 'ha')}, {part('t', 'a')}, {part('t', 'ca')}) is not null then coalesce({part('t', 'ha')} * 10000, 0.0) + coalesce({part('t', 'a')} * 100, 0.0) + coalesce({part('t', 'ca')}, 0.0) end"),
    ("ls_plot", TEXT, "double", "ls_plot_folded(ls_fold(t))"),
    ("ls_date_folded", TEXT, "timestamp_ntz", f"""try_cast(concat({DAY}, ' ', lpad(coalesce({got("t", r"(\d{1,2})\s*[h:]\s*\d{0,2}")}, '0'), 2, '0'), ':', coalesce({got("t", r"\d{1,2}\s*[h:]\s*(\d{2})")}, '00'), ':00') as timestamp_ntz)"""),
    ("ls_date", TEXT, "timestamp_ntz", "ls_date_folded(ls_fold(t))"),
    ("ls_type_folded", TEXT, "string", f"coalesce(array_min(filter(array({KINDS}), x -> x.at > 0)).kind, 'autre')"),
    ("ls_type", TEXT, "string", "ls_type_folded(ls_fold(t))"),
    ("ls_occupancy_folded", TEXT, "string", f"case when {found('t', r'\blibre\b|inoccup|vacant')} then 'libre' when {found('t', r'\boccup|\bloue|locataire')} then 'occupé' end"),
    ("ls_occupancy", TEXT, "string", "ls_occupancy_folded(ls_fold(t))"),
    ("ls_rooms_folded", TEXT, "int", f"""coalesce(try_cast({got("t", r"(\d{1,2})\s*pieces?\b")} as int), try_cast({got("t", r"\b[tf]\s?(\d)\b")} as int), case {" ".join(f"when contains(t, '{w}') then {n}" for w, n in reversed(SPELLED.items()))} end)"""),
    ("ls_rooms", TEXT, "int", "ls_rooms_folded(ls_fold(t))"),
    ("ls_city_key", TEXT, "string", r"""regexp_replace(regexp_replace(trim('-' from regexp_replace(ls_fold(t), r"[^a-z0-9]+", '-')), r"(^|-)st(?=-)", r"$1saint"), r"(^|-)ste(?=-)", r"$1sainte")"""),
    ("ls_arrondissement_folded", TEXT, "string", f"""concat(case when startswith(t, 'paris') then '750' when startswith(t, 'lyon') then '690' when startswith(t, 'marseille') then '130' end, lpad({got("t", r"(\d{1,2})\s*(?:er|e|eme|ieme)?\b")}, 2, '0'))"""),
    ("ls_arrondissement", TEXT, "string", "ls_arrondissement_folded(ls_fold(t))"),
    ("ls_department", "p string", "string", "case when substring(p, 1, 2) = '97' then substring(p, 1, 3) when substring(p, 1, 2) = '20' then case when try_cast(substring(p, 3, 3) as int) < 200 then '2A' else '2B' end else substring(p, 1, 2) end"),
    ("ls_energy_letter", "kwh double, co2 double, surface double", "string", f"case when coalesce(surface, 40.0) >= 40 then greatest({grade('kwh', 0)}, {grade('co2', 1)}) end"),
    ("ls_auction_status_folded", "t string, price double", "string", f"""case when {found("t", "carence|desertee|faute d.enchere")} then 'carence' when {found("t", "retire|annule")} then 'retiré' when {found("t", "report")} then 'reporté'
      when {found("t", "non communique")} then 'non communiqué' when price > 0 or {found("t", "adjuge")} then 'adjugé' else 'à venir' end"""),
    ("ls_auction_status", "t string, price double", "string", "ls_auction_status_folded(ls_fold(t), price)"),
    ("ls_trade_folded", "t string, s string", "string", f"""case when {found("t", "location pure|a louer")} and not {found("t", "fonds")} then 'location' when {found("t", "droit au bail|cession de bail|pas.de.porte")} then 'droit_au_bail'
      when ({found("t", "murs (?:commerciaux|loues|occupes|libres)|vente des murs")} or {found("s", "murs")}) and not {found("t", "murs et (?:le )?fonds|fonds et (?:les )?murs")} then 'murs' else 'fonds_commerce' end"""),
    ("ls_trade", "t string, sector string", "string", "ls_trade_folded(ls_fold(t), ls_fold(coalesce(sector, '')))"),
    ("ls_km", "lat1 double, lng1 double, lat2 double, lng2 double", "double", "111.2D * sqrt(pow(lat2 - lat1, 2.0D) + pow((lng2 - lng1) * cos(radians(lat1)), 2.0D))"),
]

#: The state that a page's script element of an id holds; no row without it or for broken JSON.
STATE = """select state from (select trim(regexp_extract(html, concat(r'(?is)<script[^>]*\\bid="\\Q', id, r'\\E"[^>]*>(.*?)</script>'), 1)) as state) where state <> '' and try_parse_json(state) is not null"""


class LinkedData:
    """A row for each object of a property type in a page's linked data; a null page has none."""

    def eval(self, html: str) -> Iterator[tuple]:
        for block in LD.findall(html or ""):
            for node in nodes(read_json(block)):
                types = node.get("@type")
                if PROPERTY_TYPES.intersection(types if isinstance(types, list) else [types]):
                    yield tuple(listing_of(node).values())


def register_sql(spark: SparkSession) -> list[str]:
    """Make all functions known to the session, under names that begin with ``ls_``; calling it again changes nothing. Returns
    their names."""
    ship_package(spark)
    for name, arguments, of, body in SCALARS:
        spark.sql(f"create or replace temporary function {name}({arguments}) returns {of} return {body}")
    spark.sql(f"create or replace temporary function ls_page_state(html string, id string) returns table (state string) return {STATE}")
    spark.udtf.register("ls_linked_data", udtf(LinkedData, returnType=LISTING.removeprefix("url string, ")))
    return [x[0] for x in SCALARS] + ["ls_page_state", "ls_linked_data"]
