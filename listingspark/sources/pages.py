"""Structured data and text of crawled pages(url, html)."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from functools import reduce
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements whose text isn't shown, and those that end a line.
HIDDEN = "script|style|svg|noscript|template"
BLOCKS = "p|div|li|ul|ol|br|tr|table|section|article|header|footer|h[1-6]|dd|dt|dl"


def without_tags(page: Column) -> Column:
    """The page without hidden elements, comments and tags; blocks end lines, entities stay."""
    out = F.regexp_replace(page, rf"(?is)<({HIDDEN})\b[^>]*>.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, rf"(?i)</?(?:{BLOCKS})\b[^>]*>", "\n")
    return F.regexp_replace(out, r"<[^>]*>", " ")


#: Names that a semicolon may end, and those that may do without.
_NAMED = {n[:-1]: c for n, c in html5.items() if n.endswith(";")}
_BARE = {n: c for n, c in html5.items() if not n.endswith(";")}
#: What numbers of control characters stand for, as bytes of CP1252 do.
_CONTROLS = {b: bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0)}


def entities_read(text: Column) -> Column:
    """Named and numeric entities as their characters, each once: the names of HTML5, of which those that may lack their
    semicolon are read without too, the longest first. Names and numbers of no character stay. The ampersand's come last, so
    that what they then begin is not read again."""
    pairs = lambda table: F.create_map(*[F.lit(x) for n, c in sorted(table.items()) for x in (n, c)])
    found = lambda pattern: F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))
    said = lambda n, end, c: F.struct(F.concat(F.lit("&"), n, F.lit(end)).alias("said"), c.alias("char"))
    named, bare = pairs({n: c for n, c in _NAMED.items() if c != "&"}), pairs({n: c for n, c in _BARE.items() if c != "&"})
    closed = F.transform(found("&([A-Za-z][A-Za-z0-9]{1,31});"), lambda n: said(n, ";", F.try_element_at(named, n)))
    longest = "|".join(sorted((n for n, c in _BARE.items() if c != "&"), key=lambda n: (-len(n), n)))
    open_ones = F.array_sort(found(f"&({longest})"), lambda a, b: F.length(b) - F.length(a))
    opened = F.transform(open_ones, lambda n: said(n, "", F.try_element_at(bare, n)))
    code = lambda d: F.when(F.lower(d).startswith("x"), F.conv(F.substring(d, 2, 6), 16, 10)).otherwise(d).cast("int")
    real = lambda k: (k > 0) & (k <= 0x10FFFF) & ~k.between(0xD800, 0xDFFF)
    controls = F.create_map(*[F.lit(x) for k, c in _CONTROLS.items() for x in (k, c)])
    char = lambda k: F.when(real(k), F.coalesce(F.try_element_at(controls, k), F.decode(F.unhex(F.lpad(F.hex(k), 8, "0")), "UTF-32")))
    number = "&#([0-9]{1,7}|[xX][0-9A-Fa-f]{1,6})"
    # with a semicolon first, so that what is left of a number has none
    numbered = F.concat(F.transform(found(f"{number};"), lambda d: F.struct(F.concat(F.lit("&#"), d, F.lit(";")).alias("said"), char(code(d)).alias("char"))), F.transform(F.array_sort(found(f"{number}(?![0-9A-Fa-f;])"), lambda a, b: F.length(b) - F.length(a)), lambda d: F.struct(F.concat(F.lit("&#"), d).alias("said"), char(code(d)).alias("char"))))
    read = F.aggregate(F.concat(closed, numbered, opened), text, lambda t, x: F.coalesce(F.replace(t, x["said"], x["char"]), t))
    plain = F.regexp_replace(F.when(text.contains("&"), read).otherwise(text), "&(?:amp|AMP);?", "&")
    return plain


def html_to_text(page: Column) -> Column:
    """Shown text: hidden elements and comments go, blocks end lines, entities are read, blanks are squeezed."""
    out = F.regexp_replace(entities_read(without_tags(page)), r"[ \t\r\x{A0}]+", " ")
    return F.trim(F.regexp_replace(out, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def title(page: Column) -> Column:
    return F.trim(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1))


def links(page: Column) -> Column:
    return F.regexp_extract_all(page, F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))


LD = re.compile(r"<script[^>]*application/ld\+json[^>]*>(.*?)</script>", re.I | re.S)
#: Types of linked data that describe a property.
PROPERTY_TYPES = {"Product", "Offer", "Residence", "Apartment", "House", "SingleFamilyResidence", "RealEstateListing", "Place", "Accommodation"}


def read_json(text: str):
    try:
        return json.loads(html.unescape(text.strip()))
    except ValueError:
        return None


def nodes(value) -> Iterator[dict]:
    """All objects of lists and graphs."""
    for x in value if isinstance(value, list) else [value]:
        if isinstance(x, dict):
            yield x
            if isinstance(x.get("@graph"), list):
                yield from nodes(x["@graph"])


def one(x):
    return (x[0] if x else None) if isinstance(x, list) else x


def listing_of(node: dict) -> dict:
    part = lambda name: one(node.get(name)) if isinstance(one(node.get(name)), dict) else {}
    offer, address, geo, floor = part("offers"), part("address"), part("geo"), part("floorSize")
    number = lambda v: float(str(v).replace(",", ".").replace(" ", "")) if v not in (None, "") and re.fullmatch(r"[\d\s.,]+", str(v)) else None
    return {
        "name": one(node.get("name")), "type_hint": one(node.get("@type")), "price": number(offer.get("price")), "surface": number(floor.get("value")), "rooms": number(node.get("numberOfRooms")),
        "zipcode": address.get("postalCode"), "city": address.get("addressLocality"), "lat": number(geo.get("latitude")), "lng": number(geo.get("longitude")), "body": node.get("description"),
    }


LISTING = "url string, name string, type_hint string, price double, surface double, rooms double, zipcode string, city string, lat double, lng double, body string"


def extract_jsonld(pages: DataFrame) -> DataFrame:
    """A row for each object of a property type in a page's linked data; blocks that aren't JSON are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"url": url, **listing_of(n)} for url, page in zip(batch["url"], batch["html"], strict=True) for block in LD.findall(page or "") for n in nodes(read_json(block)) if set(n.get("@type") if isinstance(n.get("@type"), list) else [n.get("@type")]) & PROPERTY_TYPES]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in LISTING.split(", ")])

    return pages.select("url", "html").mapInPandas(run, LISTING)


# Escapes of a transfer state, the ampersand's last.
TRANSFER = (("&q;", '"'), ("&s;", "'"), ("&l;", "<"), ("&g;", ">"), ("&a;", "&"))
# How an index-dereferenced payload marks values that aren't plain; wrappers pass their content on.
WRAPPERS = ("Ref", "ShallowRef", "Reactive", "ShallowReactive", "NuxtError")


def revived(payload: list, depth: int = 64):
    """The tree of a payload in which a number inside a list or an object is the place of a value; the first value is the
    root. Places that lead back to themselves, or deeper than ``depth``, are null."""

    def at(place: int, open_places: tuple[int, ...]):
        if not 0 <= place < len(payload) or place in open_places or len(open_places) >= depth:
            return None
        value, path = payload[place], (*open_places, place)
        go = lambda x: at(x, path) if isinstance(x, int) and not isinstance(x, bool) else x
        if isinstance(value, dict):
            return {k: go(x) for k, x in value.items()}
        if not isinstance(value, list):
            return value
        match value:
            case ["Date", said, *_]:
                return said
            case ["EmptyRef", *_]:
                return None
            case ["Set", *items]:
                return [go(x) for x in items]
            case ["Map", *items]:
                return {str(go(k)): go(x) for k, x in zip(items[::2], items[1::2], strict=False)}
            case [str() as tag, inner, *_] if tag in WRAPPERS:
                return go(inner)
        return [go(x) for x in value]

    return at(0, ())


def indexed_state(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """url, state (of an index-dereferenced payload) -> url, state as plain JSON; what isn't such a payload has no row."""
    for batch in batches:
        rows = []
        for url, state in zip(batch["url"], batch["state"], strict=True):
            payload = read_json(state)
            if isinstance(payload, list) and payload:
                rows.append({"url": url, "state": json.dumps(revived(payload), ensure_ascii=False)})
        yield pd.DataFrame(rows, columns=["url", "state"])


def extract_state(pages: DataFrame, name: str, kind: str = "script") -> DataFrame:
    """url and state (JSON) that a page holds under a name; pages without it or with broken JSON have no row. kind:

    script: the text of the script element of this id. transfer: the same with a transfer state's escapes. indexed: the same,
    its numbers followed to the values they stand for. attribute: the value of this attribute, entities read; a row for each
    element that has it (properties that a page hands to a component too). layer: the object or list that is pushed to, or
    assigned to, the variable of this name. chunks: texts that are pushed to a variable in parts, joined and given as {"text": …}."""
    body = F.regexp_extract("html", rf'(?is)<script[^>]*\bid="{re.escape(name)}"[^>]*>(.*?)</script>', 1)
    state = F.trim(body)
    match kind:
        case "transfer":
            for said, char in TRANSFER:
                state = F.replace(state, F.lit(said), F.lit(char))
        case "attribute":
            found = F.regexp_extract_all("html", F.lit(rf"""(?is)\s{re.escape(name)}=("[^"]*"|'[^']*')"""), F.lit(1))
            state = F.explode(F.transform(found, lambda x: entities_read(F.substring(x, F.lit(2), F.length(x) - 2))))
        case "layer":
            found = F.regexp_extract_all("html", F.lit(rf"(?is)\b{re.escape(name)}(?:\.push\(|\s*=)\s*([\[{{].*?[\]}}])\s*\)?\s*;?\s*(?:</script>|\n)"), F.lit(1))
            state = F.explode(found)
        case "chunks":
            found = F.regexp_extract_all("html", F.lit(rf'(?is){re.escape(name)}\.push\(\[1,("(?:[^"\\]|\\.)*+")\]\)'), F.lit(1))
            said = F.transform(found, lambda x: F.from_json(F.concat(F.lit('{"t":'), x, F.lit("}")), "t string")["t"])
            state = F.when(F.size(found) > 0, F.to_json(F.struct(F.array_join(said, "").alias("text"))))
    out = pages.select("url", state.alias("state")).filter("state <> '' and try_parse_json(state) is not null")
    return out.mapInPandas(indexed_state, "url string, state string") if kind == "indexed" else out


def table_cells(pages: DataFrame, title: str) -> DataFrame:
    """url, line, year, value of the first table after a title: lines are named by their first cell, and the years stand in
    the table's bold cells in order. Cells that are no number are null."""
    table = F.regexp_extract("html", rf"(?s){re.escape(title)}.*?<table[^>]*>(.*?)</table>", 1)
    years = F.regexp_extract_all("table", F.lit(r"<b>\s*(\d{4})\s*</b>"), F.lit(1))
    df = pages.select("url", table.alias("table")).filter("table <> ''").select("url", years.alias("years"), F.explode(F.split("table", r"<tr[^>]*>")).alias("row"))
    df = df.select("url", "years", F.transform(F.regexp_extract_all("row", F.lit(r"(?s)<td[^>]*>(.*?)</td>"), F.lit(1)), html_to_text).alias("cells")).filter("size(cells) > 1")
    df = df.select("url", F.col("cells")[0].alias("line"), "years", F.posexplode(F.slice("cells", 2, F.size("cells"))).alias("at", "cell"))
    number = F.replace(F.regexp_replace("cell", r"[^\d,.-]", ""), F.lit(","), F.lit(".")).try_cast("double")
    return df.select("url", "line", F.coalesce(F.get("years", F.col("at")).cast("int"), F.col("at")).alias("year"), number.alias("value"))


# Lines of the financial table and their keys in the details.
FINANCIALS = {"CA": "Chiffre d'affaires", "EBE": "EBE", "Res. net": "Résultat net", "Marge brute": "Marge brute", "Res. exploit.": "Résultat d'exploitation", "Nb pers.": "Effectif"}


def financial_table(pages: DataFrame, title: str = "Éléments chiffrés") -> DataFrame:
    """url, key, value, year: each line of the financial table in the last year that has a figure. A result or EBE of 0 or
    less has a key of its own, so that nothing divides by it."""
    known = reduce(lambda a, kv: F.when(F.col("line") == kv[0], kv[1]).otherwise(a), FINANCIALS.items(), F.lit(None).cast("string"))
    out = last_filled_year(table_cells(pages, title).withColumn("line", known).filter("line is not null"), ["url"])
    negative = F.col("line").isin("EBE", "Résultat net") & (F.col("value") <= 0)
    return out.select("url", F.when(negative, F.concat("line", F.lit(" négatif"))).otherwise(F.col("line")).alias("key"), "value", "year")


def premises_listing(pages: DataFrame) -> DataFrame:
    """Bronze rows of professional adverts whose page state holds global.listing."""
    at = lambda name: F.get_json_object("state", f"$.global.listing.{name}")
    number = lambda name: at(name).try_cast("double")
    df = extract_state(pages, "react-context")
    business = at("characteristics_json.is_sale_of_business_assets") == "true"
    kind = F.when(business, "fonds_commerce").when(F.lower(at("realty_type")).contains("bureau"), "bureau").otherwise("local_commercial")
    sale = F.when(at("is_sale") == "true", "vente").otherwise("location")
    return df.select(
        at("id").alias("id"), "url", at("label").alias("name"), at("description").alias("body"), F.concat_ws(" ", sale, kind).alias("type_hint"), number("sale_price").alias("price"), number("total_surface").alias("surface"),
        F.coalesce(number("yearly_rent"), number("monthly_rent") * 12).alias("yearly_rent"), at("zip_code").alias("zipcode"), at("city").alias("city"), number("latitude").alias("lat"), number("longitude").alias("lng"),
        F.when(at("characteristics_json.is_occupied") == "true", "oui").alias("occupied"), number("property_tax").alias("property_tax"),
    )


def last_filled_year(cells: DataFrame, keys: list[str]) -> DataFrame:
    """cells(keys, line, year, value): each line's value of the last year that has one."""
    return cells.filter("value is not null").groupBy(*keys, "line").agg(F.max_by("value", "year").alias("value"), F.max("year").alias("year"))


def fix_scale(df: DataFrame, turnover: str, ebe: str, staff: str) -> DataFrame:
    """Turnovers of a billion or more, or above 100 million with at most five people, were given in thousandths."""
    wrong = (F.col(turnover) >= 1e9) | ((F.col(staff) <= 5) & (F.col(turnover) > 1e8))
    return df.withColumns({x: F.when(wrong, F.col(x) / 1000).otherwise(F.col(x)) for x in (turnover, ebe)})


def amounts(text: Column) -> Column:
    """Amounts in euros of a text, as numbers; blanks part thousands and a comma the cents."""
    found = F.regexp_extract_all(text, F.lit(r"(\d+(?:[  ]\d{3})*(?:,\d{1,2})?) ?(?:€|euros?)"), F.lit(1))
    return F.transform(found, lambda x: F.replace(F.regexp_replace(x, "[  ]", ""), F.lit(","), F.lit(".")).cast("double"))
