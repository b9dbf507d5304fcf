"""Filters, orders, pages, summaries, saved searches and exports of scored adverts."""

from __future__ import annotations

from functools import reduce
from urllib.parse import parse_qs

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text_fr import department_of, fold
from .ranks import spread_quantiles

c = F.col

#: Columns that a list of values is looked up in, by criterion.
LISTS = {"source": "source", "type_bien": "type_bien", "level": "niveau_affaire", "strategie": "strategie", "segment": "segment"}
#: Bounds: the value compared and whether it is the least.
BOUNDS = {
    "price_min": (("prix", "loyer"), True), "price_max": (("prix", "loyer"), False), "surface_min": (("surface_bati",), True), "surface_max": (("surface_bati",), False),
    "land_min": (("surface_terrain",), True), "land_max": (("surface_terrain",), False), "yield_min": (("rendement_net",), True),
}
SWITCHES = ("scored_only", "cashflow_positive", "price_drop", "real_rent", "include_inactive", "include_duplicates")
TEXTS = ("q", "department", "city", "postal_code", "auctions")
CRITERIA = {*LISTS, *BOUNDS, *SWITCHES, *TEXTS, "new_days"}


def department_prefix(department: str) -> str:
    """Both departments of Corsica have postcodes that begin with 20."""
    return "20" if department.upper() in ("2A", "2B") else department.zfill(2)


def predicate(**criteria) -> Column:
    """The condition of the criteria; an unknown one is an error, an empty value (or list) none. Unless ``include_inactive``
    or ``include_duplicates`` is set, only active adverts and the first of each group of copies are met."""
    if unknown := criteria.keys() - CRITERIA:
        raise ValueError(f"unknown criteria: {sorted(unknown)}")
    v = {k: x for k, x in criteria.items() if x is not None and x != "" and x != [] and x is not False}
    parts = []
    if "include_inactive" not in v:
        parts.append(~c("active").eqNullSafe(False))
    if "include_duplicates" not in v:
        parts.append(c("rang_doublon") == 1)
    if "q" in v:
        # a backslash stands for itself
        like = "%" + v["q"].replace("\\", "\\\\") + "%"
        parts.append(reduce(lambda a, b: a | b, [F.coalesce(c(x).ilike(like), F.lit(False)) for x in ("titre", "description", "ville")]))
    for name, column in LISTS.items():
        if name in v:
            parts.append(c(column).isin(*([v[name]] if isinstance(v[name], str) else v[name])))
    if "department" in v:
        parts.append(c("code_postal").startswith(department_prefix(v["department"])))
    if "city" in v:
        parts.append(fold(F.trim("ville")) == fold(F.trim(F.lit(v["city"]))))
    if "postal_code" in v:
        parts.append(c("code_postal").startswith(v["postal_code"]))
    for name, (columns, least) in BOUNDS.items():
        if name in v:
            x = F.coalesce(*columns)
            parts.append(x >= float(v[name]) if least else x <= float(v[name]))
    if "scored_only" in v:
        parts.append(c("score_global").isNotNull())
    if "cashflow_positive" in v:
        parts.append(c("cashflow_mensuel") >= 0)
    if "price_drop" in v:
        parts.append(c("baisse_prix_pct") >= 1)
    if "real_rent" in v:
        parts.append(c("loyer_reel"))
    if v.get("auctions") in ("only", "exclude"):
        parts.append(c("vente_encheres") if v["auctions"] == "only" else ~c("vente_encheres"))
    if "new_days" in v:
        parts.append(c("jours_en_ligne") <= int(v["new_days"]))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def deal_filter(df: DataFrame, **criteria) -> DataFrame:
    return df.filter(predicate(**criteria))


def criteria_of(query: str) -> dict:
    """Criteria of a URL's query string: keys that take a list may be repeated, of others the first counts; numbers that
    can't be read and unknown keys are none, switches are on at ``true``."""
    raw = parse_qs(query or "")

    def number(text: str) -> float | None:
        try:
            return float(text)
        except ValueError:
            return None

    out: dict = {k: raw[k] for k in LISTS if k in raw}
    out |= {k: raw[k][0] for k in TEXTS if k in raw}
    out |= {k: raw[k][0] == "true" for k in SWITCHES if k in raw}
    return out | {k: number(raw[k][0]) for k in (*BOUNDS, "new_days") if k in raw}


def filter_from_query(df: DataFrame, query: str) -> DataFrame:
    return deal_filter(df, **criteria_of(query))


def _trust() -> Column:
    return F.when(c("confiance") == "fiable", 0).when(c("confiance") == "indicative", 1).otherwise(2)


#: Orders by name; ties by source and external_id.
ORDERS = {
    "deal": lambda: [c("score_global").desc_nulls_last(), _trust().asc(), c("last_seen_at").desc_nulls_last()],
    "yield": lambda: [c("rendement_net").desc_nulls_last()],
    "cashflow": lambda: [c("cashflow_mensuel").desc_nulls_last()],
    "discount": lambda: [c("decote").asc_nulls_last()],
    "drop": lambda: [c("baisse_prix_pct").desc_nulls_last()],
    "recent": lambda: [F.coalesce("published_at", "first_seen_at").desc_nulls_last()],
    "price_asc": lambda: [c("prix").asc_nulls_last()],
    "price_desc": lambda: [c("prix").desc_nulls_last()],
    "surface": lambda: [c("surface_bati").desc_nulls_last()],
    "auction_date": lambda: [c("date_vente").asc_nulls_last()],
}


def ordered(df: DataFrame, column: str, falling: bool, key: list[str]) -> DataFrame:
    return df.orderBy(c(column).desc_nulls_last() if falling else c(column).asc_nulls_last(), *key)


def deal_sort(df: DataFrame, name: str = "deal") -> DataFrame:
    """One of ``ORDERS``; an unknown name is the default."""
    return df.orderBy(*ORDERS.get(name, ORDERS["deal"])(), "source", "external_id")


def page(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of an ordered table: its size is the feature."""
    return df.offset(offset).limit(limit)


def summary(df: DataFrame, **measures: Column) -> DataFrame:
    return df.agg(*[m.alias(name) for name, m in measures.items()])


def with_medians(df: DataFrame, one: DataFrame, **medians: Column) -> DataFrame:
    """``one`` (a row) with the medians of df's columns, of which no task holds all values."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), x.cast("double").alias("value")) for n, x in medians.items()])).alias("m")).select("m.*")
    found = spread_quantiles(long, ["name"], "value", [0.5])
    row = found.agg(*[F.max(F.when(c("name") == n, c("q")[0])).alias(n) for n in medians])
    return one.join(row, F.lit(True))


def deal_summary(df: DataFrame) -> DataFrame:
    """Nine measures of the adverts that a filter left."""
    counts = summary(
        df,
        total=F.count(F.lit(1)),
        excellent=F.count_if(c("niveau_affaire") == "excellente"),
        good=F.count_if(c("niveau_affaire") == "bonne"),
        scored=F.count("score_global"),
        unscored=F.count_if(c("score_global").isNull()),
        average_discount=F.avg("decote"),
        price_drops=F.count_if(c("baisse_prix_pct") >= 1),
        new=F.count_if(c("jours_en_ligne") <= 2),
    )
    return with_medians(df, counts, median_net_yield=c("rendement_net"))


def deal_tabs(df: DataFrame, **criteria) -> DataFrame:
    """Numbers of the tabs under the criteria but segment and auctions."""
    home = (c("segment") == "residentiel") & ~c("vente_encheres")
    tabs = {"all": F.lit(True), "decote": home, "locatif": home, **{x: c("segment") == x for x in ("immeuble", "murs", "fonds")}, "encheres": c("vente_encheres")}
    return tab_counts(deal_filter(df, **{k: v for k, v in criteria.items() if k not in ("segment", "auctions")}), tabs)


def tab_counts(df: DataFrame, tabs: dict[str, Column]) -> DataFrame:
    """One count for each tab, all in one pass."""
    return df.agg(*[F.count_if(p).alias(name) for name, p in tabs.items()])


def facet(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


#: Adverts that are sales, or of shops and businesses whatever they are.
SCOPE = "categorie = 'vente' or type_bien in ('fonds_commerce', 'local_commercial')"


def volumes(df: DataFrame, references: DataFrame | None = None, runs: DataFrame | None = None) -> DataFrame:
    """Adverts, their postcodes, the last time one was seen, the highest price and the 99th percentile of the sales' prices (of
    which no task holds all); reference_count (postcodes of ``references``) and latest_run (the last started of ``runs``
    (source, status, started_at, finished_at, rows_collected), ties by source), null where there are none."""
    df = df.filter(SCOPE)
    price = F.when((c("categorie") == "vente") & (c("prix") > 0), c("prix").cast("double"))
    out = df.agg(F.count(F.lit(1)).alias("total"), F.count_distinct("code_postal").alias("postal_codes"), F.max("last_seen_at").alias("last_seen_at"), F.max(price).alias("price_max_observed"))
    high = spread_quantiles(df.select(F.lit(1).alias("one"), price.alias("price")), ["one"], "price", [0.99]).agg(F.max(c("q")[0]).alias("price_p99"))
    out = out.join(high, F.lit(True))
    if references is not None:
        out = out.join(references.agg(F.count_distinct("code_postal").alias("reference_count")), F.lit(True))
    if runs is not None:
        run = F.struct("source", "status", "started_at", "finished_at", "rows_collected")
        out = out.join(runs.agg(F.max_by(run, F.struct("started_at", "source")).alias("latest_run")), F.lit(True))
    return out


def cities(df: DataFrame, city: str, *, like: str | None = None, top: int = 20, department: str | None = None, postcode: str = "code_postal") -> DataFrame:
    """Cities by folded name with the spelling to show (one that isn't all capitals if there is one), their least postcode where
    there are postcodes, and their number; the ``top`` most frequent, of a department if one is given. Adverts that have a
    category count if they are in ``SCOPE``."""
    if "categorie" in df.columns:
        df = df.filter(SCOPE)
    df = df.filter(F.trim(city) != "").withColumn("_name", fold(F.trim(city)))
    if department:
        df = df.filter(c(postcode).startswith(department_prefix(department)))
    if like:
        df = df.filter(c("_name").contains(fold(F.lit(like.strip()))))
    name = F.trim(city)
    shown = F.min(F.struct((name == F.upper(name)).alias("capitals"), name.alias("name")))
    least = [F.min(postcode).alias("postal_code")] if postcode in df.columns else []
    out = df.groupBy("_name").agg(shown.alias("s"), F.count(F.lit(1)).alias("n"), *least)
    return out.select(c("s.name").alias("city"), *(["postal_code"] if least else []), "n").orderBy(F.desc("n"), "city").limit(top)


def new_or_dropped(df: DataFrame, since: Column, *, first_seen: str, last_drop: str) -> Column:
    """Seen first since then and more than a day after the source's first advert (``_first_seen``; a source's first load is
    not news), or with a drop since then."""
    news = (c(first_seen) >= since) & (c(first_seen) > c("_first_seen") + F.expr("interval 1 day"))
    return F.coalesce(news, F.lit(False)) | F.coalesce(c(last_drop) >= since, F.lit(False))


def _met(df: DataFrame, searches: list[tuple[str, Column]], source: str, first_seen: str) -> DataFrame:
    """A row for each advert and search that it meets, with ``_first_seen``. The table is read once for all searches."""
    first = df.groupBy(source).agg(F.min(first_seen).alias("_first_seen"))
    met = F.array_compact(F.array(*[F.when(p, F.lit(name)) for name, p in searches]))
    return df.select("*", F.explode(met).alias("search")).join(first, source)


def search_matches(df: DataFrame, searches: list[tuple[str, Column]], state: DataFrame, *, source: str, first_seen: str, last_drop: str) -> DataFrame:
    """Matches of all saved searches at once: (search, filter) pairs against state(search, since)."""
    hits = _met(df, searches, source, first_seen).join(F.broadcast(state), "search")
    return hits.filter(new_or_dropped(hits, c("since"), first_seen=first_seen, last_drop=last_drop)).drop("_first_seen")


def search_counts(df: DataFrame, searches: list[tuple[str, Column]], as_of: Column, *, source: str, first_seen: str, last_drop: str) -> DataFrame:
    """total and recent (new, or dropped in price, within 48 hours) for each saved search, also one that meets nothing."""
    hits = _met(df, searches, source, first_seen)
    recent = new_or_dropped(hits, as_of - F.expr("interval 2 days"), first_seen=first_seen, last_drop=last_drop)
    counted = hits.groupBy("search").agg(F.count(F.lit(1)).alias("total"), F.count_if(recent).alias("recent"))
    named = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(n) for n, _ in searches])).alias("search"))
    return named.join(counted, "search", "left").fillna(0, ["total", "recent"])


def pending_alerts(df: DataFrame, searches: list[tuple[str, Column]], state: DataFrame, as_of: Column, **columns: str) -> tuple[DataFrame, DataFrame]:
    """(alerts, new state): the time advances for every search, also without an alert."""
    return search_matches(df, searches, state, **columns), state.withColumn("since", as_of)


def french_number(x: Column, digits: int) -> Column:
    """Rounded, with a comma and without the zeros that end it, but for one digit after the comma."""
    return F.when(x.isNotNull(), F.regexp_replace(F.regexp_replace(F.format_string(f"%.{digits}f", x), r"(\.\d+?)0+$", "$1"), r"\.", ","))


# Columns of the export and their labels.
EXPORT = {
    "score_global": "Score", "niveau_affaire": "Niveau", "strategie": "Stratégie", "segment": "Segment", "type_bien": "Type", "ville": "Ville", "code_postal": "Code postal", "prix": "Prix", "surface_bati": "Surface", "surface_terrain": "Terrain",
    "prix_m2": "Prix au m²", "median_eur_m2": "Médiane DVF au m²", "decote": "Décote nette", "loyer_mensuel_retenu": "Loyer mensuel retenu", "loyer_reel": "Loyer réel", "rendement_brut_retenu": "Rendement brut %", "rendement_net": "Rendement net %",
    "cashflow_mensuel": "Cash-flow mensuel", "chiffre_affaires": "Chiffre d'affaires", "ebe": "EBE", "multiple_ebe": "Prix / EBE", "dpe": "DPE", "baisse_prix_pct": "Baisse de prix %", "jours_en_ligne": "Jours en ligne", "nb_publications": "Publications",
    "mode_vente": "Mode de vente", "date_vente": "Date de vente", "risques_evaluation": "Points de vigilance", "source": "Source", "url": "Annonce",
}


def export_rows(df: DataFrame, columns: dict[str, str], *, order: list[Column], most: int = 5000) -> DataFrame:
    """Labelled strings for a CSV export: oui and non, up to two decimals with a comma, the discount in percent with one;
    at most ``most`` rows in order."""
    def said(name: str) -> Column:
        kind = df.schema[name].dataType.typeName()
        if kind == "boolean":
            return F.when(c(name), "oui").when(~c(name), "non")
        if kind in ("double", "float"):
            return french_number(c(name) * 100, 1) if name == "decote" else french_number(c(name), 2)
        return c(name).cast("string")

    return df.orderBy(*order).limit(most).select(*[said(name).alias(label) for name, label in columns.items()])


def export_deals(df: DataFrame, sort: str = "deal", *, most: int = 5000, **criteria) -> DataFrame:
    return export_rows(deal_filter(df, **criteria), EXPORT, order=[*ORDERS.get(sort, ORDERS["deal"])(), c("source"), c("external_id")], most=most)


def write_export(df: DataFrame, path: str) -> None:
    """One CSV file with semicolons; the byte order mark stands before the first label."""
    first = df.columns[0]
    df.withColumnRenamed(first, f"﻿{first}").coalesce(1).write.mode("overwrite").option("sep", ";").option("header", True).csv(path)


def feed(df: DataFrame, columns: list[str], *, score: str, key: list[str], most: int = 15000) -> DataFrame:
    """key and json: numbers to four places, nulls and empty texts left out; the ``most`` best."""
    def said(x: str) -> Column:
        kind = df.schema[x].dataType.typeName()
        return F.round(x, 4) if kind in ("double", "float") else F.nullif(c(x), F.lit("")) if kind == "string" else F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss") if kind.startswith("timestamp") else c(x)

    return df.orderBy(c(score).desc_nulls_last(), *key).limit(most).select(*key, F.to_json(F.struct(*[said(x).alias(x) for x in columns])).alias("json"))


def excerpt(text: Column, n: int = 420) -> Column:
    return F.substring(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "), 1, n)


def first_image(images: Column) -> Column:
    """The first of a JSON array of urls, or of objects that have one; null for what isn't such an array."""
    item = F.get(F.filter(F.from_json(images, "array<string>"), lambda x: x.isNotNull() & ~x.isin("", "{}", "[]", "false", "0")), 0)
    return F.when(item.startswith("{"), F.get_json_object(item, "$.url")).otherwise(item)


# Columns of the feed.
FEED = (
    "source external_id titre type_bien segment strategie niveau_affaire score_global ville code_postal prix prix_m2 surface_bati surface_terrain nb_pieces dpe decote median_eur_m2 nb_ventes confiance rendement_net rendement_brut_retenu"
    " cashflow_mensuel loyer_mensuel_retenu loyer_reel travaux_estimes cout_total chiffre_affaires ebe multiple_ebe multiple_ebe_reference secteur_reference vente_encheres mode_vente date_vente prix_compare baisse_prix_pct jours_en_ligne"
    " nb_publications sources_doublon risques_evaluation url"
).split()


def feed_deals(df: DataFrame, as_of: Column, *, most: int = 15000) -> DataFrame:
    """The feed: active adverts, the first of their copies, that are excellent or good, or auctions that aren't over."""
    coming = c("vente_encheres") & (c("date_vente").isNull() | (c("date_vente") >= as_of))
    kept = predicate() & (c("niveau_affaire").isin("excellente", "bonne") | coming)
    rows = df.filter(kept).withColumns({"extrait": excerpt(c("description")), "image": first_image(c("images_json"))})
    return feed(rows, [*FEED, "extrait", "image"], score="score_global", key=["source", "external_id"], most=most)


# Labels of types.
TYPE_LABELS = {"appartement": "Appartement", "maison": "Maison", "terrain": "Terrain", "bureau": "Bureau", "immeuble": "Immeuble", "local_commercial": "Murs commerciaux", "fonds_commerce": "Fonds de commerce", "autre": "Autre"}


def type_label() -> Column:
    """What a reader calls an advert's type: the segments of blocks and businesses come before it."""
    named = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in TYPE_LABELS.items() for x in pair]), c("type_bien")), F.lit("Bien"))
    return F.when(c("segment") == "immeuble", "Immeuble").when((c("segment") == "fonds") & ~c("type_bien").eqNullSafe("fonds_commerce"), "Fonds de commerce").otherwise(named)


#: Orders of a feed, nulls as the value beside them; ties as they come, so by the feed's own order.
FEED_ORDERS = {
    "score": lambda: [F.coalesce("score_global", F.lit(-1.0)).desc()],
    "yield": lambda: [F.coalesce("rendement_net", F.lit(-99.0)).desc()],
    "cashflow": lambda: [F.coalesce("cashflow_mensuel", F.lit(-1e9)).desc()],
    "discount": lambda: [F.coalesce("decote", F.lit(9.0)).asc()],
    "drop": lambda: [F.coalesce("baisse_prix_pct", F.lit(0.0)).desc()],
    "recent": lambda: [F.coalesce(c("jours_en_ligne").cast("double"), F.lit(1e9)).asc()],
    "price_asc": lambda: [F.coalesce("prix", F.lit(1e12)).asc()],
    "price_desc": lambda: [F.coalesce("prix", F.lit(0.0)).desc()],
    "auction": lambda: [F.coalesce(c("date_vente").cast("string"), F.lit("9999")).asc()],
}


def feed_sort(df: DataFrame, name: str = "score") -> DataFrame:
    """A feed in one of ``FEED_ORDERS`` (an unknown name is the first), ties by the feed's order."""
    return df.orderBy(*FEED_ORDERS.get(name, FEED_ORDERS["score"])(), c("score_global").desc_nulls_last(), "source", "external_id")


def feed_filter(df: DataFrame, *, department: str | None = None, place: str | None = None, q: str | None = None, price_min: float | None = None, price_max: float | None = None, surface_min: float | None = None, surface_max: float | None = None, yield_min: float | None = None, new_days: int | None = None, kind: str | None = None, source: str | None = None, cashflow: bool = False, real_rent: bool = False, drop: bool = False, excellent: bool = False) -> DataFrame:
    """Rows of a feed that a reader asks for. Here a department is that of the postcode, Corsica's two told apart; kind: a label as
    ``type_label`` gives."""
    out = F.lit(True)
    holds = lambda text, *names: F.lower(F.concat_ws(" ", *[F.coalesce(x, F.lit("")) for x in names])).contains(text.lower())
    if department:
        out = out & (department_of(c("code_postal")) == department)
    if place:
        out = out & holds(place, "ville", "code_postal")
    if q:
        out = out & holds(q, "titre", "extrait", "ville")
    for value, column, least in ((price_min, "prix", True), (price_max, "prix", False), (surface_min, "surface_bati", True), (surface_max, "surface_bati", False), (yield_min, "rendement_net", True), (new_days, "jours_en_ligne", False)):
        if value is not None:
            out = out & (c(column) >= value if least else c(column) <= value)
    if kind:
        out = out & (type_label() == kind)
    if source:
        out = out & (c("source") == source)
    for wanted, condition in ((cashflow, c("cashflow_mensuel") >= 0), (real_rent, c("loyer_reel")), (drop, c("baisse_prix_pct") >= 1), (excellent, c("niveau_affaire") == "excellente")):
        if wanted:
            out = out & condition
    return df.filter(out)


def feed_summary(df: DataFrame) -> DataFrame:
    """total, excellent, good, drops, new and the yield in the middle: of an even number the upper of the two."""
    middle = F.expr("-percentile_disc(0.5) within group (order by -rendement_net)")
    return summary(df, total=F.count(F.lit(1)), excellent=F.count_if(c("niveau_affaire") == "excellente"), good=F.count_if(c("niveau_affaire") == "bonne"), drops=F.count_if(c("baisse_prix_pct") >= 1), new=F.count_if(c("jours_en_ligne") <= 2), middle_yield=middle)


#: Tabs, as criteria and an order.
PRESETS = {
    "all": ({}, "deal"),
    "decote": ({"segment": "residentiel", "auctions": "exclude"}, "discount"),
    "locatif": ({"segment": "residentiel", "auctions": "exclude"}, "deal"),
    "immeuble": ({"segment": "immeuble"}, "deal"),
    "murs": ({"segment": "murs"}, "deal"),
    "fonds": ({"segment": "fonds"}, "deal"),
    "encheres": ({"auctions": "only"}, "auction_date"),
}


def preset(df: DataFrame, name: str, **more) -> DataFrame:
    criteria, order = PRESETS[name]
    return deal_sort(deal_filter(df, **criteria, **more), order)


def new_deals(df: DataFrame, since: Column, score: float) -> DataFrame:
    """Deals of at least this score seen first since then, the best first."""
    return df.filter((c("score_global") >= score) & (c("first_seen_at") > since)).orderBy(c("score_global").desc(), "source", "external_id")


def top_deals(df: DataFrame, n: int) -> DataFrame:
    return deal_sort(df).limit(n)


def pipeline_stats(silver: DataFrame) -> DataFrame:
    """n, active, last_seen of each source."""
    return silver.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if("active").alias("active"), F.max("last_seen_at").alias("last_seen"))


def deal_detail(deals: DataFrame, comparables: DataFrame, history: DataFrame, source: str, external_id: str) -> dict[str, DataFrame]:
    """The tables of one listing's page: itself, its comparables, its copies by price, its price history."""
    key = (c("source") == source) & (c("external_id") == external_id)
    own = deals.filter(key)
    block = [x for x in ("type_bien", "code_postal", "group") if x in deals.columns]
    same = deals.withColumn("_size", F.round("surface_bati")).join(own.select(*block, F.round("surface_bati").alias("_size")), [*block, "_size"]).filter(~key)
    return {"listing": own, "comparables": comparables.filter(key).orderBy("rank"), "copies": same.orderBy("prix", "source"), "history": history.filter(key).orderBy("observed_at")}


def save_search(saved: DataFrame, row: DataFrame) -> DataFrame:
    """saved(id, nom, filtres, …) with the row added or replaced; its filter is read once before, so that one that can't be
    read is not kept."""
    for r in row.select("filtres").collect():
        predicate(**criteria_of(r["filtres"]))
    return saved.join(row.select("id"), "id", "left_anti").unionByName(row)


def delete_search(saved: DataFrame, ids: list[str]) -> DataFrame:
    return saved.filter(~c("id").isin(*ids))


def saved_filters(saved: DataFrame) -> list[tuple[str, Column]]:
    """(id, predicate) of each saved search, written by hand and few, for ``search_matches``."""
    return [(r["id"], predicate(**criteria_of(r["filtres"]))) for r in saved.select("id", "filtres").collect()]
