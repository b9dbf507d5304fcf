"""Queries that are written in SQL alone, by the functions of ``register_sql``."""

from __future__ import annotations

from ..functions.sql_names import register_sql
from . import loads, records
from .catalogue import ORACLES, query

#: The town's key of every row, and the postcode where the town has one.
TOWNS = "CASE k % 5 WHEN 0 THEN 'paris-' || (k % 20 + 1) || 'e' WHEN 1 THEN 'lyon-' || (k % 9 + 1) WHEN 2 THEN 'marseille-13eme' WHEN 3 THEN 'saint-etienne' ELSE 'sainte-foy-les-lyon' END"


@query(f"SELECT * REPLACE ({TOWNS} AS town_key) FROM ({ORACLES['text_forms']})")
def sql_text_forms(spark, sf):
    """The text functions by name, on the forms of ``text_forms``, every town's key among them."""
    register_sql(spark)
    forms = ", ".join(f"{e} as {n}" for n, e in records.FORMS.items())
    return spark.sql(f"""with p as (select p_partkey as k, {forms} from parquet.`{sf}/part.parquet`)
select k, ls_rooms(rooms_text) as rooms, ls_surface(surface_text) as surface, ls_plot(plot_text) as plot, date_format(ls_date(date_text), 'yyyy-MM-dd HH:mm') as day, ls_occupancy(state_text) as state, ls_arrondissement(town) as town_code, ls_city_key(town) as town_key,
  ls_auction_status(result_text, cast(null as double)) as status, ls_department(postcode) as department, ls_energy_letter(kwh, co2, size) as letter, ls_trade(trade, cast(null as string)) as trade from p""")


@query(ORACLES["type_words"])
def sql_type_words(spark, sf):
    """Property types of all documents."""
    register_sql(spark)
    return spark.sql(f"select doc_id, ls_type(text) as kind from parquet.`{sf}/documents.parquet` where text is not null")


@query(ORACLES["linked_data"])
def sql_linked_data(spark, sf):
    """Linked data by a table function beside each page."""
    register_sql(spark)
    return spark.sql(f"""with p as (select cast(p_partkey as string) as url, {loads.LINKED} as html from (select p_partkey, p_partkey as {loads.K}, p_name from parquet.`{sf}/part.parquet`))
select url, l.name, l.price, l.surface, l.zipcode from p, lateral ls_linked_data(p.html) as l""")


@query("SELECT p_partkey::VARCHAR AS url, p_partkey AS n FROM part")
def sql_page_states(spark, sf):
    """The state of a script element by a table function beside each page."""
    register_sql(spark)
    return spark.sql(f"""with p as (select cast(p_partkey as string) as url, concat('<script id="x">{{"n": 0}}</script><SCRIPT type="a" id="app.state">{{"n": ', p_partkey, '}}</SCRIPT><script id="app-state">{{broken</script>') as html from parquet.`{sf}/part.parquet`)
select url, cast(get_json_object(s.state, '$.n') as bigint) as n from p, lateral ls_page_state(p.html, 'app.state') as s""")
