"""Queries over sort orders, export scopes, alternate keys, guards and the Markdown report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog import fixed
from stratalog.functions import labels
from stratalog.operators import backfill, detail, filters, mentions, merge, reports
from stratalog.operators.filters import Filter
from stratalog.operators.ordering import with_position
from stratalog.plans import catalogue_queries, composition_queries, corpus_queries
from stratalog.plans.registry import QUERIES, query
from stratalog.plans.standins import StandIns
from stratalog.session import durable
from stratalog.sources import sinks

_CATALOGUE_KEYS = {
    **{k: f"lower(coalesce({k}, ''))" for k in ("name", "type", "country", "institution", "availability", "lunar_sample_reference")},
    "year": "year", "has_chemistry": "cast(has_chemistry as int)", "has_mineralogy": "cast(has_mineralogy as int)",
    "reference": "lower(nullif(first_reference, ''))",
}


def _positions_sql(table: str, key: str, keys: dict[str, str], last: str) -> str:
    return " union all ".join(f"""
        select {key}, '{name}' as sort_key, row_number() over (order by {e} asc nulls last, {last}) as ascending,
               row_number() over (order by {e} desc nulls last, {last}) as descending from {table}""" for name, e in keys.items())


@query(f"with rows_ as ({catalogue_queries._TABLE_SQL}) {_positions_sql('rows_', 'simulant_id', _CATALOGUE_KEYS, 'length(simulant_id), simulant_id')}")
def catalogue_by_every_key(t: StandIns) -> DataFrame:
    """Where each entity stands by each of the ten sort keys, both ways."""
    rows = durable(detail.catalogue_table(t.catalog(), t["simulants"]))

    def placed(key: str) -> DataFrame:
        up = with_position(rows, detail.catalogue_order(key), name="ascending")
        both = with_position(up, detail.catalogue_order(key, descending=True), name="descending")
        return both.select("simulant_id", F.lit(key).alias("sort_key"), "ascending", "descending")

    return reduce(DataFrame.unionByName, [placed(k) for k in _CATALOGUE_KEYS])


_SITE_KEYS = {
    **{k: f"lower(coalesce({k}, ''))" for k in ("name", "mission", "type")}, "date": catalogue_queries._LANDED,
    "samples": catalogue_queries._KILOS, "date as text": "date", "samples as text": "lower(coalesce(samples_returned, ''))",
}


@query(_positions_sql("landing", "id", _SITE_KEYS, "id"))
def sites_by_every_key(t: StandIns) -> DataFrame:
    """Where each landing site stands by each of the five sort keys, dates and masses by value and as text, both ways."""
    def placed(key: str) -> DataFrame:
        plain, as_text = key.split(" ")[0], key.endswith("as text")
        up = with_position(t["landing"], detail.site_order(plain, as_text=as_text), name="ascending")
        both = with_position(up, detail.site_order(plain, descending=True, as_text=as_text), name="descending")
        return both.select("id", F.lit(key).alias("sort_key"), "ascending", "descending")

    return reduce(DataFrame.unionByName, [placed(k) for k in _SITE_KEYS])


_BLENDS = """select * replace (case when value_pct > 5 then 'Blend ' || component_name else component_name end as component_name),
    case when value_pct > 9 then "group" else upper(component_name) end as alternate from compositions"""


@query(f"""with blends as ({_BLENDS})
    select b.composition_id, b.component_name, b.alternate, coalesce(m.mineral_name, n.mineral_name) as sourcing_name,
           case when m.mineral_name is not null then m.chemistry else n.chemistry end as chemistry
    from blends b left join mineral_sourcing m on m.mineral_name = lower(b.component_name)
         left join mineral_sourcing n on n.mineral_name = lower(b.alternate)
    where coalesce(m.mineral_name, n.mineral_name) is not null""")
def sourcing_by_alternate(t: StandIns) -> DataFrame:
    """Sourcing by a second name where the first is unknown; some rows have neither."""
    rows = t["compositions"].withColumns({
        "component_name": F.when(F.col("value_pct") > 5, F.concat(F.lit("Blend "), "component_name")).otherwise(F.col("component_name")),
        "alternate": F.when(F.col("value_pct") > 9, F.col("group")).otherwise(F.upper("component_name")),
    })
    return detail.mineral_sourcing(rows, t["mineral_sourcing"], alternate="alternate").select(
        "composition_id", "component_name", "alternate", "sourcing_name", "chemistry")


_CODES = ("USA", "CHN", "TWN", "EU", "XKX", "NOR", "")


@query("select simulant_id, case {} else code end as country from (select simulant_id, ([{}])[1 + cast(substr(simulant_id, 2) as int) % {}] as code from simulants)".format(
    " ".join(f"when code = '{c}' then '{fixed.COUNTRY_DISPLAY[c]}'" for c in _CODES if c in fixed.COUNTRY_DISPLAY), ", ".join(f"'{c}'" for c in _CODES), len(_CODES)))
def country_names(t: StandIns) -> DataFrame:
    """Codes shown as names where the table has them, as they are otherwise."""
    place = (F.substring("simulant_id", 2, 20).cast("int") % len(_CODES)).cast("int")
    code = F.get(F.array(*[F.lit(c) for c in _CODES]), place)
    return t["simulants"].select("simulant_id", code.alias("code")).select("simulant_id", labels.country_display(F.col("code")).alias("country"))


_NATIONS, _OXIDES = composition_queries._NATIONS, composition_queries._OXIDES


@query(QUERIES["wide_export"].sql + """ where "Type" in ('SMALL', 'ECONOMY') and "Availability" = 'Available'""")
def export_filtered(t: StandIns) -> DataFrame:
    """The wide export of what the filters leave."""
    chosen = filters.apply_filters(t.catalog(), [Filter("type", ("SMALL", "ECONOMY")), Filter("availability", ("Available",))])
    return sinks.wide_export(t.catalog(), chosen, _NATIONS, _OXIDES)


@query(QUERIES["wide_export"].sql + """ where "Simulant ID" in (select 'S' || p_partkey from part where p_size = 7)""")
def export_checked(t: StandIns) -> DataFrame:
    """The wide export of entities chosen one by one."""
    checked = t["part"].filter("p_size = 7").select(F.concat(F.lit("S"), F.col("p_partkey").cast("string")).alias("simulant_id"))
    return sinks.wide_export(t.catalog(), t["simulants"].join(checked, "simulant_id", "left_semi"), _NATIONS, _OXIDES)


@query("""select distinct simulant_id from sites where simulant_id in (select simulant_id from "references")""")
def append_clashes(t: StandIns) -> DataFrame:
    """All owners for which appending is refused: they have rows already."""
    return merge.clashing_owners(t["references"], t["sites"])


@query(f"with {corpus_queries._NEW} select * from fresh order by length(reference_id), reference_id limit 5")
def citation_preview(t: StandIns) -> DataFrame:
    """The first five citations a backfill would add."""
    return backfill.preview(corpus_queries._new(t)).select("reference_id", "simulant_id", "title", "authors", "year", "doi", "reference_type")


def _heading_sql() -> str:
    lines = [(s, reports._FIRST + i, line) for s, own in fixed.REPORT_HEADINGS.items() for i, line in enumerate(own)]
    return " union all ".join(f"select {s} as section, cast({r} as bigint) as rank, '' as key, '{line}' as line" for s, r, line in lines)


@query(f"""with multi as ({QUERIES["multi_entity_report"].sql}), sources as ({QUERIES["entity_sources"].sql}),
    bare as ({QUERIES["uncovered_entities"].sql}), totals as ({QUERIES["corpus_totals"].sql}),
    lines as ({_heading_sql()}
        union all select 1, 0, '', 'Generated from ' || documents || ' sources' from totals
        union all select 1, 1, '', '' from totals
        union all select 1, 2, '', '**' || documents_with_mention || '** sources mention at least one simulant.' from totals
        union all select 1, 3, '', '' from totals
        union all select 2, -entity_count, file, '| ' || substr(file, 1, 50) || ' | ' || entities || ' | ' || coalesce(title, '') || ' |' from multi
        union all select 3, 0, s.simulant_id, '| ' || s.name || ' | ' || s.source_count || ' | ' || coalesce(substr(c.title, 1, 40), '-') || ' |'
            from sources s left join corpus c on c.file = s.first_source
        union all select 4, length(simulant_id), simulant_id, '- ' || name || ' (' || simulant_id || ')' from bare
        union all select 4, 0, '', '{fixed.REPORT_ALL_COVERED}' from totals where entities_uncovered = 0)
    select section, row_number() over (partition by section order by rank, key) as position, line from lines""")
def markdown_report(t: StandIns) -> DataFrame:
    """The reports of the mention index as the lines of one document."""
    hits, names, corpus = corpus_queries._word_hits(t), t["word_names"], t["corpus"]
    return reports.markdown_lines(
        mentions.corpus_totals(hits, corpus, names, "file"), mentions.multi_entity_report(corpus_queries._index(t), "file"),
        mentions.entity_sources(hits, names, "file"), mentions.uncovered_entities(hits, names), corpus.select("file", "title"), "file")
