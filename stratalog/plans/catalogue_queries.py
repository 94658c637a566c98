"""Queries over the entity table: filters, facets, detail, sorting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.functions import citations, labels, numbers
from stratalog.operators import detail, facets, filters
from stratalog.operators.filters import Filter
from stratalog.operators.ordering import with_position
from stratalog.plans.registry import query
from stratalog.plans.standins import BASE_TABLES, StandIns
from stratalog.sources import sinks
from stratalog.sources.catalog import table_counts as count_tables


def _filtered(t: StandIns, *chosen: Filter, **options) -> DataFrame:
    return filters.apply_filters(t.catalog(), chosen, **options).select("simulant_id", "name")


_EUROPE = "select n_name from nation join region on r_regionkey = n_regionkey where r_name = 'EUROPE'"


def _bloc(t: StandIns) -> DataFrame:
    europe = t["region"].filter("r_name = 'EUROPE'")
    return t["nation"].join(europe, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("country_code"))


@query(" union all ".join(f"select '{n}' as table_name, count(*) as n from {n}" for n in BASE_TABLES))
def table_counts(t: StandIns) -> DataFrame:
    return count_tables({n: t[n] for n in BASE_TABLES})


@query("select simulant_id, name from simulants where type in ('ECONOMY', 'SMALL')")
def filter_type(t: StandIns) -> DataFrame:
    return _filtered(t, Filter("type", ("ECONOMY", "SMALL")))


@query(f"select simulant_id, name from simulants where country_code = 'NATION_1' or country_code in ({_EUROPE})")
def filter_country_bloc(t: StandIns) -> DataFrame:
    return _filtered(t, Filter("country", ("EU", "NATION_1")), bloc=_bloc(t))


@query("""select simulant_id, name from simulants
    where coalesce(institution, '') in ('Brand#4') or contains(lower(coalesce(institution, '')), 'nasa')""")
def filter_institution(t: StandIns) -> DataFrame:
    return _filtered(t, Filter("institution", (filters.NASA_ANY, "Brand#4")))


@query("select simulant_id, name from simulants where availability in ('Available', 'Unknown')")
def filter_availability(t: StandIns) -> DataFrame:
    return _filtered(t, Filter("availability", ("Available", "Unknown")))


@query("""select simulant_id, name from simulants where simulant_id in (
        select simulant_id from compositions where component_name in ('NATION_2', 'NATION_3') and value_pct > 0)
    or simulant_id in (select simulant_id from mineral_groups where group_name = 'ASIA' and value_pct > 0)""")
def filter_mineral(t: StandIns) -> DataFrame:
    return _filtered(t, Filter("mineral", ("NATION_2", "NATION_3", "group:ASIA")))


@query("select simulant_id, name from simulants")
def filter_mineral_literal(t: StandIns) -> DataFrame:
    return _filtered(t, Filter("mineral", ("NATION_2",)), literal_mineral=True)


@query("""select simulant_id, name from simulants where simulant_id in (
    select simulant_id from chemical_compositions where component_name in ('AF', 'sum') and value_wt_pct > 0)""")
def filter_chemical(t: StandIns) -> DataFrame:
    return _filtered(t, Filter("chemical", ("AF", "sum")))


@query("select simulant_id, name from simulants where simulant_id in (select simulant_id from chemical_compositions)")
def filter_has_chemistry(t: StandIns) -> DataFrame:
    return _filtered(t, Filter("has_chemistry", ("yes",)))


@query("select simulant_id, name from simulants where simulant_id not in (select simulant_id from compositions)")
def filter_no_mineralogy(t: StandIns) -> DataFrame:
    return _filtered(t, Filter("has_mineralogy", ("no",)))


@query("select simulant_id, name from simulants where try_cast(release_date as bigint) between 1980 and 2005")
def filter_year(t: StandIns) -> DataFrame:
    return _filtered(t, Filter("year", ("1980", "2005")))


@query("select simulant_id, name from simulants where try_cast(release_date as bigint) is not null")
def filter_year_open(t: StandIns) -> DataFrame:
    return _filtered(t, Filter("year", ("", "")))


@query("""select simulant_id, name from simulants where simulant_id in (
    select simulant_id from "references" where contains(lower(coalesce(reference_text, '')), 'batch 12'))""")
def filter_reference(t: StandIns) -> DataFrame:
    return _filtered(t, Filter("reference", ("BATCH 12",)))


@query("select simulant_id, name from simulants where coalesce(lunar_sample_reference, '') in ('', '10084')")
def filter_profile_reference(t: StandIns) -> DataFrame:
    return _filtered(t, Filter("lunar_ref", ("", "10084")))


@query("""select simulant_id, name from simulants
    where contains(lower(name), 'ation_2') or contains(lower(country_code), 'ation_2')
       or contains(lower(coalesce(type, '')), 'ation_2') or contains(lower(coalesce(institution, '')), 'ation_2')""")
def search_text(t: StandIns) -> DataFrame:
    return _filtered(t, search="ATION_2")


_TABLE_SQL = """
    select s.simulant_id, s.name, s.type, s.country_code, s.institution, s.availability, s.lunar_sample_reference,
           try_cast(s.release_date as bigint) as year, s.country_code as country,
           s.simulant_id in (select simulant_id from chemical_compositions) as has_chemistry,
           s.simulant_id in (select simulant_id from compositions) as has_mineralogy,
           coalesce(f.first_reference, '') as first_reference
    from simulants s left join (
        select simulant_id, reference_text as first_reference from "references"
        qualify row_number() over (partition by simulant_id order by length(reference_id), reference_id) = 1) f
      on f.simulant_id = s.simulant_id
"""


@query(f"""with rows_ as ({_TABLE_SQL})
    select *, row_number() over (order by year desc nulls last, length(simulant_id), simulant_id) as position from rows_
    where country in ({_EUROPE}) and year >= 1985 and (contains(lower(name), '-1')
        or contains(lower(country_code), '-1') or contains(lower(coalesce(type, '')), '-1')
        or contains(lower(coalesce(institution, '')), '-1'))
      and simulant_id in (select simulant_id from chemical_compositions where component_name = 'RF' and value_wt_pct > 0)""")
def filtered_catalogue(t: StandIns) -> DataFrame:
    """Flagship: filters of every kind, data flags, first citation, and the sort."""
    catalog = t.catalog()
    chosen = filters.apply_filters(
        catalog,
        [Filter("country", ("EU",)), Filter("year", ("1985", "")), Filter("chemical", ("RF",)), Filter("type", ())],
        search="-1",
        bloc=_bloc(t),
    )
    rows = detail.catalogue_table(catalog, chosen)
    return with_position(rows, detail.catalogue_order("year", descending=True))


@query(f"""with rows_ as ({_TABLE_SQL})
    select simulant_id, name, has_chemistry, has_mineralogy, first_reference,
           row_number() over (order by lower(name), length(simulant_id), simulant_id) as position from rows_""")
def catalogue_by_name(t: StandIns) -> DataFrame:
    rows = detail.catalogue_table(t.catalog(), t["simulants"])
    return with_position(rows, detail.catalogue_order("name")).select(
        "simulant_id", "name", "has_chemistry", "has_mineralogy", "first_reference", "position")


@query(f"""with rows_ as ({_TABLE_SQL})
    select simulant_id, first_reference, row_number() over (
        order by lower(nullif(first_reference, '')) desc nulls last, length(simulant_id), simulant_id) as position
    from rows_""")
def catalogue_by_reference(t: StandIns) -> DataFrame:
    rows = detail.catalogue_table(t.catalog(), t["simulants"])
    return with_position(rows, detail.catalogue_order("reference", descending=True)).select(
        "simulant_id", "first_reference", "position")


@query("select count(*) filter (where type = 'SMALL' and availability = 'Available') as shown, count(*) as total from simulants")
def result_counter(t: StandIns) -> DataFrame:
    return filters.result_counter(t["simulants"], (F.col("type") == "SMALL") & (F.col("availability") == "Available"))


@query("select * from sites where lat is not null and lon is not null")
def located_sites(t: StandIns) -> DataFrame:
    return filters.located(t["sites"])


@query("""select component_name, count(*) as n, sum(value_wt_pct) as total from chemical_compositions
    where component_type = 'oxide' and component_name <> 'sum' and value_wt_pct > 0 group by component_name""")
def positive_oxides(t: StandIns) -> DataFrame:
    rows = filters.positive_components(t["chemical_compositions"], "value_wt_pct", oxides_only=True)
    return rows.groupBy("component_name").agg(F.count(F.lit(1)).alias("n"), F.sum("value_wt_pct").alias("total"))


@query("select * from simulants where simulant_id = 'S42'")
def entity_lookup(t: StandIns) -> DataFrame:
    return filters.by_key(t["simulants"], "simulant_id", "S42")


@query("""
    select 'type' as property, type as value, count(*) as n from simulants group by type
    union all select 'country', country_code, count(*) from simulants where country_code <> '' group by 2
    union all select 'institution', institution, count(*) from simulants where institution <> '' group by 2
    union all select 'institution', 'NASA (all)', count(*) from simulants where contains(lower(institution), 'nasa') having count(*) > 0
    union all select 'availability', availability, count(*) from simulants where availability <> '' group by 2
    union all select 'lunar_ref', lunar_sample_reference, count(*) from simulants where lunar_sample_reference <> '' group by 2
    union all select 'mineral', component_name, count(*) from compositions group by 2
    union all select 'group', group_name, count(*) from mineral_groups group by 2
    union all select 'chemical', component_name, count(*) from chemical_compositions
        where component_type = 'oxide' and component_name <> 'sum' group by 2""")
def facet_values(t: StandIns) -> DataFrame:
    return facets.facet_values(t.catalog())


@query("select distinct component_name as header from chemical_compositions where component_type = 'oxide' and component_name <> 'sum'")
def column_headers(t: StandIns) -> DataFrame:
    oxides = t["chemical_compositions"].filter("component_type = 'oxide' and component_name <> 'sum'")
    names = facets.bounded_names(oxides, "component_name")
    return oxides.filter(F.col("component_name").isin(names)).select(F.col("component_name").alias("header")).distinct()


@query("""select reference_id, simulant_id, reference_type,
        row_number() over (partition by simulant_id order by length(reference_id), reference_id) as position
    from "references" """)
def numbered_children(t: StandIns) -> DataFrame:
    return detail.numbered_children(t["references"], "reference_id").select(
        "reference_id", "simulant_id", "reference_type", "position")


@query("""select s.simulant_id, s.name, x.site_id, x.site_name, x.lat, x.lon from simulants s left join (
        select * from sites qualify row_number() over (partition by simulant_id order by length(site_id) desc, site_id desc) = 1) x
    on x.simulant_id = s.simulant_id""")
def last_site(t: StandIns) -> DataFrame:
    return detail.attach_last(t["simulants"], t["sites"], "site_id").select(
        "simulant_id", "name", "site_id", "site_name", "lat", "lon")


@query("""select c.composition_id, c.simulant_id, c.component_name, c.value_pct, m.mineral_name as sourcing_name,
        m.chemistry, m.available_europe
    from compositions c join mineral_sourcing m on m.mineral_name = lower(c.component_name)""")
def mineral_sourcing_lookup(t: StandIns) -> DataFrame:
    return detail.mineral_sourcing(t["compositions"], t["mineral_sourcing"]).select(
        "composition_id", "simulant_id", "component_name", "value_pct", "sourcing_name", "chemistry", "available_europe")


@query("""select s.simulant_id, s.name, s.country_code, s.type, x.site_name, x.lat, x.lon,
        case when contains(lower(s.type), 'highland') then '#94a8be' when contains(lower(s.type), 'mare') then '#d4915c'
             else '#9b8e82' end as colour
    from simulants s join (
        select * from sites qualify row_number() over (partition by simulant_id order by length(site_id) desc, site_id desc) = 1) x
    on x.simulant_id = s.simulant_id where x.lat is not null and x.lon is not null""")
def map_points(t: StandIns) -> DataFrame:
    return detail.map_points(t.catalog(), t["simulants"])


_MISSION = """case
    when contains(lower({c}), 'apollo 11') or lower({c}) = '10084' then 'Apollo 11'
    when contains(lower({c}), 'apollo 12') or lower({c}) = '12070' then 'Apollo 12'
    when contains(lower({c}), 'apollo 14') or lower({c}) = '14163' then 'Apollo 14'
    when contains(lower({c}), 'apollo 15') or lower({c}) = '15271' then 'Apollo 15'
    when contains(lower({c}), 'apollo 16') or lower({c}) = '60501' then 'Apollo 16'
    when contains(lower({c}), 'apollo 17') or lower({c}) = '71501' then 'Apollo 17'
    when contains(lower({c}), 'change') or contains(lower({c}), 'ce5') then 'Chang''e-5' end"""
_URL = "case when contains(upper({c}), 'NASA') then 'https://www.nasa.gov' when contains(upper({c}), 'ESA') then 'https://www.esa.int' end"
_BADGE = """case availability when 'Available' then 'emerald' when 'Limited Stock' then 'amber'
    when 'Production stopped' then 'red' else 'slate' end"""
_BASALT = "cast(regexp_extract(petrographic_class, 'Basalt\": ([0-9]+)', 1) as int)"


@query(f"""
    select s.simulant_id, s.name, s.type, s.country_code, s.institution, s.availability, s.release_date, s.tons_produced_mt,
           e.classification, e.application, e.feedstock, x.site_name, x.lat, x.lon, p.vendor, p.url, p.price_note,
           coalesce(c.n, 0) as n_chemical, coalesce(m.n, 0) as n_mineral, coalesce(g.n, 0) as n_group, coalesce(r.n, 0) as n_reference,
           nullif(concat_ws(' / ', nullif(s.lunar_sample_reference, ''),
               case when e.replica_of is distinct from s.lunar_sample_reference then nullif(e.replica_of, '') end), '') as sample_reference,
           case when petrographic_class like '{{%' then case when {_BASALT} > 20.5
                then 'Basalt ' || {_BASALT} || '%, Glass 20.5%' else 'Glass 20.5%, Basalt ' || {_BASALT} || '%' end
                else petrographic_class end as petrography,
           {_URL.format(c="s.institution")} as institution_url,
           {_MISSION.format(c="s.lunar_sample_reference")} as inferred_mission, {_BADGE} as badge
    from simulants s
    left join simulant_extra e on e.simulant_id = s.simulant_id
    left join (select * from sites qualify row_number() over (partition by simulant_id order by length(site_id) desc, site_id desc) = 1) x
        on x.simulant_id = s.simulant_id
    left join purchase_info p on p.simulant_id = s.simulant_id
    left join (select simulant_id, count(*) as n from chemical_compositions group by 1) c on c.simulant_id = s.simulant_id
    left join (select simulant_id, count(*) as n from compositions group by 1) m on m.simulant_id = s.simulant_id
    left join (select simulant_id, count(*) as n from mineral_groups group by 1) g on g.simulant_id = s.simulant_id
    left join (select simulant_id, count(*) as n from "references" group by 1) r on r.simulant_id = s.simulant_id""")
def entity_cards(t: StandIns) -> DataFrame:
    return detail.entity_cards(t.catalog(), t["simulants"])


@query(f"""select simulant_id, {_URL.format(c="institution")} as institution_url, country_code as country,
        {_MISSION.format(c="lunar_sample_reference")} as mission, {_BADGE} as badge,
        '"' || replace(notes, '"', '""') || '"' as notes_cell,
        regexp_replace(name, '[^a-zA-Z0-9]', '_', 'g') || '_2024-05-06.csv' as file_name,
        'https://scholar.google.com/scholar?q=' || url_encode(name || ' lunar regolith simulant') as search_link
    from simulants""")
def entity_labels(t: StandIns) -> DataFrame:
    return t["simulants"].select(
        "simulant_id",
        labels.institution_url(F.col("institution")).alias("institution_url"),
        labels.country_display(F.col("country_code")).alias("country"),
        labels.inferred_mission(F.col("lunar_sample_reference")).alias("mission"),
        labels.availability_badge(F.col("availability")).alias("badge"),
        labels.csv_cell(F.col("notes")).alias("notes_cell"),
        labels.export_file_name(F.col("name"), F.lit("2024-05-06").cast("date")).alias("file_name"),
        citations.entity_search_link(F.col("name")).alias("search_link"),
    )


_NUMERIC = r"'^\s*[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?\s*$'"
_PREFIX = r"'^\s*([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)'"


@query(f"""select simulant_id,
        case when regexp_matches(bulk_density, {_NUMERIC}) then nullif(try_cast(bulk_density as double), 0) end as bulk_density,
        nullif(try_cast(nullif(regexp_extract(cohesion, {_PREFIX}, 1), '') as double), 0) as cohesion,
        try_cast(release_date as bigint) as year,
        case when specific_gravity <= 0.4 then 0.01 when specific_gravity >= 4 then 20.0
             else round(0.01 + (specific_gravity - 0.4) / 3.6 * 19.99, 6) end as radius,
        'CH' || case when length(cast(glass_content_percent * 100 as bigint)::varchar) >= 3
            then cast(glass_content_percent * 100 as bigint)::varchar
            else lpad(cast(glass_content_percent * 100 as bigint)::varchar, 3, '0') end as key_text
    from simulants""")
def parsed_numbers(t: StandIns) -> DataFrame:
    gravity = F.col("specific_gravity")
    return t["simulants"].select(
        "simulant_id",
        numbers.strict_number(F.col("bulk_density")).alias("bulk_density"),
        numbers.prefix_number(F.col("cohesion")).alias("cohesion"),
        numbers.integer_text(F.col("release_date")).alias("year"),
        F.round(numbers.cluster_radius(gravity), 6).alias("radius"),
        labels.key_text("CH", F.col("glass_content_percent") * 100).alias("key_text"),
    )


@query(f"""select simulant_id, try_cast(release_date as bigint) as release_year,
        case when regexp_matches(bulk_density, {_NUMERIC}) then try_cast(bulk_density as double) end as bulk_density_number,
        case when regexp_matches(cohesion, {_NUMERIC}) then try_cast(cohesion as double) end as cohesion_number,
        case when regexp_matches(friction_angle, {_NUMERIC}) then try_cast(friction_angle as double) end as friction_angle_number
    from simulants""")
def exported_simulants(t: StandIns) -> DataFrame:
    return sinks.exported_simulants(t["simulants"]).select(
        "simulant_id", "release_year", "bulk_density_number", "cohesion_number", "friction_angle_number")


_LANDED = "cast(strptime(date, '%B %-d, %Y') as date)"
_KILOS = """case when samples_returned like '% kg' then cast(split_part(samples_returned, ' ', 1) as double)
    when samples_returned like '% g' then cast(split_part(samples_returned, ' ', 1) as double) * 0.001 end"""


@query(f"""select id, mission, cast({_LANDED} as varchar) as landed_on, {_KILOS} as samples_kg,
        case type when 'Apollo' then '#f59e0b' when 'Luna' then '#ef4444' when 'Chang-e' then '#3b82f6' else '#a855f7' end as colour,
        row_number() over (order by {_LANDED}, id) as by_date,
        row_number() over (order by {_KILOS} desc nulls last, id) as by_mass
    from landing""")
def landing_sites(t: StandIns) -> DataFrame:
    rows = detail.landing_sites(t["landing"])
    dated = with_position(rows, detail.site_order("date"), name="by_date")
    ranked = with_position(dated, detail.site_order("samples", descending=True), name="by_mass")
    return ranked.select("id", "mission", F.col("landed_on").cast("string").alias("landed_on"), "samples_kg", "colour",
                         "by_date", "by_mass")
