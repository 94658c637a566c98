"""Queries over compositions: totals, families, overlays, comparisons, wide export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.functions.labels import inferred_mission
from stratalog.operators import cluster, compose, detail, filters
from stratalog.operators.ordering import with_position
from stratalog.plans.catalogue_queries import _MISSION, _NUMERIC, _PREFIX
from stratalog.plans.registry import query
from stratalog.plans.standins import StandIns
from stratalog.sources import sinks
from stratalog.sources.catalog import normalised_components

_FIRST_CHEM = """
    select simulant_id, component_name, value_wt_pct as value from chemical_compositions
    qualify row_number() over (partition by simulant_id, component_name
        order by length(composition_id), composition_id, value_wt_pct) = 1
"""
_FIRST_MINERAL = """
    select simulant_id, component_name, value_pct as value from compositions
    qualify row_number() over (partition by simulant_id, component_name
        order by length(composition_id), composition_id, value_pct) = 1
"""


def _chemistry(t: StandIns) -> DataFrame:
    return compose.first_components(t["chemical_compositions"], "value_wt_pct")


def _minerals(t: StandIns) -> DataFrame:
    return compose.first_components(t["compositions"], "value_pct")


def _profiles(t: StandIns) -> DataFrame:
    """Reference profiles with their components as a map; a profile is one short row."""
    entry = F.struct("component_name", "value")
    return t["profile_values"].groupBy("sample_id", "mission").agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("chemical_composition"))


def _profile_pairs(t: StandIns) -> DataFrame:
    """Each entity with the profile its free-text sample reference points to."""
    missions = _profiles(t).select("sample_id", "mission")
    inferred = t["simulants"].select("simulant_id", inferred_mission(F.col("lunar_sample_reference")).alias("mission"))
    return inferred.join(missions, "mission").select("simulant_id", "sample_id")


_PAIRS_SQL = f"""
    select s.simulant_id, v.sample_id from simulants s
    join (select distinct sample_id, mission from profile_values) v on v.mission = {_MISSION.format(c="s.lunar_sample_reference")}
"""


@query("select sample_id, mission, count(*) as n from profile_values group by 1, 2")
def profiles_with_chemistry(t: StandIns) -> DataFrame:
    rows = filters.profiles_with_chemistry(_profiles(t))
    return rows.select("sample_id", "mission", F.size("chemical_composition").cast("bigint").alias("n"))


@query("select sample_id, component_name, value from profile_values")
def profile_round_trip(t: StandIns) -> DataFrame:
    full = _profiles(t).select(
        "sample_id", "mission", "chemical_composition",
        F.struct(F.lit(1.5).alias("lat"), F.lit(2.5).alias("lon")).alias("coordinates"),
        F.lit(None).cast("map<string, double>").alias("mineral_composition"), F.array(F.col("sample_id")).alias("sources"),
    )
    back = sinks.decoded_profiles(sinks.relational_profiles(full))
    return compose.profile_components(back, "chemical_composition")


@query(f"""with rows_ as ({_FIRST_CHEM})
    select simulant_id, component_name, sum(value) as value, grouping(component_name) = 1 as is_total
    from rows_ where component_name <> 'sum' and value > 0
    group by rollup (simulant_id, component_name) having simulant_id is not null""")
def composition_totals(t: StandIns) -> DataFrame:
    return compose.composition_totals(_chemistry(t).filter("component_name <> 'sum' and value > 0"))


@query(f"""with rows_ as ({_FIRST_CHEM}), pair as ({_PAIRS_SQL})
    select r.simulant_id, p.sample_id, r.component_name, r.value, v.value as reference,
           coalesce(v.value, 0.0) as reference_or_zero
    from rows_ r join pair p on p.simulant_id = r.simulant_id
    left join profile_values v on v.sample_id = p.sample_id and v.component_name = r.component_name""")
def profile_overlay(t: StandIns) -> DataFrame:
    rows = _chemistry(t).join(_profile_pairs(t), "simulant_id")
    profile = compose.profile_components(_profiles(t), "chemical_composition")
    return compose.overlay(rows, profile).select(
        "simulant_id", "sample_id", "component_name", "value", "reference", "reference_or_zero")


@query(f"""with rows_ as ({_FIRST_CHEM}), pair as ({_PAIRS_SQL}),
    ours as (select p.simulant_id, p.sample_id, r.component_name, r.value from pair p join rows_ r on r.simulant_id = p.simulant_id
             where r.value > 0 and r.component_name <> 'sum'),
    theirs as (select p.simulant_id, p.sample_id, v.component_name, v.value from pair p join profile_values v on v.sample_id = p.sample_id),
    both_ as (
        select coalesce(o.simulant_id, h.simulant_id) as simulant_id, coalesce(o.sample_id, h.sample_id) as sample_id,
               coalesce(o.component_name, h.component_name) as component_name,
               coalesce(o.value, 0.0) as value_1, coalesce(h.value, 0.0) as value_2
        from ours o full outer join theirs h
          on h.simulant_id = o.simulant_id and h.sample_id = o.sample_id and h.component_name = o.component_name)
    select *, case when value_1 > 0 and value_2 > 0 then value_1 - value_2 end as delta,
           case when value_1 > 0 and value_2 > 0 then abs(value_1 - value_2) end as abs_delta
    from both_ where value_1 > 0 or value_2 > 0""")
def compare_to_profiles(t: StandIns) -> DataFrame:
    profile = compose.profile_components(_profiles(t), "chemical_composition")
    rows = _chemistry(t).filter("component_name <> 'sum'")
    return compose.compare_to_profiles(rows, profile, _profile_pairs(t))


def _pair_sql(first: str, where: str) -> str:
    return f"""with rows_ as ({first}),
    one as (select p.pair_id, r.component_name, r.value from pairs p join rows_ r on r.simulant_id = p.id_1 where {where}),
    two as (select p.pair_id, r.component_name, r.value from pairs p join rows_ r on r.simulant_id = p.id_2 where {where}),
    both_ as (select coalesce(o.pair_id, w.pair_id) as pair_id, coalesce(o.component_name, w.component_name) as component_name,
                     coalesce(o.value, 0.0) as value_1, coalesce(w.value, 0.0) as value_2
              from one o full outer join two w on w.pair_id = o.pair_id and w.component_name = o.component_name)
    select *, value_1 - value_2 as delta, abs(value_1 - value_2) as abs_delta,
           case when value_1 > value_2 then 'first' when value_1 < value_2 then 'second' else 'tie' end as larger
    from both_ where value_1 > 0 or value_2 > 0"""


@query(_pair_sql(_FIRST_MINERAL, "true"))
def compare_minerals(t: StandIns) -> DataFrame:
    return compose.compare_pairs(_minerals(t), t["pairs"])


@query(_pair_sql(_FIRST_CHEM, "r.component_name <> 'sum'"))
def compare_chemistry(t: StandIns) -> DataFrame:
    return compose.compare_pairs(_chemistry(t), t["pairs"])


@query(f"""with c as ({_pair_sql(_FIRST_CHEM, "true")})
    select pair_id, component_name, row_number() over (
        partition by pair_id order by value_1 + value_2 desc, component_name) as position from c""")
def comparison_ranking(t: StandIns) -> DataFrame:
    rows = compose.compare_pairs(_chemistry(t), t["pairs"], exclude_sum=False)
    ranked = with_position(rows, compose.comparison_order(()), within=["pair_id"])
    return ranked.select("pair_id", "component_name", "position")


@query(f"""with rows_ as (
        select simulant_id, unnest([
            {{'component_name': 'Specific Gravity', 'value': specific_gravity}},
            {{'component_name': 'Bulk Density (g/cm³)', 'value': case when regexp_matches(bulk_density, {_NUMERIC}) then try_cast(bulk_density as double) end}},
            {{'component_name': 'Cohesion (kPa)', 'value': case when regexp_matches(cohesion, {_NUMERIC}) then try_cast(cohesion as double) end}},
            {{'component_name': 'Friction Angle (°)', 'value': try_cast(friction_angle as double)}},
            {{'component_name': 'Particle Size D50 (µm)', 'value': particle_size_d50}},
            {{'component_name': 'Glass Content (%)', 'value': glass_content_percent}}], recursive := true)
        from simulants),
    one as (select p.pair_id, r.component_name, coalesce(r.value, 0.0) as v from pairs p join rows_ r on r.simulant_id = p.id_1),
    two as (select p.pair_id, r.component_name, coalesce(r.value, 0.0) as v from pairs p join rows_ r on r.simulant_id = p.id_2)
    select pair_id, component_name, one.v as value_1, two.v as value_2
    from one join two using (pair_id, component_name) where one.v > 0 or two.v > 0""")
def compare_physical(t: StandIns) -> DataFrame:
    return compose.compare_physical(t["simulants"], t["pairs"])


def _plain(expr: str) -> str:
    return f"regexp_replace(cast({expr} as varchar), '\\.0$', '')"


@query(f"""with rows_ as (
    select s.simulant_id, unnest([
        {{'property': 'bulk_density', 'label': 'Bulk Density', 'unit': 'g/cm³', 'value': {_plain(f"case when regexp_matches(bulk_density, {_NUMERIC}) then nullif(try_cast(bulk_density as double), 0) end")}}},
        {{'property': 'specific_gravity', 'label': 'Specific Gravity', 'unit': '', 'value': {_plain("nullif(s.specific_gravity, 0)")}}},
        {{'property': 'cohesion', 'label': 'Cohesion', 'unit': 'kPa', 'value': {_plain(f"nullif(try_cast(nullif(regexp_extract(cohesion, {_PREFIX}, 1), '') as double), 0)")}}},
        {{'property': 'friction_angle', 'label': 'Friction Angle', 'unit': '°', 'value': {_plain("try_cast(friction_angle as double)")}}},
        {{'property': 'particle_size_d50', 'label': 'Particle Size D50', 'unit': 'μm', 'value': {_plain("particle_size_d50")}}},
        {{'property': 'particle_size_distribution', 'label': 'Particle Size Distribution', 'unit': 'μm', 'value': particle_size_distribution}},
        {{'property': 'glass_content_percent', 'label': 'Glass Content', 'unit': '%', 'value': {_plain("nullif(glass_content_percent, 0)")}}},
        {{'property': 'grain_size_mm', 'label': 'Grain Size', 'unit': 'mm', 'value': grain_size_mm}}], recursive := true)
    from simulants s left join simulant_extra e on e.simulant_id = s.simulant_id)
    select * from rows_ where value is not null""")
def physical_properties(t: StandIns) -> DataFrame:
    return detail.physical_properties(t.catalog(), t["simulants"])


_FAMILIES = {f"Family {i}": tuple(f"NATION_{n}" for n in range(4 * i, 4 * i + 3)) for i in range(5)}


@query("with family(family, component_name) as (values "
       + ", ".join(f"('{f}', '{m}')" for f, ms in _FAMILIES.items() for m in ms) + """),
    mapped as (select c.simulant_id, f.family, sum(c.value_pct) as value from compositions c
               join family f on f.component_name = c.component_name group by 1, 2)
    select e.simulant_id, f.family, coalesce(m.value, 0.0) as value
    from (select distinct simulant_id from mapped) e cross join (select distinct family from family) f
    left join mapped m on m.simulant_id = e.simulant_id and m.family = f.family""")
def family_shares(t: StandIns) -> DataFrame:
    rows = t["compositions"].select("simulant_id", "component_name", F.col("value_pct").alias("value"))
    return compose.family_shares(rows, _FAMILIES)


@query("select simulant_id, sum(value_pct) as total from mineral_groups group by 1 having sum(value_pct) > 40 + 1e-6")
def totals_above(t: StandIns) -> DataFrame:
    return compose.totals_above(t["mineral_groups"], "value_pct", 40.0)


@query("""select composition_id, simulant_id, component_name, value_wt_pct from chemical_compositions""")
def normalised_drift(t: StandIns) -> DataFrame:
    drifted = t["chemical_compositions"].select(
        "composition_id", "simulant_id", F.lit(None).cast("string").alias("component_name"),
        F.col("component_name").alias("oxide"), F.lit(None).cast("double").alias("value_wt_pct"),
        F.col("value_wt_pct").alias("percentage"))
    return normalised_components(drifted, "value_wt_pct")


_OXIDES = ("AF", "AO", "NF", "NO", "RF", "RO")
_NATIONS = tuple(f"NATION_{i}" for i in range(25))
_SECTION = """case when reference_type = 'composition' then 'composition'
    when coalesce(reference_type, 'usage') in ('usage', '') then 'usage' else 'other' end"""
_ROLLUP = f"""
    with placed as (
        select simulant_id, reference_id, {_SECTION} as section, coalesce(reference_text, '') as text from "references"),
    numbered as (select * from placed)
    select simulant_id,
        coalesce(string_agg(text, ' | ' order by length(reference_id), reference_id) filter (where section = 'composition'), '') as composition_sources,
        coalesce(string_agg(text, ' | ' order by length(reference_id), reference_id) filter (where section = 'usage'), '') as usage_studies,
        coalesce(string_agg(text, ' | ' order by length(reference_id), reference_id) filter (where section = 'other'), '') as other_sources
    from numbered group by 1"""


@query(_ROLLUP)
def citation_rollup(t: StandIns) -> DataFrame:
    return sinks.citation_rollup(t["references"])


def _headers(names: tuple[str, ...], label: str) -> str:
    return ",\n".join(
        f"min(value) filter (where component_name = '{n}') as \"{label.format(n)}\"" for n in names)


_BASE = [("s.name", "Name"), ("s.type", "Type"), ("s.country_code", "Country"), ("s.institution", "Institution"),
         ("s.availability", "Availability"), ("s.release_date", "Release Date"), ("s.tons_produced_mt", "Tons Produced (MT)"),
         ("s.specific_gravity", "Specific Gravity"), ("s.notes", "Notes"), ("s.lunar_sample_reference", "Lunar Sample Reference")]


@query(f"""with mineral as (select simulant_id, {_headers(_NATIONS, "Mineral: {} (%)")} from ({_FIRST_MINERAL}) group by 1),
    oxide as (select simulant_id, {_headers(_OXIDES, "Chemical: {} (wt%)")} from ({_FIRST_CHEM}) group by 1),
    cited as ({_ROLLUP}),
    joined as (
        select s.simulant_id as "Simulant ID",
            {", ".join(f'{e} as "{label}"' for e, label in _BASE)},
            {", ".join(f'm."Mineral: {n} (%)"' for n in _NATIONS)},
            {", ".join(f'o."Chemical: {n} (wt%)"' for n in _OXIDES)},
            coalesce(c.composition_sources, '') as "Composition Sources", coalesce(c.usage_studies, '') as "Usage Studies"
        from simulants s left join mineral m on m.simulant_id = s.simulant_id
        left join oxide o on o.simulant_id = s.simulant_id left join cited c on c.simulant_id = s.simulant_id)
    select * from joined""")
def wide_export(t: StandIns) -> DataFrame:
    return sinks.wide_export(t.catalog(), t["simulants"], _NATIONS, _OXIDES)


_CITATION = """coalesce(nullif(reference_text, ''), concat_ws(', ', nullif(authors, ''), '(' || year || ')', '"' || title || '"',
    'https://doi.org/' || nullif(doi, '')))"""


def _encoded(expr: str) -> str:
    out = f"url_encode({expr})"
    for code, plain in (("%21", "!"), ("%27", "''"), ("%28", "("), ("%29", ")"), ("%2A", "*")):
        out = f"replace({out}, '{code}', '{plain}')"
    return f"'https://scholar.google.com/scholar?q=' || {out}"


_TITLE = r"""trim(regexp_replace(case when length(regexp_extract(text, '^(.+?)(?:\(?\d{4}\)?)', 1)) > 10
    then regexp_extract(text, '^(.+?)(?:\(?\d{4}\)?)', 1) else substr(text, 1, 100) end, '[,.\s]+$', ''))"""


@query(rf"""with placed as (select simulant_id, reference_id, {_SECTION} as section, {_CITATION} as text from "references"),
    found as (select *, nullif(regexp_extract(text, 'https?://[^\s)]+', 0), '') as url,
                     'https://doi.org/' || nullif(regexp_extract(text, '10\.\d{{4,}}/[^\s)]+', 0), '') as doi from placed)
    select simulant_id, section, reference_id,
        row_number() over (partition by simulant_id, section order by length(reference_id), reference_id) as number,
        regexp_replace(trim(regexp_replace(replace(text, url, ''), '\s{{2,}}', ' ', 'g')), '\.$', '') as clean_text,
        coalesce(url, doi) as link, case when url is not null then 'Source' when doi is not null then 'DOI' end as link_label,
        {_encoded("substr(text, 1, 120)")} as search_link, {_encoded("'\"' || " + _TITLE + " || '\"'")} as cited_by_link
    from found""")
def citation_cards(t: StandIns) -> DataFrame:
    return detail.citation_cards(t["references"])


_GREEDY = """with recursive placed as (select *, row_number() over (order by ord) as i from points),
    walk(i, founders) as (
        select cast(0 as bigint), cast([] as struct(ord bigint, lat double, lon double)[])
        union all
        select p.i, case when len([f for f in w.founders
                if sqrt((f.lat - p.lat) * (f.lat - p.lat) + (f.lon - p.lon) * (f.lon - p.lon)) <= {radius}]) = 0
            then list_append(w.founders, {{'ord': p.ord, 'lat': p.lat, 'lon': p.lon}}) else w.founders end
        from walk w join placed p on p.i = w.i + 1),
    founder as (select unnest(founders, recursive := true) from (select founders from walk order by i desc limit 1)),
    member as (select p.ord, p.lat, p.lon, min(f.ord) as founder from points p join founder f
        on sqrt((f.lat - p.lat) * (f.lat - p.lat) + (f.lon - p.lon) * (f.lon - p.lon)) <= {radius} group by 1, 2, 3)
    """


@query(_GREEDY.format(radius=12.5) + "select ord, founder from member")
def cluster_members(t: StandIns) -> DataFrame:
    return cluster.cluster_members(t["points"], 12.5).select("ord", "founder")


@query(_GREEDY.format(radius=20.0)
       + """select founder, round(avg(lat), 4) as lat, round(avg(lon), 4) as lon, count(*) as count,
            20.0::double as radius, unnest([4.0, 6.5])::double as altitude from member group by founder""")
def clusters_by_altitude(t: StandIns) -> DataFrame:
    rows = cluster.clusters_by_altitude(t["points"], [4.0, 6.5])
    return rows.withColumns({"lat": F.round("lat", 4), "lon": F.round("lon", 4)})


_ORDERED = """select simulant_id, component_name, {value}, row_number() over (partition by simulant_id
        order by {value} desc, length(composition_id), composition_id, component_name) as position
    from {table} where {value} > 0{also}"""


@query(_ORDERED.format(value="value_pct", table="compositions", also=""))
def ordered_minerals(t: StandIns) -> DataFrame:
    return compose.ordered_components(t["compositions"], "value_pct").select("simulant_id", "component_name", "value_pct", "position")


@query(_ORDERED.format(value="value_wt_pct", table="chemical_compositions",
                       also=" and component_type = 'oxide' and component_name <> 'sum'"))
def ordered_chemistry(t: StandIns) -> DataFrame:
    rows = compose.ordered_components(t["chemical_compositions"], "value_wt_pct", oxides_only=True)
    return rows.select("simulant_id", "component_name", "value_wt_pct", "position")
