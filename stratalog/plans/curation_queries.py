"""Queries over curation jobs: integrity, linkage, merge, ids, append."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog import fixed
from stratalog.functions.labels import key_order
from stratalog.operators import linkage, merge, ordering, quality
from stratalog.plans import jobs
from stratalog.plans.registry import query
from stratalog.plans.standins import StandIns
from stratalog.sources import sinks
from stratalog.sources.catalog import Catalog


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def duplicate_keys(t: StandIns) -> DataFrame:
    return quality.duplicate_keys(t["lineitem"], ["l_orderkey", "l_linenumber"])


@query("""select composition_id, simulant_id, component_name from chemical_compositions
    where simulant_id not in (select simulant_id from simulant_extra)""")
def orphan_rows(t: StandIns) -> DataFrame:
    rows = quality.orphans(t["chemical_compositions"], t["simulant_extra"], "simulant_id", "simulant_id")
    return rows.select("composition_id", "simulant_id", "component_name")


@query("""select 'kept' as state, count(*) as n from chemical_compositions where simulant_id in (select simulant_id from simulant_extra)
    union all select 'quarantined', count(*) from chemical_compositions where simulant_id not in (select simulant_id from simulant_extra)""")
def enforced_key(t: StandIns) -> DataFrame:
    kept, bad = quality.enforced(t["chemical_compositions"], t["simulant_extra"], "simulant_id", "simulant_id")

    def counted(df: DataFrame, state: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(state).alias("state"), "n")

    return counted(kept, "kept").unionByName(counted(bad, "quarantined"))


@query("""select simulant_id as key, 'type' as field from simulants where coalesce(type, '') = ''
    union all select simulant_id, 'lunar_sample_reference' from simulants where coalesce(lunar_sample_reference, '') = ''""")
def missing_required(t: StandIns) -> DataFrame:
    return quality.missing_required(t["simulants"], ["type", "lunar_sample_reference"], "simulant_id")


@query("select coalesce(nullif(lunar_sample_reference, ''), 'null') as value, count(*) as n from simulants group by 1")
def value_distribution(t: StandIns) -> DataFrame:
    return quality.value_distribution(t["simulants"], "lunar_sample_reference")


@query("""select availability as value, count(*) as n from simulants
    where availability not in ('Available', 'Unknown', 'Production stopped', 'Limited Stock') group by 1""")
def nonstandard_values(t: StandIns) -> DataFrame:
    return quality.nonstandard_values(t["simulants"], "availability", fixed.STANDARD_AVAILABILITY)


@query("select d.doc_id, d.source from documents d where d.doc_id not in (select doc_id from labels)")
def unlabelled_documents(t: StandIns) -> DataFrame:
    return quality.without_children(t["documents"].select("doc_id", "source"), t["labels"], "doc_id", "doc_id")


def _coverage_sql(names: dict[str, str]) -> str:
    return " union all ".join(
        f"""select '{label}' as child, (select count(distinct simulant_id) from {table}) as covered,
            (select count(distinct simulant_id) from simulants where simulant_id not in (select simulant_id from {table})) as missing,
            (select count(distinct simulant_id) from simulants) as total"""
        for label, table in names.items())


@query(_coverage_sql({"compositions": "compositions", "chemical_compositions": "chemical_compositions",
                      "references": '"references"', "sites": "sites", "simulant_extra": "simulant_extra"}))
def coverage(t: StandIns) -> DataFrame:
    names = ("compositions", "chemical_compositions", "references", "sites", "simulant_extra")
    return quality.coverage(t["simulants"], {n: t[n] for n in names}, "simulant_id", "simulant_id")


def _short_catalog(t: StandIns) -> Catalog:
    """A catalogue whose entity table lost the entities without institution."""
    names = (*quality.CHILD_TABLES, "simulants")
    return Catalog({**{n: t[n] for n in names}, "simulants": t["simulants"].filter("institution is not null")})


def _orphan_sql(name: str) -> str:
    table = '"references"' if name == "references" else name
    return f"""select 'orphan:{name}' as "check", 'error' as severity, simulant_id as key, count(*) || ' rows' as detail
        from {table} where simulant_id not in (select simulant_id from entity) group by simulant_id"""


def _warn_sql(name: str) -> str:
    table = '"references"' if name == "references" else name
    return f"""select 'missing_child', 'warning', '{name}', count(*) || ' entities' from entity
        where simulant_id not in (select simulant_id from {table}) having count(*) > 0"""


_ISSUES = ("with entity as (select * from simulants where institution is not null), issue as ("
           + " union all ".join([_orphan_sql(n) for n in quality.CHILD_TABLES] + [_warn_sql(n) for n in quality.WARNED])
           + """ union all select 'nonstandard_availability', 'warning', availability, count(*) || ' records' from entity
               where availability = 'On request' group by availability)""")


@query(_ISSUES + " select * from issue")
def integrity_issues(t: StandIns) -> DataFrame:
    return quality.integrity_issues(_short_catalog(t))


@query(_ISSUES + """ select case when count(*) filter (where severity = 'error') = 0 then 'PASS' else 'FAIL' end as result,
    count(*) filter (where severity = 'error') as errors, count(*) filter (where severity = 'warning') as warnings from issue""")
def integrity_verdict(t: StandIns) -> DataFrame:
    return quality.verdict(quality.integrity_issues(_short_catalog(t)))


@query("""select 'composition_sum' as "check", 'error' as severity, simulant_id as key,
        cast(round(sum(value_pct), 4) as varchar) as detail from mineral_groups group by simulant_id having sum(value_pct) > 100 + 1e-6
    """)
def composition_sum_issues(t: StandIns) -> DataFrame:
    return quality.composition_sum_issues(t["mineral_groups"], "value_pct")


_COMPONENT_SUMS = """select 'composition_sum' as "check", 'error' as severity, simulant_id as key,
        cast(round(sum(value_pct), 4) as varchar) as detail from compositions group by simulant_id having sum(value_pct) > 100 + 1e-6"""


@query(_COMPONENT_SUMS)
def component_sum_issues(t: StandIns) -> DataFrame:
    """As `composition_sum_issues`, over the single minerals."""
    return quality.composition_sum_issues(t["compositions"], "value_pct")


@query(_ISSUES + f""", both_ as (select severity from issue union all select severity from ({_COMPONENT_SUMS}))
    select case when count(*) filter (where severity = 'error') = 0 then 'PASS' else 'FAIL' end as result,
    count(*) filter (where severity = 'error') as errors, count(*) filter (where severity = 'warning') as warnings from both_""")
def verdict_with_sums(t: StandIns) -> DataFrame:
    """The verdict over the integrity issues and the compositions above 100 %."""
    issues = quality.integrity_issues(_short_catalog(t))
    return quality.verdict(issues.unionByName(quality.composition_sum_issues(t["compositions"], "value_pct")))


@query("""select 'R' || lpad(cast(h.n + row_number() over (order by length(w.simulant_id), w.simulant_id) as varchar),
        cast(greatest(3, length(cast(h.n + 1 as varchar))) as int), '0') as reference_id, w.simulant_id, w.name
    from word_names w, (select max(try_cast(substr(reference_id, 2) as bigint)) as n from "references") h""")
def new_keys(t: StandIns) -> DataFrame:
    names = t["word_names"].select("simulant_id", "name")
    return ordering.with_new_keys(names, t["references"], "reference_id", "R", key_order(F.col("simulant_id")))


@query("""select simulant_id, count(*) as n from (select simulant_id from "references"
    union all select simulant_id from word_names) group by 1""")
def appended_rows(t: StandIns) -> DataFrame:
    new = t["word_names"].select(
        "simulant_id", F.col("name").alias("reference_text"), F.lit("general").alias("reference_type"),
        F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("authors"),
        F.lit(None).cast("int").alias("year"), F.lit(None).cast("string").alias("doi"), F.lit(None).cast("string").alias("url"))
    grown = merge.appended(t["references"], new, "reference_id", "R", key_order(F.col("simulant_id")))
    return grown.groupBy("simulant_id").agg(F.count(F.lit(1)).alias("n"))


@query("""with new_ as (select 'S' || cast(floor(c_custkey / 3) as bigint) as simulant_id, c_name as vendor from customer
        qualify row_number() over (partition by floor(c_custkey / 3) order by c_acctbal desc, c_custkey desc) = 1)
    select simulant_id, vendor from new_ union all
    select simulant_id, vendor from purchase_info where simulant_id not in (select simulant_id from new_)""")
def upserted_rows(t: StandIns) -> DataFrame:
    new = t["customer"].select(
        F.concat(F.lit("S"), F.floor(F.col("c_custkey") / 3).cast("string")).alias("simulant_id"),
        F.col("c_name").alias("vendor"), "c_acctbal", "c_custkey")
    old = t["purchase_info"].select("simulant_id", "vendor", F.lit(None).cast("double").alias("c_acctbal"),
                                    F.lit(None).cast("bigint").alias("c_custkey"))
    merged = sinks.upserted(old, new, ["simulant_id"], [F.col("c_acctbal"), F.col("c_custkey")])
    return merged.select("simulant_id", "vendor")


@query("""select event_id, user_id, last_value(case when event_type = 'purchase' then value end ignore nulls)
        over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as last_purchase
    from events""")
def forward_filled(t: StandIns) -> DataFrame:
    bought = F.when(F.col("event_type") == "purchase", F.col("value"))
    rows = t["events"].select("event_id", "user_id", "ts", bought.alias("last_purchase"))
    filled = ordering.forward_filled(rows, "last_purchase", [F.col("ts"), F.col("event_id")], ["user_id"])
    return filled.select("event_id", "user_id", "last_purchase")


_FIRST_NOTE = "min_by({c}, ord) filter (where {c} is not null and {c} not in ('', 'null'))"


@query(f"""select classification as type, {_FIRST_NOTE.format(c="notes")} as notes, {_FIRST_NOTE.format(c="institution")} as institution
    from sheet group by classification""")
def first_values(t: StandIns) -> DataFrame:
    firsts = merge.first_values(t["sheet"], ["classification"], ["notes", "institution"])
    return firsts.select(F.col("classification").alias("type"), F.col("notes.v").alias("notes"),
                         F.col("institution.v").alias("institution"))


_LINKS = """
    sheet_name as (select distinct name from sheet),
    exact as (select n.name, s.simulant_id, 'exact' as stage from sheet_name n join simulants s on s.name = n.name),
    open1 as (select name from sheet_name where name not in (select name from exact)),
    aliased as (select distinct o.name, s.simulant_id, 'alias' as stage from open1 o join aliases a on a.name = o.name
                join simulants s on s.name = a.target),
    open2 as (select name from open1 where name not in (select name from aliases)),
    folded as (select o.name, s.simulant_id, 'case' as stage from open2 o join simulants s on lower(s.name) = lower(o.name)),
    link as (select * from exact union all select * from aliased union all select * from folded)"""


def _links(t: StandIns) -> DataFrame:
    return linkage.link_names(t["sheet"], t["simulants"], t["aliases"], fuzzy=False)


@query(f"with {_LINKS} select * from link")
def link_names(t: StandIns) -> DataFrame:
    return _links(t)


@query()
def link_names_fuzzy(t: StandIns) -> DataFrame:
    """All four stages. The similarity ratio has no SQL form: tested against brute force."""
    return linkage.link_names(t["sheet"], t["simulants"], t["aliases"])


def _filled_sql(fields: dict[str, str], target: str, key_columns: str) -> str:
    parsed = ", ".join(f"{e} as {f}" for f, e in fields.items())
    per_name = ", ".join(
        f"min_by({f}, ord) filter (where {f} is not null and cast({f} as varchar) not in ('', 'null')) as {f}, "
        f"min(ord) filter (where {f} is not null and cast({f} as varchar) not in ('', 'null')) as o_{f}" for f in fields)
    per_entity = ", ".join(f"min_by({f}, o_{f}) filter (where {f} is not null) as {f}" for f in fields)
    miss = "({t}.{f} is null or cast({t}.{f} as varchar) in ('', 'null'))"
    out = ", ".join(
        f"case when {miss.format(t='t', f=f)} and n.{f} is not null then n.{f} else t.{f} end as {f}" for f in fields)
    count = " + ".join(f"cast({miss.format(t='t', f=f)} and n.{f} is not null as int)" for f in fields)
    return f"""with {_LINKS},
        parsed as (select name, ord, {parsed} from sheet),
        per_name as (select name, {per_name} from parsed group by name),
        per_entity as (select simulant_id, {per_entity} from link join per_name using (name) group by simulant_id)
        select t.simulant_id, {key_columns} {out}, {count} as n_filled
        from {target} t left join per_entity n on n.simulant_id = t.simulant_id"""


_ENTITY_SQL = {
    "type": "type", "institution": "institution",
    "availability": "case stage when 'Limited stock' then 'Limited Stock' else stage end",
    "release_date": "cast(try_cast(release_date as bigint) as varchar)", "notes": "notes",
    "specific_gravity": "try_cast(specific_gravity as double)",
}
_EXTRA_SQL = {
    "classification": "classification", "application": "application", "feedstock": "feedstock", "replica_of": "replica_of",
    "grain_size_mm": "grain_size_mm", "petrographic_class": "petrographic_class", "reference": "reference",
}


_FILLED_ENTITIES = _filled_sql(_ENTITY_SQL, "simulants", "")
_FILLED_EXTRAS = _filled_sql(_EXTRA_SQL, "simulant_extra", "t.publicly_available_composition,")


@query(_FILLED_ENTITIES)
def merged_entities(t: StandIns) -> DataFrame:
    entities, _ = merge.merge_entities(t["sheet"], _links(t), t["simulants"], t["simulant_extra"])
    return entities.select("simulant_id", *_ENTITY_SQL, F.size("filled_fields").alias("n_filled"))


@query(_FILLED_EXTRAS)
def merged_extras(t: StandIns) -> DataFrame:
    _, extras = merge.merge_entities(t["sheet"], _links(t), t["simulants"], t["simulant_extra"])
    return extras.select("simulant_id", "publicly_available_composition", *_EXTRA_SQL, F.size("filled_fields").alias("n_filled"))


_CLAIM = """usable as (select name, min(ord) as ord from sheet where {usable} group by name),
    claim as (select simulant_id, min(u.ord) as ord from link join usable u using (name)
              where simulant_id not in (select simulant_id from {existing}) group by simulant_id),
    cell as (select c.simulant_id, s.{column} as raw from claim c join sheet s on s.ord = c.ord)"""


_NEW_MINERALS = f"""{_CLAIM.format(usable="mineral_composition_raw like '{%'", existing="compositions", column="mineral_composition_raw")},
    fixed_ as (select simulant_id, case when json_valid(raw) then raw else rtrim(raw, ',') || '}}}}' end as raw from cell),
    grp as (select simulant_id, unnest(json_keys(raw)) as grp, raw from fixed_),
    inner_ as (select simulant_id, grp, json_extract(raw, '$.' || grp) as cell from grp),
    item as (select simulant_id, grp, unnest(json_keys(cell)) as component_name, cell from inner_ where json_type(cell) = 'OBJECT'),
    new_mineral as (
        select simulant_id, 'mineral' as component_type, component_name,
               cast(json_extract_string(cell, '$.' || component_name) as double) as value_pct, grp as "group"
        from item where cast(json_extract_string(cell, '$.' || component_name) as double) > 0)"""


_MERGED_MINERALS = f"with {_LINKS}, {_NEW_MINERALS} select * from new_mineral"


@query(_MERGED_MINERALS)
def merged_minerals(t: StandIns) -> DataFrame:
    return merge.merge_minerals(t["sheet"], _links(t), t["compositions"])


_MERGED_CHEMISTRY = f"""with {_LINKS}, {_CLAIM.format(usable="chemical_composition_raw like '{%' or chemical_composition_raw like '%;%'", existing="chemical_compositions", column="chemical_composition_raw")}
    select simulant_id, 'oxide' as component_type, 'SiO2' as component_name,
           cast(regexp_extract(raw, '([0-9]+[.]5)', 1) as double) as value_wt_pct from cell
    union all select simulant_id, 'oxide', 'Al2O3', 12.3::double from cell where raw like '%Al2O3%'"""


@query(_MERGED_CHEMISTRY)
def merged_chemistry(t: StandIns) -> DataFrame:
    return merge.merge_chemistry(t["sheet"], _links(t), t["chemical_compositions"])


@query("""with r1 as (select lower(name) as key, min_by(name, ord) as name, min_by(source_mineral, ord) as source_mineral,
            min_by(mining_locations, ord) filter (where mining_locations is not null) as mining_locations,
            min_by(mining_company, ord) as mining_company from refined_sheet group by 1),
    filled as (select *, last_value(constituent ignore nulls) over (order by ord rows between unbounded preceding and current row) as c
               from preliminary_sheet),
    r2 as (select lower(c) as key, min_by(supplier, ord) as supplier, min_by(chemistry, ord) as chemistry,
            min_by(description, ord) filter (where description is not null) as description,
            min_by(further_reading, ord) as further_reading from filled where c is not null group by 1)
    select coalesce(m.mineral_name, r1.name) as mineral_name,
        case when m.source_mineral is null and r1.source_mineral is not null then r1.source_mineral
             else coalesce(m.chemistry, r2.chemistry) end as chemistry,
        coalesce(m.source_mineral, r1.source_mineral) as source_mineral,
        coalesce(m.description, r2.description) as description,
        coalesce(m.mining_locations, r1.mining_locations) as mining_locations,
        coalesce(m.mining_company, r1.mining_company) as mining_company, m.mine_active,
        coalesce(m.supplier, r2.supplier) as supplier, coalesce(m.further_reading, r2.further_reading) as further_reading
    from mineral_sourcing m full outer join r1 on r1.key = lower(m.mineral_name)
    left join r2 on r2.key = coalesce(lower(m.mineral_name), r1.key)""")
def merged_sourcing(t: StandIns) -> DataFrame:
    return merge.merge_sourcing(t["mineral_sourcing"], t["refined_sheet"], t["preliminary_sheet"]).select(
        "mineral_name", "chemistry", "source_mineral", "description", "mining_locations", "mining_company", "mine_active",
        "supplier", "further_reading")


@query(f"""with {_LINKS}
    select 'rows_matched' as measure, count(*) as n from sheet where name in (select name from link)
    union all select 'rows_unmatched', count(*) from sheet where name not in (select name from link)
    union all select 'fields_filled', cast((select sum(n_filled) from ({_FILLED_ENTITIES})) + (select sum(n_filled) from ({_FILLED_EXTRAS})) as bigint)
    union all select 'minerals_added', (select count(*) from ({_MERGED_MINERALS}))
    union all select 'chemistry_added', (select count(*) from ({_MERGED_CHEMISTRY}))""")
def merge_row_statistics(t: StandIns) -> DataFrame:
    links = _links(t)
    entities, extras = merge.merge_entities(t["sheet"], links, t["simulants"], t["simulant_extra"])
    minerals = merge.merge_minerals(t["sheet"], links, t["compositions"])
    chemistry = merge.merge_chemistry(t["sheet"], links, t["chemical_compositions"])
    return merge.merge_statistics(t["sheet"], links, entities, extras, minerals, chemistry)


@query(f"""with {_LINKS}, {_NEW_MINERALS},
    after_ as (select simulant_id from compositions union all select simulant_id from new_mineral)
    select 'rows' as measure, count(*) as n from after_ union all select 'entities', count(distinct simulant_id) from after_
    union all select 'missing', count(*) from simulants where simulant_id not in (select simulant_id from after_)""")
def curated_mineralogy(t: StandIns) -> DataFrame:
    """The whole merge job, seen through the mineral table it returns."""
    done = jobs.curate(t.catalog(), t["sheet"], t["aliases"], fuzzy=False).catalog
    rows = done.compositions.select(F.lit("rows").alias("measure"))
    entities = done.compositions.select("simulant_id").distinct().select(F.lit("entities").alias("measure"))
    missing = quality.without_children(done.simulants, done.compositions, "simulant_id", "simulant_id")
    tagged = rows.unionByName(entities).unionByName(missing.select(F.lit("missing").alias("measure")))
    return tagged.groupBy("measure").agg(F.count(F.lit(1)).alias("n"))
