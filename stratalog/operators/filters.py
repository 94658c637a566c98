"""Faceted filters and free-text search over the entity table.

Filters are joined by AND, the values of one filter by OR; a filter without values
does nothing. Predicates on entity columns become plain column filters, which reach
the scan; predicates on child rows become semi-joins against child ids that were made
distinct first, so a hot entity costs one row per task.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog import fixed
from stratalog.functions.citations import citation_text
from stratalog.functions.labels import contains_folded
from stratalog.functions.numbers import integer_text
from stratalog.sources.catalog import Catalog

BLOC = "EU"
NASA_ANY = "NASA (all)"
GROUP_MARK = "group:"
SEARCHED = ("name", "country_code", "type", "institution")


@dataclass(frozen=True)
class Filter:
    """One facet: categorical values, ('yes'|'no',), (query,) or (min year, max year)."""

    property: str
    values: tuple[str, ...] = ()


def bloc_values() -> list[str]:
    """Codes and names of the bloc's members, as entity rows hold either."""
    return [BLOC, *fixed.EU_MEMBERS, *fixed.EU_MEMBERS.values()]


def search_predicate(query: str, columns: Sequence[str] = SEARCHED) -> Column:
    hit = F.lit(False)
    for c in columns:
        hit = hit | contains_folded(F.col(c), query)
    return hit


def year_predicate(release_date: Column, low: str | None, high: str | None) -> Column:
    """Inclusive range, either bound optional; entities without a numeric year never pass."""
    year = integer_text(release_date)
    ok = year.isNotNull()
    if low:
        ok = ok & (year >= int(low))
    if high:
        ok = ok & (year <= int(high))
    return ok


def column_predicate(f: Filter, bloc: Sequence[str]) -> Column | None:
    """The filter as a predicate on entity columns, or None when it needs child rows."""
    values = list(f.values)
    if f.property in ("type", "availability"):
        return F.col(f.property).isin(values)
    if f.property == "country":
        return F.col("country_code").isin(values + (list(bloc) if BLOC in values else []))
    if f.property == "institution":
        institution = F.coalesce(F.col("institution"), F.lit(""))
        hit = institution.isin(values)
        return hit | F.lower(institution).contains("nasa") if NASA_ANY in values else hit
    if f.property == "year":
        low, high = (values + ["", ""])[:2]
        return year_predicate(F.col("release_date"), low, high)
    if f.property == "lunar_ref":
        return F.coalesce(F.col("lunar_sample_reference"), F.lit("")).isin(values)
    return None


def positive_components(df: DataFrame, value: str, oxides_only: bool = False) -> DataFrame:
    """Component rows with a positive value; for oxides also without the 'sum' row."""
    rows = df.filter(F.col(value) > 0)
    if oxides_only:
        rows = rows.filter((F.col("component_type") == "oxide") & (F.col("component_name") != "sum"))
    return rows


def entity_ids(df: DataFrame) -> DataFrame:
    return df.select("simulant_id").distinct()


def mineral_ids(catalog: Catalog, values: Iterable[str]) -> DataFrame:
    """Entities with a chosen mineral, or a chosen group, at a positive value."""
    groups = [v[len(GROUP_MARK):] for v in values if v.startswith(GROUP_MARK)]
    minerals = [v for v in values if not v.startswith(GROUP_MARK)]
    detailed = catalog.compositions.filter(F.col("component_name").isin(minerals) & (F.col("value_pct") > 0))
    grouped = catalog.mineral_groups.filter(F.col("group_name").isin(groups) & (F.col("value_pct") > 0))
    return entity_ids(detailed.select("simulant_id").unionByName(grouped.select("simulant_id")))


def reference_ids(references: DataFrame, query: str, structured: bool = False) -> DataFrame:
    """Entities with a citation whose text holds the query; a missing text holds nothing."""
    text = F.col("reference_text")
    if structured:
        text = citation_text(text, F.col("authors"), F.col("year"), F.col("title"), F.col("doi"))
    return entity_ids(references.filter(contains_folded(text, query)))


def apply_filters(
    catalog: Catalog,
    filters: Sequence[Filter] = (),
    search: str = "",
    literal_mineral: bool = False,
    bloc: DataFrame | Sequence[str] | None = None,
) -> DataFrame:
    """Entities that pass the search and every filter.

    ``bloc`` names the members of the country bloc: a list, or a table (country_code).

    ``literal_mineral`` keeps a known quirk: a mineral filter that names only
    minerals, or only groups, then excludes nothing.
    """
    active = [f for f in filters if f.values]
    out = catalog.simulants
    if search:
        out = out.filter(search_predicate(search))
    members = bloc_values() if bloc is None else bloc
    for f in active:
        if f.property == "country" and BLOC in f.values and isinstance(members, DataFrame):
            flagged = members.select("country_code").distinct().withColumn("_member", F.lit(True))
            out = out.join(flagged, "country_code", "left").filter(
                F.col("_member") | F.col("country_code").isin(list(f.values))).select(*catalog.simulants.columns)
            continue
        predicate = column_predicate(f, () if isinstance(members, DataFrame) else members)
        if predicate is not None:
            out = out.filter(predicate)
    for f in active:
        first = f.values[0]
        if f.property == "mineral":
            kinds = {v.startswith(GROUP_MARK) for v in f.values}
            if not (literal_mineral and len(kinds) == 1):
                out = out.join(mineral_ids(catalog, f.values), "simulant_id", "left_semi")
        elif f.property == "chemical":
            rows = catalog.chemical_compositions.filter(
                F.col("component_name").isin(list(f.values)) & (F.col("value_wt_pct") > 0)
            )
            out = out.join(entity_ids(rows), "simulant_id", "left_semi")
        elif f.property in ("has_chemistry", "has_mineralogy"):
            rows = catalog.chemical_compositions if f.property == "has_chemistry" else catalog.compositions
            out = out.join(entity_ids(rows), "simulant_id", "left_semi" if first == "yes" else "left_anti")
        elif f.property == "reference" and first:
            out = out.join(reference_ids(catalog.references, first), "simulant_id", "left_semi")
    return out


def result_counter(entities: DataFrame, predicate: Column) -> DataFrame:
    """'shown of total' in one pass."""
    return entities.agg(F.count_if(predicate).alias("shown"), F.count(F.lit(1)).alias("total"))


def located(sites: DataFrame) -> DataFrame:
    return sites.dropna(subset=["lat", "lon"])


def profiles_with_chemistry(profiles: DataFrame) -> DataFrame:
    return profiles.filter(F.coalesce(F.size("chemical_composition"), F.lit(0)) > 0)


def by_key(df: DataFrame, column: str, value: object) -> DataFrame:
    """Point lookup; the equality is pushed to the scan."""
    return df.filter(F.col(column) == F.lit(value))
