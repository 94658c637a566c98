"""Entity detail: child rows, 1:1 attachments, catalogue table, sorting, map points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog import fixed
from stratalog.functions.citations import citation_text, doi_link, first_url, text_search_link, text_without_url, title_search_link
from stratalog.functions.labels import (
    availability_badge, country_display, inferred_mission, institution_url, key_order, merged_label, rocks_label,
    site_colour, type_colour,
)
from stratalog.functions.numbers import integer_text, mass_kg, plain_number, prefix_number, strict_number
from stratalog.operators.filters import entity_ids, located
from stratalog.operators.ordering import first_per_key, last_per_key, with_position
from stratalog.sources.catalog import Catalog


def numbered_children(children: DataFrame, key: str) -> DataFrame:
    """Child rows with their place in the entity's list.

    The list stays a long table: an entity may own a third of all child rows, which no
    single array should hold.
    """
    return with_position(children, key_order(F.col(key)), within=["simulant_id"])


def attach_last(entities: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """Left join the last row (by key) a 1:1 table holds for each entity."""
    last = last_per_key(side, ["simulant_id"], key_order(F.col(key)))
    clash = [c for c in last.columns if c != "simulant_id" and c in entities.columns]
    return entities.join(last.drop(*clash), "simulant_id", "left")


def with_flag(entities: DataFrame, children: DataFrame, name: str) -> DataFrame:
    """Whether the entity has any child row."""
    ids = entity_ids(children).withColumn(name, F.lit(True))
    return entities.join(ids, "simulant_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def first_reference(references: DataFrame) -> DataFrame:
    first = first_per_key(
        references.select("simulant_id", "reference_id", "reference_text"),
        ["simulant_id"],
        key_order(F.col("reference_id")),
    )
    return first.select("simulant_id", F.coalesce("reference_text", F.lit("")).alias("first_reference"))


def catalogue_table(catalog: Catalog, entities: DataFrame) -> DataFrame:
    """The entity list with data flags, year and first citation: one shuffle per table."""
    rows = entities.select(
        "simulant_id", "name", "type", "country_code", "institution", "availability", "lunar_sample_reference",
        integer_text(F.col("release_date")).alias("year"),
        country_display(F.col("country_code")).alias("country"),
    )
    rows = with_flag(rows, catalog.chemical_compositions, "has_chemistry")
    rows = with_flag(rows, catalog.compositions, "has_mineralogy")
    return rows.join(first_reference(catalog.references), "simulant_id", "left").withColumn(
        "first_reference", F.coalesce("first_reference", F.lit(""))
    )


def _folded(c: Column) -> Column:
    """Lower case in language order, so that 'É' sorts next to 'e'."""
    return F.collate(F.lower(F.coalesce(c, F.lit(""))), "UNICODE")


def catalogue_order(key: str, descending: bool = False) -> list[Column]:
    """Sort expressions of the catalogue table, ended by the id so the order is total.

    Entities without a year or a citation come last in both directions.
    """
    exprs = {
        **{k: _folded(F.col(k)) for k in ("name", "type", "country", "institution", "availability", "lunar_sample_reference")},
        "year": F.col("year"),
        "has_chemistry": F.col("has_chemistry").cast("int"),
        "has_mineralogy": F.col("has_mineralogy").cast("int"),
        "reference": F.when(F.col("first_reference") != "", _folded(F.col("first_reference"))),
    }
    e = exprs[key]
    return [e.desc_nulls_last() if descending else e.asc_nulls_last(), *key_order(F.col("simulant_id"))]


def site_order(key: str, descending: bool = False, as_text: bool = False) -> list[Column]:
    """Sort expressions of the landing-site table; dates and masses by value unless ``as_text``."""
    exprs = {
        "name": _folded(F.col("name")),
        "mission": _folded(F.col("mission")),
        "type": _folded(F.col("type")),
        "date": F.collate(F.col("date"), "UNICODE") if as_text else F.try_to_date("date", "MMMM d, yyyy"),
        "samples": _folded(F.col("samples_returned")) if as_text else mass_kg(F.col("samples_returned")),
    }
    e = exprs[key]
    return [e.desc_nulls_last() if descending else e.asc_nulls_last(), F.col("id")]


def landing_sites(sites: DataFrame) -> DataFrame:
    """Landing sites with typed date and mass, and their colour class."""
    return sites.select(
        "*",
        F.try_to_date("date", "MMMM d, yyyy").alias("landed_on"),
        mass_kg(F.col("samples_returned")).alias("samples_kg"),
        site_colour(F.col("type")).alias("colour"),
    )


def map_points(catalog: Catalog, entities: DataFrame) -> DataFrame:
    """Entities at the coordinates of their last site, with a colour class."""
    last = located(last_per_key(catalog.sites, ["simulant_id"], key_order(F.col("site_id"))))
    points = entities.select("simulant_id", "name", "country_code", "type").join(
        last.select("simulant_id", "site_name", "lat", "lon"), "simulant_id"
    )
    return points.withColumn("colour", type_colour(F.col("type")))


def mineral_sourcing(compositions: DataFrame, sourcing: DataFrame, alternate: str | None = None) -> DataFrame:
    """Component rows with the sourcing record of their mineral, matched without case.

    ``alternate`` names a second column to match by where the first finds nothing.
    """
    key = F.lower("mineral_name").alias("_key")
    last = last_per_key(sourcing.select("*", key), ["_key"], [F.col("mineral_name")])
    fields = [c for c in sourcing.columns if c != "mineral_name"]
    first = last.select("_key", F.struct("mineral_name", *fields).alias("_first"))
    rows = compositions.join(first, F.lower("component_name") == F.col("_key"), "left").drop("_key")
    hit = F.col("_first")
    if alternate:
        second = last.select("_key", F.struct("mineral_name", *fields).alias("_second"))
        rows = rows.join(second, F.lower(alternate) == F.col("_key"), "left").drop("_key")
        hit = F.coalesce("_first", "_second")
    found = rows.withColumn("_hit", hit).filter(F.col("_hit").isNotNull())
    named = found.select(
        *compositions.columns,
        F.col("_hit.mineral_name").alias("sourcing_name"),
        *[F.col(f"_hit.{c}").alias(c) for c in fields],
    )
    return named


def physical_properties(catalog: Catalog, entities: DataFrame) -> DataFrame:
    """(simulant_id, property, label, unit, value): the known properties in long form."""
    extra = first_per_key(
        catalog.simulant_extra.select("simulant_id", "grain_size_mm"), ["simulant_id"], [F.col("grain_size_mm")]
    )
    rows = entities.join(extra, "simulant_id", "left")
    prefixed = ("cohesion", "friction_angle")
    texts = ("particle_size_distribution", "particle_morphology", "particle_ruggedness", "grain_size_mm")

    def shown(name: str) -> Column:
        if name in texts:
            return F.col(name).cast("string")
        return plain_number((prefix_number if name in prefixed else strict_number)(F.col(name)))

    triples = F.array(*[
        F.struct(F.lit(p).alias("property"), F.lit(label).alias("label"), F.lit(unit).alias("unit"),
                 shown(p).alias("value"))
        for p, (label, unit) in fixed.PHYSICAL_PROPERTIES.items()
    ])
    return rows.select("simulant_id", F.inline(F.filter(triples, lambda t: t["value"].isNotNull())))


def citation_section(reference_type: Column) -> Column:
    """composition, usage (also untyped) or other."""
    return (
        F.when(reference_type == "composition", "composition")
        .when((reference_type == "usage") | (F.coalesce(reference_type, F.lit("")) == ""), "usage")
        .otherwise("other")
    )


def citation_cards(references: DataFrame) -> DataFrame:
    """Citations as shown: number inside their section, text, link and search links."""
    text = citation_text(F.col("reference_text"), F.col("authors"), F.col("year"), F.col("title"), F.col("doi"))
    rows = references.select(
        "simulant_id", "reference_id", citation_section(F.col("reference_type")).alias("section"), text.alias("text")
    )
    numbered = with_position(rows, key_order(F.col("reference_id")), ["simulant_id", "section"], "number")
    url, doi = first_url(F.col("text")), doi_link(F.col("text"))
    return numbered.select(
        "simulant_id", "section", "number", "reference_id",
        text_without_url(F.col("text")).alias("clean_text"),
        F.coalesce(url, doi).alias("link"),
        F.when(doi.isNotNull() & url.isNull(), "DOI").when(url.isNotNull(), "Source").alias("link_label"),
        text_search_link(F.col("text")).alias("search_link"),
        title_search_link(F.col("text")).alias("cited_by_link"),
    )


def _child_count(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("simulant_id").agg(F.count(F.lit(1)).alias(name))


def entity_cards(catalog: Catalog, entities: DataFrame) -> DataFrame:
    """Everything 1:1 about an entity, and how many child rows it has.

    Child rows themselves stay long tables (see `numbered_children`, `citation_cards`).
    Every side is reduced to one row per entity before its join.
    """
    extra = last_per_key(catalog.simulant_extra, ["simulant_id"], [F.col("name")]).select(
        "simulant_id", "classification", "application", "feedstock", "replica_of", "petrographic_class"
    )
    site = last_per_key(catalog.sites, ["simulant_id"], key_order(F.col("site_id"))).select(
        "simulant_id", "site_name", "lat", "lon"
    )
    purchase = last_per_key(catalog.purchase_info, ["simulant_id"], [F.col("vendor")])
    rows = entities.select(
        "simulant_id", "name", "type", "country_code", "institution", "availability", "release_date",
        "tons_produced_mt", "lunar_sample_reference",
    )
    for side in (
        extra, site, purchase,
        _child_count(catalog.chemical_compositions, "n_chemical"),
        _child_count(catalog.compositions, "n_mineral"),
        _child_count(catalog.mineral_groups, "n_group"),
        _child_count(catalog.references, "n_reference"),
    ):
        rows = rows.join(side, "simulant_id", "left")
    rows = rows.fillna(0, ["n_chemical", "n_mineral", "n_group", "n_reference"])
    return rows.select(
        *[c for c in rows.columns if c not in ("replica_of", "petrographic_class", "lunar_sample_reference")],
        merged_label(F.col("lunar_sample_reference"), F.col("replica_of")).alias("sample_reference"),
        rocks_label(F.col("petrographic_class")).alias("petrography"),
        institution_url(F.col("institution")).alias("institution_url"),
        inferred_mission(F.col("lunar_sample_reference")).alias("inferred_mission"),
        availability_badge(F.col("availability")).alias("badge"),
    )
