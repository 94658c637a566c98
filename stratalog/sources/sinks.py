"""Writers: typed tables with upsert, bundle export, wide CSV, snapshots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog import fixed, schemas
from stratalog.functions.labels import key_order
from stratalog.functions.numbers import decimal_text, integer_text, plain_number
from stratalog.operators.compose import first_components
from stratalog.operators.detail import citation_section
from stratalog.operators.facets import bounded_names
from stratalog.operators.ordering import last_per_key, with_position
from stratalog.sources.catalog import Catalog
from stratalog.sources.documents import as_documents


def conformed(df: DataFrame, table: str) -> DataFrame:
    """The declared columns of a table in order; columns the rows lack are null."""
    have = set(df.columns)
    return df.select([
        (F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schemas.TABLES[table][0]
    ])


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[F.Column]) -> DataFrame:
    """Old rows, replaced or joined by the last new row per key."""
    latest = last_per_key(new, keys, order)
    return old.join(latest.select(*keys), list(keys), "left_anti").unionByName(latest)


def write_table(df: DataFrame, path: str, table: str) -> None:
    """Write a table to a new path in its declared schema."""
    conformed(df, table).write.mode("errorifexists").parquet(path)


def snapshot(df: DataFrame, folder: str, label: str) -> str:
    """Keep a copy under a new version path; an existing version is never overwritten."""
    path = f"{folder.rstrip('/')}/version={label}"
    df.write.mode("errorifexists").parquet(path)
    return path


def exported_simulants(simulants: DataFrame) -> DataFrame:
    """Entity rows with numbers where the text spells one; the texts stay beside them."""
    numbers = [decimal_text(F.col(c)).alias(f"{c}_number") for c in ("bulk_density", "cohesion", "friction_angle")]
    return simulants.select("*", integer_text(F.col("release_date")).alias("release_year"), *numbers)


def relational_profiles(profiles: DataFrame) -> DataFrame:
    """Nested profile fields as JSON text."""
    nested = ("coordinates", "chemical_composition", "mineral_composition", "sources")
    return profiles.select(*[F.to_json(c).alias(c) if c in nested else c for c in profiles.columns])


def decoded_profiles(rows: DataFrame) -> DataFrame:
    """JSON text back to nested fields: blank gives an empty map or list, blank minerals stay null."""
    def blank(c: str) -> F.Column:
        return F.nullif(F.trim(c), F.lit(""))

    decoded = {
        "coordinates": F.from_json(F.coalesce(blank("coordinates"), F.lit("{}")), "struct<lat: double, lon: double>"),
        "chemical_composition": F.from_json(F.coalesce(blank("chemical_composition"), F.lit("{}")), "map<string, double>"),
        "mineral_composition": F.from_json(blank("mineral_composition"), "map<string, double>"),
        "sources": F.from_json(F.coalesce(blank("sources"), F.lit("[]")), "array<string>"),
    }
    return rows.select(*[decoded.get(c, F.col(c)).alias(c) for c in rows.columns])


def bundle_tables(catalog: Catalog) -> dict[str, DataFrame]:
    """The tables of the bundle: sites without coordinates left out, each in key order."""
    out = {}
    for name, (_, keys) in schemas.TABLES.items():
        df = catalog.tables[name]
        if name == "sites":
            df = df.dropna(subset=["lat", "lon"])
        if name == "simulants":
            df = exported_simulants(df)
        out[name] = df.orderBy(*[e for k in keys for e in key_order(F.col(k))])
    return out


def write_bundle(catalog: Catalog, folder: str) -> None:
    """One folder of JSON lines per table; the global sort keeps key order across the files."""
    for name, df in bundle_tables(catalog).items():
        df.write.mode("errorifexists").json(f"{folder.rstrip('/')}/{name}")


def write_bundle_documents(catalog: Catalog, folder: str) -> None:
    """The bundle as JSON documents that `Catalog.load_bundle` reads back from the folder. Every part file with rows is a whole
    document with the next rows of its table, so none passes through one task and key order holds from file to file."""
    for name, df in bundle_tables(catalog).items():
        as_documents(df, name).write.mode("errorifexists").text(f"{folder.rstrip('/')}/{name}")


#: Citations that are joined to one text before the texts of an entity are.
_JOINED_TOGETHER = 1000


def citation_rollup(references: DataFrame) -> DataFrame:
    """(simulant_id, composition_sources, usage_studies, other_sources): one row per entity.

    Texts are joined by ' | ' in citation order, first in parts and in parallel, then the few texts of an entity's parts. A cell
    is as long as its citations; beyond it no task holds an entity's citations.
    """
    rows = references.select(
        "simulant_id", "reference_id", citation_section(F.col("reference_type")).alias("section"),
        F.coalesce("reference_text", F.lit("")).alias("text"),
    )
    placed = with_position(rows, key_order(F.col("reference_id")), ["simulant_id", "section"], "number")
    part = F.floor((F.col("number") - 1) / _JOINED_TOGETHER).alias("part")

    def joined(place: str, section: str, name: str) -> F.Column:
        own = F.collect_list(F.when(F.col("section") == section, F.struct(place, "text")))
        return F.array_join(F.transform(F.array_sort(own), lambda x: x["text"]), " | ").alias(name)

    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "text"))), lambda x: x["text"]), " | ")
    parts = placed.groupBy("simulant_id", "section", part).agg(whole.alias("text"))
    return parts.groupBy("simulant_id").agg(
        joined("part", "composition", "composition_sources"), joined("part", "usage", "usage_studies"),
        joined("part", "other", "other_sources"))


def pivoted(components: DataFrame, value: str, names: Sequence[str], label: str) -> DataFrame:
    """One column per component name holding the entity's first value."""
    rows = first_components(components.filter(F.col("component_name").isin(list(names))), value)
    wide = rows.groupBy("simulant_id").pivot("component_name", list(names)).agg(F.first("value"))
    return wide.select("simulant_id", *[F.col(f"`{n}`").alias(label.format(n)) for n in names])


def wide_export(
    catalog: Catalog,
    entities: DataFrame,
    minerals: Sequence[str] | None = None,
    oxides: Sequence[str] | None = None,
) -> DataFrame:
    """The wide table: base columns, one column per mineral and oxide, citation texts.

    Works over any set of entities: all, filtered, or chosen by id. One row per entity.
    """
    chosen = entities.select("simulant_id").distinct()

    def own(df: DataFrame) -> DataFrame:
        return df.join(chosen, "simulant_id", "left_semi")

    oxide_rows = catalog.chemical_compositions.filter("component_type = 'oxide' and component_name <> 'sum'")
    minerals = bounded_names(catalog.compositions, "component_name") if minerals is None else minerals
    oxides = bounded_names(oxide_rows, "component_name") if oxides is None else oxides
    base = entities.select(*fixed.EXPORT_COLUMNS)
    wide = base.join(pivoted(own(catalog.compositions), "value_pct", minerals, "Mineral: {} (%)"), "simulant_id", "left")
    # Values come from all rows of the oxide's name, whatever their type.
    wide = wide.join(pivoted(own(catalog.chemical_compositions), "value_wt_pct", oxides, "Chemical: {} (wt%)"),
                     "simulant_id", "left")
    wide = wide.join(citation_rollup(own(catalog.references)), "simulant_id", "left")
    headers = {**fixed.EXPORT_COLUMNS, "composition_sources": "Composition Sources", "usage_studies": "Usage Studies"}

    def cell(c: str) -> F.Column:
        if c in ("composition_sources", "usage_studies"):
            return F.coalesce(c, F.lit(""))
        return F.col(f"`{c}`")

    return wide.select(*[cell(c).alias(headers.get(c, c)) for c in wide.columns if c != "other_sources"])


def entity_export(catalog: Catalog, simulant_id: str) -> DataFrame:
    """The wide export of one entity: only columns of its own components."""
    own = F.col("simulant_id") == simulant_id
    minerals = bounded_names(catalog.compositions.filter(own), "component_name")
    oxide_rows = catalog.chemical_compositions.filter(own).filter("component_type = 'oxide' and component_name <> 'sum'")
    return wide_export(catalog, catalog.simulants.filter(own), minerals, bounded_names(oxide_rows, "component_name"))


def write_csv(wide: DataFrame, path: str) -> None:
    """Write a wide table as CSV: single-line trimmed cells, quoted only when needed."""
    types = dict(wide.dtypes)

    def text(c: str) -> F.Column:
        column = F.col(f"`{c}`")
        plain = plain_number(column) if types[c] == "double" else column.cast("string")
        return F.trim(F.regexp_replace(F.coalesce(plain, F.lit("")), r"\r?\n", " ")).alias(c)

    rows = wide.select([text(c) for c in wide.columns])
    rows.write.mode("errorifexists").csv(path, header=True, quote='"', escape='"', emptyValue="",
                                         ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_reports(reports: Mapping[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """Write report tables, one folder each."""
    for name, df in reports.items():
        df.write.mode("errorifexists").format(fmt).option("header", True).save(f"{folder.rstrip('/')}/{name}")


def write_lines(lines: DataFrame, path: str) -> None:
    """Write (section, position, line) as text in this order: the part files, one after another by name, are the document."""
    lines.orderBy("section", "position").select("line").write.mode("errorifexists").text(path)
