"""Facet values with counts, and distinct name lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.operators.filters import NASA_ANY
from stratalog.sources.catalog import Catalog

_ENTITY_FACETS = {
    "type": "type",
    "country": "country_code",
    "institution": "institution",
    "availability": "availability",
    "lunar_ref": "lunar_sample_reference",
}
_KEEPS_BLANK = ("type", "mineral", "group", "chemical")


def _child_facet(df: DataFrame, property_: str, column: str) -> DataFrame:
    return df.groupBy(F.lit(property_).alias("property"), F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )


def facet_values(catalog: Catalog) -> DataFrame:
    """(property, value, n): the values every facet offers.

    One scan of the entity table is unpivoted for its five facets. Every table is
    counted map-side before the shuffle, so a value held by most rows is no hot key.
    """
    pairs = ", ".join(f"'{p}', `{c}`" for p, c in _ENTITY_FACETS.items())
    entity = (
        catalog.simulants.select(F.expr(f"stack({len(_ENTITY_FACETS)}, {pairs}) as (property, value)"))
        .groupBy("property", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    oxides = catalog.chemical_compositions.filter(
        (F.col("component_type") == "oxide")
        & (F.col("component_name").isNull() | (F.col("component_name") != "sum"))
    )
    counted = (
        entity.unionByName(_child_facet(catalog.compositions, "mineral", "component_name"))
        .unionByName(_child_facet(catalog.mineral_groups, "group", "group_name"))
        .unionByName(_child_facet(oxides, "chemical", "component_name"))
        .filter(F.col("property").isin(*_KEEPS_BLANK) | (F.coalesce(F.col("value"), F.lit("")) != ""))
    )
    nasa = (
        catalog.simulants.filter(F.lower("institution").contains("nasa"))
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 0")
        .select(F.lit("institution").alias("property"), F.lit(NASA_ANY).alias("value"), "n")
    )
    return counted.unionByName(nasa)


def bounded_names(df: DataFrame, column: str, limit: int = 10_000) -> list[str]:
    """Sorted distinct names for use as column headers.

    Column headers have to be known to the driver. Beyond ``limit`` names a wide table
    makes no sense and the long form must be used, so that is an error, not a cut.
    """
    names = [r[0] for r in df.select(column).distinct().orderBy(column).limit(limit + 1).collect()]
    if len(names) > limit:
        raise ValueError(f"more than {limit} distinct values of {column}: use the long form")
    return [n for n in names if n is not None]
