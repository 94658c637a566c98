"""Text to number, and small numeric formulas, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The guard keeps out texts only Spark reads as numbers, such as '1.5d' or 'Infinity'.
_DECIMAL = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"
_DECIMAL_PREFIX = r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"
_INTEGER = r"^\s*[-+]?\d+\s*$"


def decimal_text(c: Column) -> Column:
    """The number a text spells out in full, else null."""
    s = c.cast("string")
    return F.when(s.rlike(_DECIMAL), F.trim(s).try_cast("double"))


def integer_text(c: Column) -> Column:
    """The whole number a text spells out in full, else null."""
    s = c.cast("string")
    return F.when(s.rlike(_INTEGER), F.trim(s).try_cast("bigint"))


def strict_number(c: Column) -> Column:
    """A number, with zero and non-numbers read as missing."""
    return F.nullif(decimal_text(c), F.lit(0.0))


def prefix_number(c: Column) -> Column:
    """The number a text begins with ('0.3-1.2 kPa' gives 0.3); zero is missing."""
    digits = F.regexp_extract(c.cast("string"), _DECIMAL_PREFIX, 1)
    return F.nullif(F.nullif(digits, F.lit("")).try_cast("double"), F.lit(0.0))


def mass_kg(c: Column) -> Column:
    """'21.5 kg' or '101 g' in kilograms."""
    number = F.regexp_extract(c, r"([\d.]+)\s*(kg|g)\b", 1).try_cast("double")
    unit = F.regexp_extract(c, r"([\d.]+)\s*(kg|g)\b", 2)
    return F.when(unit == "kg", number).when(unit == "g", number * 0.001)


def plain_number(c: Column) -> Column:
    """A double printed without a trailing '.0'."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def cluster_radius(altitude: Column) -> Column:
    """Clustering radius in degrees for a viewing altitude: linear between two clamps."""
    return (
        F.when(altitude <= 0.4, 0.01)
        .when(altitude >= 4, 20.0)
        .otherwise(0.01 + (altitude - 0.4) / 3.6 * 19.99)
    )


def planar_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance in degrees on the plane; no wrap at the antimeridian."""
    dlat, dlon = lat2 - lat1, lon2 - lon1
    return F.sqrt(dlat * dlat + dlon * dlon)


def keyed(mapping: dict[str, str], c: Column, default: Column) -> Column:
    """Look ``c`` up in a short fixed mapping."""
    pairs = reduce(lambda acc, kv: acc + [F.lit(kv[0]), F.lit(kv[1])], mapping.items(), [])
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), default)
