"""Composition cells of a spreadsheet: JSON, truncated JSON and name;value lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalog.functions.numbers import decimal_text


def _is_json(c: Column) -> Column:
    return F.try_parse_json(c).isNotNull()


def _count(c: Column, char: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))


def json_object_text(raw: Column) -> Column:
    """The cell as a valid JSON object, closing braces lost to truncation; null otherwise."""
    text = F.regexp_replace(raw, r"^\s+|\s+$", "")
    cut = F.regexp_replace(text, r",+$", "")
    closed = F.concat(cut, F.repeat(F.lit("}"), F.greatest(_count(cut, "{") - _count(cut, "}"), F.lit(0))))
    whole = F.when(_is_json(text), text).when(_is_json(closed), closed)
    return F.when(text.startswith("{"), whole)


def mineral_groups_map(raw: Column) -> Column:
    """Group -> JSON text of its minerals. One bad group does not spoil the others."""
    return F.from_json(json_object_text(raw), "map<string, string>")


def mineral_shares(group_text: Column) -> Column:
    """Mineral -> share text of one group; null when the group is no object."""
    return F.when(F.ltrim(group_text).startswith("{"), F.from_json(group_text, "map<string, string>"))


_PAIR = "array<struct<name: string, value: double>>"


def chemical_pairs(raw: Column) -> Column:
    """(name, value) pairs of a cell: a JSON object, or 'SiO2;45.5;Al2O3;12.3'.

    In the list form a token whose successor is no number is passed over, so the
    tokens are folded with the last unpaired one as the state.
    """
    is_object = _is_json(raw) & F.ltrim(raw).startswith("{")
    entries = F.filter(F.map_entries(F.from_json(raw, "map<string, string>")), lambda e: e["value"].isNotNull())
    from_object = F.transform(
        entries, lambda e: F.struct(e["key"].alias("name"), decimal_text(e["value"]).alias("value"))
    )
    tokens = F.transform(F.split(raw, "[;,]"), lambda t: F.regexp_replace(t, r"^\s+|\s+$", ""))
    start = F.struct(F.lit(None).cast("string").alias("pending"), F.array().cast(_PAIR).alias("found"))

    def step(state: Column, token: Column) -> Column:
        value = decimal_text(token)
        paired = state["pending"].isNotNull() & value.isNotNull()
        grown = F.array_append(state["found"], F.struct(state["pending"].alias("name"), value.alias("value")))
        return F.struct(
            F.when(~paired, token).alias("pending"),
            F.when(paired, grown).otherwise(state["found"]).cast(_PAIR).alias("found"),
        )

    from_list = F.aggregate(tokens, start, step, lambda state: state["found"])
    return F.when(is_object, from_object.cast(_PAIR)).otherwise(from_list)
