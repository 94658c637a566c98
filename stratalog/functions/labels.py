"""Display labels and classes as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalog import fixed
from stratalog.functions.numbers import keyed, plain_number


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def contains_folded(c: Column, query: str | Column) -> Column:
    """Case-insensitive literal containment; null holds nothing."""
    needle = F.lower(F.lit(query) if isinstance(query, str) else query)
    return F.lower(_text(c)).contains(needle)


def csv_cell(c: Column) -> Column:
    """One line, trimmed, quoted only when the text holds a comma or a quote."""
    line = F.trim(F.regexp_replace(_text(c), r"\r?\n", " "))
    quoted = F.concat(F.lit('"'), F.replace(line, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(line.contains(",") | line.contains('"'), quoted).otherwise(line)


def merged_label(*parts: Column) -> Column:
    """Non-blank parts without repeats, joined by ' / '; null when none is left."""
    kept = F.array_distinct(F.filter(F.array(*[_text(p) for p in parts]), lambda x: x != ""))
    return F.nullif(F.array_join(kept, " / "), F.lit(""))


def rocks_label(c: Column) -> Column:
    """'{"Rocks": {"Basalt": 60}}' as 'Basalt 60%', largest first; other text as it is."""
    rocks = F.try_element_at(F.from_json(c, "map<string, string>"), F.lit("Rocks"))
    entries = F.map_entries(F.from_json(rocks, "map<string, double>"))
    ordered = F.array_sort(
        F.filter(entries, lambda e: e["value"] > 0),
        lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).otherwise(0),
    )
    shown = F.transform(ordered, lambda e: F.concat(e["key"], F.lit(" "), plain_number(e["value"]), F.lit("%")))
    return F.coalesce(F.nullif(F.array_join(shown, ", "), F.lit("")), c)


def country_display(c: Column) -> Column:
    return keyed(fixed.COUNTRY_DISPLAY, c, c)


def institution_url(c: Column) -> Column:
    """Home page of the first agency whose name the institution holds."""
    hits = [F.when(F.upper(c).contains(key), F.lit(url)) for key, url in fixed.INSTITUTION_URLS.items()]
    return F.coalesce(*hits)


def inferred_mission(c: Column) -> Column:
    """Mission whose reference profile a free-text sample reference points to."""
    low = F.lower(c)
    hits = []
    for contained, equal, mission in fixed.PROFILE_RULES:
        tests = [low.contains(t) for t in contained] + [low == t for t in equal]
        hits.append(F.when(reduce(lambda a, b: a | b, tests), F.lit(mission)))
    return F.coalesce(*hits)


def type_colour(c: Column) -> Column:
    low = F.lower(c)
    hits = [F.when(low.contains(word), F.lit(colour)) for word, colour in fixed.TYPE_COLOURS]
    return F.coalesce(*hits, F.lit(fixed.TYPE_COLOUR_OTHER))


def site_colour(c: Column) -> Column:
    return keyed(fixed.SITE_COLOURS, c, F.lit(fixed.SITE_COLOUR_OTHER))


def availability_badge(c: Column) -> Column:
    return keyed(fixed.AVAILABILITY_BADGES, c, F.lit(fixed.AVAILABILITY_BADGES["Unavailable"]))


def export_file_name(name: Column, day: Column) -> Column:
    """Sanitised, dated file name of a single-entity export."""
    return F.concat(F.regexp_replace(name, "[^a-zA-Z0-9]", "_"), F.lit("_"), F.date_format(day, "yyyy-MM-dd"), F.lit(".csv"))


def key_text(prefix: str, number: Column) -> Column:
    """'CH' and 7 give 'CH007'; longer numbers keep all their digits."""
    return F.format_string(prefix + "%03d", number.cast("bigint"))


def key_order(c: Column) -> list[Column]:
    """Sort expressions under which 'CH101' comes before 'CH1000'."""
    return [F.length(c), c]
