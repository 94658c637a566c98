"""The index reports as one Markdown document, kept as a table of lines until it is written."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog import fixed
from stratalog.operators.ordering import with_position

#: The rank of headings: before all other lines of a section.
_FIRST = -(10**12)


def _ranked(rows: DataFrame, section: int, rank: Column, key: Column, line: Column) -> DataFrame:
    return rows.select(F.lit(section).alias("section"), rank.cast("bigint").alias("rank"), key.cast("string").alias("key"), line.alias("line"))


def _row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c.cast("string"), F.lit("")) for c in cells]), F.lit(" |"))


def markdown_lines(totals: DataFrame, multi: DataFrame, sources: DataFrame, uncovered: DataFrame, titles: DataFrame, doc: str = "doc") -> DataFrame:
    """(section, position, line): totals, documents with several entities, coverage per entity, entities without a document.

    Takes what `corpus_totals`, `multi_entity_report`, `entity_sources` and `uncovered_entities` give, and (doc, title). Each report may
    have any number of rows: lines are numbered by `with_position`, so no task holds a section. Without uncovered entities
    the last section says so. The source shown for an entity is its first document. Cells are shown as they are.
    """
    headings = [(section, _FIRST + i, "", line) for section, lines in fixed.REPORT_HEADINGS.items() for i, line in enumerate(lines)]
    parts = [totals.sparkSession.createDataFrame(headings, "section int, rank bigint, key string, line string")]
    counted = F.array(
        F.concat(F.lit("Generated from "), F.col("documents").cast("string"), F.lit(" sources")), F.lit(""),
        F.concat(F.lit("**"), F.col("documents_with_mention").cast("string"), F.lit("** sources mention at least one simulant.")), F.lit(""))
    parts.append(_ranked(totals.select(F.posexplode(counted).alias("i", "text")), 1, F.col("i"), F.lit(""), F.col("text")))
    parts.append(_ranked(multi, 2, -F.col("entity_count"), F.col(doc), _row(F.substring(doc, 1, 50), F.col("entities"), F.substring("title", 1, 60))))
    named = titles.select(F.col(doc).alias("first_source"), F.substring("title", 1, 40).alias("top_title"))
    covered = sources.join(named, "first_source", "left")
    parts.append(_ranked(covered, 3, F.lit(0), F.col("simulant_id"), _row(F.col("name"), F.col("source_count"), F.coalesce("top_title", F.lit("-")))))
    bare = F.concat(F.lit("- "), F.col("name"), F.lit(" ("), F.col("simulant_id"), F.lit(")"))
    parts.append(_ranked(uncovered, 4, F.length("simulant_id"), F.col("simulant_id"), bare))
    parts.append(_ranked(totals.filter("entities_uncovered = 0"), 4, F.lit(0), F.lit(""), F.lit(fixed.REPORT_ALL_COVERED)))
    lines = reduce(lambda a, b: a.unionByName(b), parts)
    return with_position(lines, [F.col("rank"), F.col("key")], ["section"]).select("section", "position", "line")
