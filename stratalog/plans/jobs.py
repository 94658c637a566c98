"""Whole jobs over a catalogue: spreadsheet merge, and source index with citation backfill.

Inputs are never changed; a job returns new tables with its audit and checks. Tables
that several steps read are written once to the checkpoint folder first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.operators import backfill, linkage, mentions, merge, quality
from stratalog.operators.ordering import with_new_keys
from stratalog.session import durable
from stratalog.sources.catalog import Catalog
from stratalog.sources.sinks import conformed


@dataclass(frozen=True)
class Curated:
    catalog: Catalog
    links: DataFrame
    statistics: DataFrame
    issues: DataFrame


def _grown(existing: DataFrame, new: DataFrame, table: str, prefix: str) -> DataFrame:
    keyed = with_new_keys(new, existing, "composition_id", prefix, [F.col("simulant_id"), F.col("component_name")])
    return conformed(existing, table).unionByName(conformed(keyed, table))


def curate(
    catalog: Catalog,
    rows: DataFrame,
    aliases: DataFrame | Mapping[str, Sequence[str]] | None = None,
    refined: DataFrame | None = None,
    preliminary: DataFrame | None = None,
    fuzzy: bool = True,
) -> Curated:
    """Merge spreadsheet rows: link names, fill gaps, add compositions, enrich sourcing, check."""
    links = durable(linkage.link_names(rows, catalog.simulants, aliases, fuzzy))
    entities, extras = merge.merge_entities(rows, links, catalog.simulants, catalog.simulant_extra)
    minerals = merge.merge_minerals(rows, links, catalog.compositions)
    chemistry = merge.merge_chemistry(rows, links, catalog.chemical_compositions)
    sourcing = catalog.mineral_sourcing
    if refined is not None and preliminary is not None:
        sourcing = merge.merge_sourcing(sourcing, refined, preliminary)
    tables = {
        "simulants": entities.drop("filled_fields"),
        "simulant_extra": extras.drop("filled_fields"),
        "compositions": _grown(catalog.compositions, minerals, "compositions", "C"),
        "chemical_compositions": _grown(catalog.chemical_compositions, chemistry, "chemical_compositions", "CH"),
        "mineral_sourcing": sourcing,
        **{n: catalog.tables[n] for n in ("sites", "references", "mineral_groups", "lunar_reference", "purchase_info")
           if n in catalog.tables},
    }
    merged = Catalog(tables)
    statistics = merge.merge_statistics(rows, links, entities, extras, minerals, chemistry)
    return Curated(merged, links, statistics, quality.integrity_issues(merged))


@dataclass(frozen=True)
class SourceIndex:
    mentions: DataFrame
    documents: DataFrame
    reports: dict[str, DataFrame]
    references: DataFrame
    change: DataFrame


def index_sources(docs: DataFrame, entities: DataFrame, references: DataFrame, curated: DataFrame) -> SourceIndex:
    """Index (file, text, title) documents by the entities they mention and backfill citations."""
    hits = durable(mentions.count_mentions(docs, entities, "file"))
    documents = mentions.document_index(hits, entities, docs, "file")
    best = backfill.best_sources(hits, docs.select("file", "title"))
    new = backfill.new_citations(entities, references, best, docs.select("file", "text"), curated)
    grown = conformed(references, "references").unionByName(conformed(new, "references"))
    reports = {
        "multi_entity": mentions.multi_entity_report(documents, "file"),
        "entity_sources": mentions.entity_sources(hits, entities, "file"),
        "uncovered": mentions.uncovered_entities(hits, entities),
        "totals": mentions.corpus_totals(hits, docs, entities, "file"),
        "top_documents": mentions.top_documents(documents, "file"),
    }
    return SourceIndex(hits, documents, reports, grown, backfill.coverage_change(entities, references, grown))
