"""Citations for entities that have none, resolved from the documents that mention them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog import fixed
from stratalog.functions.citations import (
    bare_file_name, document_doi, document_title, file_authors, file_work_title, file_year,
)
from stratalog.functions.labels import key_order
from stratalog.operators.ordering import with_new_keys
from stratalog.operators.quality import coverage, without_children


def best_sources(mentions: DataFrame, titles: DataFrame, meta_words: Sequence[str] = fixed.META_TITLE_WORDS) -> DataFrame:
    """(name, file, mentions): per name the most mentioning document that is no meta-source.

    ``mentions`` is (file, name, mentions), ``titles`` (file, title). Reduced map-side.
    """
    good = titles.filter(~F.coalesce("title", F.lit("")).rlike("|".join(meta_words))).select("file")
    kept = mentions.join(good, "file", "left_semi")
    best = kept.groupBy("name").agg(F.min(F.struct((-F.col("mentions")).alias("r"), "file")).alias("b"))
    return best.select("name", F.col("b.file").alias("file"), (-F.col("b.r")).alias("mentions"))


def resolved_citations(files: DataFrame, corpus: DataFrame, curated: DataFrame) -> DataFrame:
    """Citation fields per file: curated record, else what text and file name tell.

    ``corpus`` is (file, text), ``curated`` (file, title, authors, year, doi, url,
    reference_type). A file outside both is cited by its name. DOI and title are taken while the corpus is scanned, so
    only they are joined and shuffled, never the texts.
    """
    known = curated.select("file", F.struct("title", "authors", "year", "doi", "url", "reference_type").alias("c"))
    text = corpus.select("file", document_doi(F.col("text")).alias("_doi"), document_title(F.col("text")).alias("_title"), F.lit(True).alias("_read"))
    rows = files.select("file").distinct().join(known, "file", "left").join(text, "file", "left")
    doi = F.col("_doi")
    file = F.col("file")
    title = F.coalesce(F.col("_title"), file_work_title(file), F.nullif(bare_file_name(file), F.lit("")))
    extracted = F.struct(
        title.alias("title"), file_authors(file).alias("authors"), file_year(file).alias("year"), doi.alias("doi"),
        F.concat(F.lit("https://doi.org/"), doi).alias("url"), F.lit("general").alias("reference_type"),
    )
    absent = F.struct(
        file.alias("title"), F.lit(None).cast("string").alias("authors"), F.lit(None).cast("int").alias("year"),
        F.lit(None).cast("string").alias("doi"), F.lit(None).cast("string").alias("url"),
        F.lit("general").alias("reference_type"),
    )
    chosen = F.when(F.col("c").isNotNull(), F.col("c")).when(F.col("_read"), extracted).otherwise(absent)
    return rows.select("file", chosen.alias("c")).select("file", "c.*")


def new_citations(
    entities: DataFrame, references: DataFrame, sources: DataFrame, corpus: DataFrame, curated: DataFrame
) -> DataFrame:
    """Citation rows, with new keys, for entities without one; ``sources`` from `best_sources`."""
    bare = without_children(entities, references, "simulant_id", "simulant_id").select("simulant_id", "name")
    chosen = bare.join(sources.select("name", "file"), "name")
    cited = chosen.join(resolved_citations(chosen, corpus, curated), "file")
    unstructured = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.nullif(F.col("doi"), F.lit("")),
                              F.nullif(F.col("url"), F.lit(""))).isNull()
    rows = cited.select(
        "simulant_id",
        F.when(unstructured, F.concat(F.lit("Source: "), F.col("file"))).alias("reference_text"),
        "reference_type", "title", "authors", "year", "doi", "url",
    )
    return with_new_keys(rows, references, "reference_id", "R", [F.col("simulant_id")])


def preview(citations: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` new citations in order of their keys: a look at what a backfill would write."""
    return citations.orderBy(*key_order(F.col("reference_id"))).limit(n)


def coverage_change(entities: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Entities covered and missing before and after the backfill."""
    return coverage(entities, {"before": before, "after": after}, "simulant_id", "simulant_id")
