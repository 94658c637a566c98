"""Document corpora: HTML files with sidecar metadata and companion files, or tables of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions.citations import file_title
from stratalog.functions.markup import visible_text

MIN_TEXT = 100


def html_to_text(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """Replace the HTML column by its text; rows stay in their partitions."""
    return pages.select(*[c for c in pages.columns if c != html], visible_text(F.col(html)).alias(text))


def corpus_texts(pages: DataFrame, html: str = "html") -> DataFrame:
    """Documents with at least 100 characters of text."""
    return html_to_text(pages, html).filter(F.length("text") >= MIN_TEXT)


def _file_name() -> F.Column:
    """Name of the file a row was read from; Spark gives it percent-encoded, '+' left as it is."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))).alias("file")


def html_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, html) of every HTML file in a folder, one row per file."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.html")
    rows = raw.select(_file_name(), F.col("value").alias("html"))
    return rows.filter(~F.col("file").contains("Zone.Identifier"))


def metadata_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, title) of the sidecar JSON files; files that do not parse are left out."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json")
    valid = raw.filter(F.try_parse_json("value").isNotNull())
    return valid.select(_file_name(), F.get_json_object("value", "$.title").alias("title"))


def file_names(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """Names of the files in a folder, without reading them."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return listed.select(_file_name())


def with_titles(docs: DataFrame, metadata: DataFrame) -> DataFrame:
    """Title from the first sidecar that exists, else from the file name.

    Sidecars by priority: '<stem> metadata.json', '<stem> meta.json', '<stem>.json' and
    '<stem without .pdf> metadata.json'.
    """
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    bare = F.replace(stem, F.lit(".pdf"), F.lit(""))
    candidates = F.array(
        F.concat(stem, F.lit(" metadata.json")), F.concat(stem, F.lit(" meta.json")),
        F.concat(stem, F.lit(".json")), F.concat(bare, F.lit(" metadata.json")),
    )
    wanted = docs.select("file", F.posexplode(candidates).alias("priority", "sidecar"))
    side = metadata.select(F.col("file").alias("sidecar"), F.struct("title").alias("meta"))
    hit = wanted.join(side, "sidecar").groupBy("file").agg(F.min_by("meta", "priority").alias("meta"))
    titled = docs.join(hit, "file", "left")
    return titled.withColumn("title", F.trim(F.coalesce("meta.title", file_title(F.col("file"))))).drop("meta")


def with_companion(docs: DataFrame, companions: DataFrame) -> DataFrame:
    """Whether the PDF a page was made from exists, and its name."""
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    wanted = F.when(stem.endswith(".pdf"), stem).otherwise(F.concat(stem, F.lit(".pdf")))
    have = companions.select(F.col("file").alias("pdf_filename")).distinct().withColumn("_have", F.lit(True))
    joined = docs.withColumn("pdf_filename", wanted).join(have, "pdf_filename", "left")
    flagged = joined.withColumn("has_pdf", F.coalesce("_have", F.lit(False)))
    return flagged.withColumn("pdf_filename", F.when(F.col("has_pdf"), F.col("pdf_filename"))).drop("_have").select(
        *docs.columns, "has_pdf", "pdf_filename")
