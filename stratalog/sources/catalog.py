"""Load the catalogue tables: parquet, JSON arrays, JSON lines or one bundle file."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog import schemas
from stratalog.session import durable
from stratalog.sources.documents import document_rows


@dataclass(frozen=True)
class Catalog:
    """The entity table and its child tables, by table name."""

    tables: Mapping[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None

    @staticmethod
    def of(spark: SparkSession, **tables: DataFrame) -> Catalog:
        """A catalogue of the given tables; the others are empty with their schema."""
        empty = {name: spark.createDataFrame([], schema) for name, (schema, _) in schemas.TABLES.items() if name not in tables}
        return Catalog({**empty, **tables})

    @staticmethod
    def load(spark: SparkSession, paths: Mapping[str, str], fmt: str = "parquet") -> Catalog:
        """Read one path per table. ``fmt``: parquet, jsonl (splittable) or json (one array per file)."""
        return Catalog.of(spark, **{name: read_table(spark, path, schemas.SOURCES[name][0], fmt)
                                    for name, path in paths.items()})

    @staticmethod
    def load_bundle(spark: SparkSession, path: str) -> Catalog:
        """Read one JSON object that holds an array per table, or a folder of them; a missing table is empty. Read in byte ranges, once for all tables."""
        rows = durable(document_rows(spark, path))
        return Catalog.of(spark, **{name: _rows_of(rows, name, schema) for name, (schema, _) in schemas.TABLES.items()})


def _rows_of(rows: DataFrame, table: str, schema: T.StructType) -> DataFrame:
    own = rows.where(F.col("table") == table)
    return _typed(own.select(F.from_json("row", _texts(schema)).alias("row")).select("row.*"), schema)


def _texts(schema: T.StructType) -> T.StructType:
    """The schema with scalars as text: numbers and strings share a column in the files."""
    scalar = (T.DoubleType, T.IntegerType, T.LongType, T.BooleanType)
    return T.StructType([
        T.StructField(f.name, T.StringType() if isinstance(f.dataType, scalar) else f.dataType) for f in schema
    ])


def _typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select([F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema])


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(path)
    return _typed(spark.read.schema(_texts(schema)).json(path, multiLine=fmt == "json"), schema)


def normalised_components(df: DataFrame, value: str) -> DataFrame:
    """Bring drifted component rows (`mineral_name/percentage`, `oxide`) to the declared columns."""
    have = set(df.columns)

    def pick(*names: str) -> F.Column:
        return F.coalesce(*[F.col(n) for n in names if n in have], F.lit(None))

    aliases = {"component_name": ("component_name", "mineral_name", "oxide"), value: (value, "percentage")}
    rest = [c for c in df.columns if c not in {"mineral_name", "oxide", "percentage", *aliases}]
    return df.select(*[F.col(f"`{c}`") for c in rest], *[pick(*names).alias(c) for c, names in aliases.items()])


def country_codes(spark: SparkSession, path: str) -> DataFrame:
    """ISO-3 codes of a GeoJSON country file; '-99' and '' are null."""
    # A map keeps keys apart that differ only by case.
    features = document_rows(spark, path).where("table = 'features'")
    feature = features.select(F.from_json("row", "properties map<string, string>")["properties"].alias("p"))
    return feature.select(country_code(F.col("p")).alias("country_code"), F.col("p").getItem("NAME").alias("name"))


def country_code(properties: F.Column) -> F.Column:
    codes = [F.nullif(properties.getItem(k), F.lit("")) for k in ("ISO_A3", "iso_a3")]
    return F.nullif(F.coalesce(*codes), F.lit("-99"))


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count per table; counts come from file footers where the format has them."""
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
              for name, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out
