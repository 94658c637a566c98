"""Catalogue tables derived from generic order, part and document tables.

The texts are plain SQL that Spark and DuckDB read alike, so both engines derive the
same catalogue from the same base tables; only the operators under test differ.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

from stratalog.sources.catalog import Catalog

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)

_MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October",
           "November", "December")
_MONTH_NAME = "case month(o_orderdate) " + " ".join(
    f"when {i} then '{m}'" for i, m in enumerate(_MONTHS, 1)) + " end"
_ASCII = "'abcdefghijklmnopqrstuvwxyz0123456789'"


def _word(n: int) -> str:
    return f"replace(replace(split_part(text, ' ', {n}), ',', ''), '.', '')"


STANDINS: dict[str, str] = {
    # Entities: parts, spread over the nations.
    "simulants": """
        select 'S' || cast(p_partkey as string) as simulant_id,
               p_name || '-' || cast(p_partkey as string) as name,
               case when p_size % 13 = 0 then null else p_type end as type,
               n_name as country_code,
               case when p_size % 7 = 0 then null when p_size % 7 = 1 then 'Nasa ' || p_brand else p_brand end as institution,
               case p_size % 5 when 0 then 'Available' when 1 then 'Limited Stock' when 2 then 'Production stopped'
                   when 3 then 'Unknown' else 'On request' end as availability,
               case when p_size % 10 = 0 then 'undated' when p_size % 11 = 0 then null
                   else cast(1970 + p_size as string) end as release_date,
               p_retailprice as tons_produced_mt,
               p_name || ', "' || p_brand || '"' as notes,
               cast(p_size as double) / 8 as specific_gravity,
               case p_size % 8 when 0 then '10084' when 1 then 'Apollo 14 soil' when 2 then 'CE5 soil' when 3 then 'ChangE type'
                   when 4 then '' when 5 then null when 6 then 'Apollo 12 / 71501' else 'unknown' end as lunar_sample_reference,
               case p_size % 4 when 0 then '1.' || cast(p_size as string) when 1 then '0' when 2 then 'dense' else '1.5d' end
                   as bulk_density,
               case p_size % 4 when 0 then '0.' || cast(p_size as string) || '-1.2 kPa' when 1 then 'n/a' when 2 then '0'
                   else cast(p_size as string) end as cohesion,
               cast(p_size as string) || '.5' as friction_angle,
               cast(null as double) as density_g_cm3,
               cast(p_size as double) as particle_size_d50,
               case when p_size % 3 = 0 then '0-' || cast(p_size as string) end as particle_size_distribution,
               cast(null as string) as particle_morphology,
               cast(null as string) as particle_ruggedness,
               cast(p_size % 6 as double) * 2.5 as glass_content_percent,
               cast(null as double) as nasa_fom_score,
               cast(null as double) as ti_content_percent
        from {part} join {nation} on n_nationkey = p_partkey % 25""",
    "simulant_extra": """
        select 'S' || cast(p_partkey as string) as simulant_id, p_name as name, p_type as classification,
               case when p_size % 2 = 0 then 'drilling' end as application,
               case p_size % 8 when 0 then '10084' when 1 then 'Apollo 14' when 5 then 'Luna 16' end as replica_of,
               cast(null as string) as feedstock,
               case p_size % 3
                   when 0 then '{{"Rocks": {{"Basalt": ' || cast(p_size as string) || ', "Glass": 20.5, "Nil": 0}}}}'
                   when 1 then 'Basalt' end as petrographic_class,
               case when p_size % 4 = 0 then cast(p_size as string) when p_size % 4 = 1 then '0.1-1' end as grain_size_mm,
               cast(null as double) as specific_gravity, p_size % 2 = 0 as publicly_available_composition,
               cast(null as string) as reference
        from {part} where p_brand <> 'Brand#3'""",
    "sites": """
        select 'X' || cast(c_custkey as string) as site_id,
               'S' || cast(cast(floor(c_custkey / 2) as bigint) as string) as simulant_id,
               c_name as site_name, 'institution' as site_type, n_name as country_code,
               case when c_mktsegment = 'FURNITURE' then null else c_acctbal / 128 end as lat,
               cast(c_nationkey as double) * 14 - 180 as lon
        from {customer} join {nation} on n_nationkey = c_nationkey""",
    # Child rows straight from line items: an entity has the same component many times.
    "chemical_compositions": """
        select 'CH' || cast(l_orderkey as string) || '-' || cast(l_linenumber as string) as composition_id,
               'S' || cast(l_partkey as string) as simulant_id,
               case when l_tax = 0.08 then 'trace' else 'oxide' end as component_type,
               l_returnflag || l_linestatus as component_name, l_quantity - 1 as value_wt_pct
        from {lineitem} join {part} on p_partkey = l_partkey where p_brand <> 'Brand#7'
        union all
        select 'CHS' || cast(p_partkey as string), 'S' || cast(p_partkey as string), 'oxide', 'sum', cast(p_size as double)
        from {part} where p_brand <> 'Brand#7'""",
    "compositions": """
        select 'C' || cast(l_orderkey as string) || '-' || cast(l_linenumber as string) as composition_id,
               'S' || cast(l_partkey as string) as simulant_id, 'mineral' as component_type, n_name as component_name,
               l_quantity / 4 - 1 as value_pct, r_name as {group_column}
        from {lineitem} join {part} on p_partkey = l_partkey join {supplier} on s_suppkey = l_suppkey
             join {nation} on n_nationkey = s_nationkey join {region} on r_regionkey = n_regionkey
        where p_brand <> 'Brand#9'""",
    "mineral_groups": """
        select 'MG' || cast(l_partkey as string) || '-' || cast(r_regionkey as string) as group_id,
               'S' || cast(l_partkey as string) as simulant_id, r_name as group_name,
               (sum(l_quantity) - 30) / 16 as value_pct
        from {lineitem} join {supplier} on s_suppkey = l_suppkey join {nation} on n_nationkey = s_nationkey
             join {region} on r_regionkey = n_regionkey
        group by l_partkey, r_regionkey, r_name""",
    "references": """
        select 'R' || cast(o_orderkey as string) as reference_id, 'S' || cast(o_custkey as string) as simulant_id,
               case when o_orderstatus = 'F' then null else 'Miller, A. (2019) Analysis of batch ' || cast(o_orderkey as string)
                   || ' at https://example.org/b' || cast(o_orderkey as string) || '/p1 with doi 10.1234/x'
                   || cast(o_custkey as string) || ' end.' end as reference_text,
               case o_orderpriority when '1-URGENT' then 'composition' when '2-HIGH' then 'usage' when '3-MEDIUM' then null
                   when '4-NOT SPECIFIED' then 'review' else 'composition' end as reference_type,
               'Batch study number ' || cast(o_orderkey as string) as title, 'Miller & Lee' as authors,
               cast(1995 + o_orderkey % 7 as int) as year, '10.5555/' || cast(o_orderkey as string) as doi,
               cast(null as string) as url
        from {orders}""",
    "purchase_info": """
        select 'S' || cast(s_suppkey as string) as simulant_id, s_name as vendor,
               'https://shop.example.org/' || cast(s_suppkey as string) as url, cast(null as string) as price_note
        from {supplier}""",
    "mineral_sourcing": """
        select lower(n_name) as mineral_name, r_name as chemistry,
               case when n_nationkey % 3 = 0 then 'ore ' || n_name end as source_mineral,
               cast(null as string) as description, cast(null as string) as description_simple,
               cast(null as string) as comments, cast(null as string) as mineral_locations,
               case when n_nationkey % 2 = 0 then 'site ' || n_name end as mining_locations,
               cast(null as string) as mining_company, n_nationkey % 2 = 0 as mine_active,
               cast(null as string) as ethical_compliance, n_name = 'NATION_3' as available_france,
               r_name = 'EUROPE' as available_europe, r_name = 'EUROPE' as available_schengen,
               cast(null as string) as supplier, cast(null as string) as further_reading,
               cast(null as string) as european_sources, cast(null as string) as european_locations_detail
        from {nation} join {region} on r_regionkey = n_regionkey""",
    # Reference profiles in long form: per region the share of each flag pair.
    "profile_values": """
        select r_name as sample_id, 'Apollo ' || cast(r_regionkey + 11 as string) as mission,
               l_returnflag || l_linestatus as component_name, sum(l_quantity) / 1024 as value
        from {lineitem} join {supplier} on s_suppkey = l_suppkey join {nation} on n_nationkey = s_nationkey
             join {region} on r_regionkey = n_regionkey
        where not (r_regionkey = 1 and l_returnflag = 'A')
        group by r_name, r_regionkey, l_returnflag, l_linestatus""",
    # Landing sites: dates and masses as text.
    "landing": f"""
        select 'L' || cast(o_orderkey as string) as id, 'Site ' || cast(o_orderkey as string) as name,
               'Mission ' || cast(o_custkey as string) as mission,
               {_MONTH_NAME} || ' ' || cast(day(o_orderdate) as string) || ', ' || cast(year(o_orderdate) as string) as date,
               case o_orderstatus when 'F' then cast(o_custkey as string) || '.5 kg' when 'O' then cast(o_custkey as string) || ' g'
                   end as samples_returned,
               case o_orderpriority when '1-URGENT' then 'Apollo' when '2-HIGH' then 'Luna' when '3-MEDIUM' then 'Chang-e'
                   else 'Other' end as type
        from {{orders}}""",
    # Spreadsheet rows: entity names as they are, in capitals, without hyphen, or unknown.
    "sheet": """
        select p_partkey as ord,
               case p_partkey % 6 when 0 then p_name || '-' || cast(p_partkey as string)
                   when 1 then upper(p_name) || '-' || cast(p_partkey as string)
                   when 2 then p_name || cast(p_partkey as string)
                   when 3 then 'Alias ' || p_brand
                   when 4 then p_name || '-' || cast(p_partkey - 4 as string)
                   else 'nothing like it ' || cast(p_partkey as string) end as name,
               case when p_size % 3 = 0 then 'Mare' end as type,
               case when p_size % 2 = 0 then 'Institute ' || p_brand end as institution,
               case p_size % 3 when 0 then 'Available' when 1 then 'Limited stock' else 'Planned' end as stage,
               case when p_size % 5 = 0 then 'soon' else cast(1990 + p_size as string) end as release_date,
               case when p_size % 4 = 0 then 'null' else 'note ' || p_brand end as notes,
               cast(p_size as string) || '.25' as specific_gravity, 'many' as tons_produced,
               'class ' || p_type as classification, 'use ' || p_type as application, cast(null as string) as feedstock,
               'Luna 20' as replica_of, cast(p_size as string) as grain_size_mm, cast(null as string) as petrographic_class,
               'ref ' || p_brand as reference, case p_size % 3 when 0 then 'TRUE' when 1 then 'false' end as publicly_available,
               case p_size % 5
                   when 0 then '{{"Feldspar": {{"Anorthite": ' || cast(p_size as string) || '.5, "Albite": 0}}, "Glass": {{"Melt": 3}}}}'
                   when 1 then '{{"Feldspar": {{"Anorthite": ' || cast(p_size as string) || ','
                   when 2 then 'Basalt' when 3 then '{{"Feldspar": 3, "Glass": {{"Melt": 4.5}}}}' end as mineral_composition_raw,
               case p_size % 4
                   when 0 then '{{"SiO2": ' || cast(p_size as string) || '.5, "TiO2": null}}'
                   when 1 then 'SiO2;' || cast(p_size as string) || '.5;about;Al2O3; 12.3 ;FeO'
                   when 2 then 'see paper' end as chemical_composition_raw
        from {part}""",
    "aliases": """
        select 'Alias ' || p_brand as name, p_name || '-' || cast(p_partkey as string) as target
        from {part} where p_size = 1""",
    "refined_sheet": """
        select cast(n_nationkey as bigint) as ord,
               case when n_nationkey % 4 = 0 then 'New ' || n_name else upper(n_name) end as name,
               'source of ' || n_name as source_mineral,
               case when n_nationkey % 3 = 0 then 'pit ' || n_name end as mining_locations,
               'company ' || n_name as mining_company
        from {nation}""",
    "preliminary_sheet": """
        select s_suppkey as ord, case when s_suppkey % 3 = 0 then n_name end as constituent,
               s_name as supplier, 'chem ' || s_name as chemistry,
               case when s_acctbal > 0 then 'about ' || s_name end as description, cast(null as string) as description_simple,
               'read ' || s_name as further_reading, cast(null as string) as european_sources
        from {supplier} join {nation} on n_nationkey = s_nationkey""",
    # Names to look for in the documents: the first word, or the first two, of each benchmark text.
    "word_names": f"""
        select 'W' || cast(item_id as string) as simulant_id, {_word(1)} as name
        from {{benchmark}} where translate(lower({_word(1)}), {_ASCII}, '') = '' and {_word(1)} <> ''""",
    "pair_names": f"""
        select 'P' || cast(item_id as string) as simulant_id, {_word(1)} || '-' || {_word(2)} as name
        from {{benchmark}}
        where translate(lower({_word(1)} || {_word(2)}), {_ASCII}, '') = '' and {_word(1)} <> '' and {_word(2)} <> ''""",
    "corpus": """
        select cast(doc_id as string) || case when doc_id % 3 = 0 then '.pdf.html' else '.html' end as file, text,
               case when source = 'src3' then 'Database of ' || lang else 'Paper ' || cast(doc_id as string) || ' in ' || lang end
                   as title
        from {documents}""",
    "curated": """
        select cast(doc_id as string) || case when doc_id % 3 = 0 then '.pdf.html' else '.html' end as file,
               'Curated ' || cast(doc_id as string) as title, 'Board' as authors, cast(2000 + doc_id % 20 as int) as year,
               cast(null as string) as doi, cast(null as string) as url, 'review' as reference_type
        from {labels} where toxic = 1""",
    "word_references": """
        select 'R' || cast(item_id as string) as reference_id, 'W' || cast(item_id as string) as simulant_id,
               'known' as reference_text, 'general' as reference_type, cast(null as string) as title,
               cast(null as string) as authors, cast(null as int) as year, cast(null as string) as doi,
               cast(null as string) as url
        from {benchmark} where length(text) % 2 = 0""",
    "points": """
        select vec_id as ord, cast({first} as double) * 200 as lat, cast({second} as double) * 200 as lon
        from {embeddings}""",
    "pairs": """
        select c_custkey as pair_id, 'S' || cast(c_custkey as string) as id_1,
               'S' || cast(c_nationkey as string) as id_2
        from {customer}""",
}

# The few spots where the engines spell a thing differently.
SPARK_WORDS = {"group_column": "`group`", "first": "embedding[0]", "second": "embedding[1]"}
DUCKDB_WORDS = {"group_column": '"group"', "first": "embedding[1]", "second": "embedding[2]"}


def _fill(text: str, words: Mapping[str, str]) -> str:
    for name, word in words.items():
        text = text.replace("{" + name + "}", word)
    return text


def duckdb_text(name: str) -> str:
    """The derivation as DuckDB SQL over the base views."""
    return _fill(STANDINS[name], DUCKDB_WORDS).format(**{t: t for t in BASE_TABLES})


def dealt(df: DataFrame) -> DataFrame:
    """Rows of a table that is a single file, dealt to all cores: its one row group would be one task.

    Tables of several files keep the reader's partitions, so nothing of their texts is shuffled.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if len(df.inputFiles()) == 1 else df


class StandIns(Mapping[str, DataFrame]):
    """Base and derived tables of one data folder, made when asked for."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._make(name)
        return self._made[name]

    def _make(self, name: str) -> DataFrame:
        if name in STANDINS:
            text = _fill(STANDINS[name], SPARK_WORDS)
            needed = {t for t in BASE_TABLES if re.search(r"\{%s\}" % t, text)}
            return self.spark.sql(text, **{t: self[t] for t in needed})
        if name not in BASE_TABLES:
            raise KeyError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __iter__(self) -> Iterator[str]:
        return iter((*BASE_TABLES, *STANDINS))

    def __len__(self) -> int:
        return len(BASE_TABLES) + len(STANDINS)

    def catalog(self) -> Catalog:
        return Catalog(self)
