"""Merge spreadsheet rows into the catalogue: gap fill, compositions, sourcing, append.

Rows are reduced per name, then per entity, before any join. A merge therefore costs
one row per entity and never pairs all rows of a name with all entities of that name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog import fixed
from stratalog.functions.cells import chemical_pairs, mineral_groups_map, mineral_shares
from stratalog.functions.numbers import decimal_text, integer_text, keyed
from stratalog.operators.ordering import forward_filled, with_new_keys

# Target field -> spreadsheet expression, per target table.
def entity_fields() -> dict[str, Column]:
    return {
        "type": F.col("type"),
        "institution": F.col("institution"),
        "availability": keyed(fixed.STAGE_AVAILABILITY, F.col("stage"), F.col("stage")),
        "release_date": integer_text(F.col("release_date")).cast("string"),
        "notes": F.col("notes"),
        "specific_gravity": decimal_text(F.col("specific_gravity")),
        "tons_produced_mt": decimal_text(F.col("tons_produced")),
    }


def extra_fields() -> dict[str, Column]:
    same = ("classification", "application", "feedstock", "replica_of", "grain_size_mm", "petrographic_class", "reference")
    flag = F.upper("publicly_available") == "TRUE"
    return {**{c: F.col(c) for c in same},
            "publicly_available_composition": F.when(F.col("publicly_available").isNotNull(), flag)}


def is_missing(c: Column) -> Column:
    """Null, '' and the word 'null' all count as missing."""
    return c.isNull() | c.cast("string").isin("", "null")


def first_values(rows: DataFrame, keys: Sequence[str], fields: Sequence[str], order: str = "ord") -> DataFrame:
    """Per key and field the first non-missing value with its order, in one pass over all fields."""
    return rows.groupBy(*keys).agg(*[
        F.min(F.when(~is_missing(F.col(f)), F.struct(F.col(order).alias("o"), F.col(f).alias("v")))).alias(f)
        for f in fields
    ])


def _per_entity(rows: DataFrame, links: DataFrame, fields: dict[str, Column]) -> DataFrame:
    parsed = rows.select("name", "ord", *[e.alias(f) for f, e in fields.items()])
    per_name = first_values(parsed, ["name"], list(fields))
    linked = links.select("name", "simulant_id").join(per_name, "name")
    firsts = linked.groupBy("simulant_id").agg(*[F.min(f).alias(f) for f in fields])
    return firsts.select("simulant_id", *[F.col(f"{f}.v").alias(f"_new_{f}") for f in fields])


def gap_filled(target: DataFrame, source: DataFrame, fields: Sequence[str], key: str = "simulant_id") -> DataFrame:
    """Fill missing ``fields`` of ``target`` from `_new_<field>` columns; lists the filled ones."""
    joined = target.join(source, key, "left")
    fills = {f: is_missing(F.col(f)) & F.col(f"_new_{f}").isNotNull() for f in fields}
    filled = F.array_compact(F.array(*[F.when(c, F.lit(f)) for f, c in fills.items()])).alias("filled_fields")
    return joined.select(*[
        F.when(fills[c], F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in fills else F.col(f"`{c}`")
        for c in target.columns
    ], filled)


def merge_entities(rows: DataFrame, links: DataFrame, simulants: DataFrame, extras: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, extras), gap-filled and each with its list of filled fields."""
    ours, theirs = entity_fields(), extra_fields()
    return (
        gap_filled(simulants, _per_entity(rows, links, ours), list(ours)),
        gap_filled(extras, _per_entity(rows, links, theirs), list(theirs)),
    )


def _claims(rows: DataFrame, links: DataFrame, usable: Column, existing: DataFrame) -> DataFrame:
    """(simulant_id, name, ord): the first usable row of each entity without child rows."""
    first = rows.filter(usable).groupBy("name").agg(F.min("ord").alias("ord"))
    linked = links.select("name", "simulant_id").join(first, "name")
    won = linked.groupBy("simulant_id").agg(F.min(F.struct("ord", "name")).alias("w"))
    return won.join(existing.select("simulant_id").distinct(), "simulant_id", "left_anti").select("simulant_id", "w.*")


def merge_minerals(rows: DataFrame, links: DataFrame, existing: DataFrame) -> DataFrame:
    """New mineral rows for entities that have none.

    A cell that parses claims its entity even when no share in it is positive.
    """
    parsed = rows.select("name", "ord", "mineral_composition_raw", mineral_groups_map(F.col("mineral_composition_raw")).alias("groups"))
    usable = F.coalesce(F.size("groups"), F.lit(0)) > 0
    cells = parsed.filter(usable).select(F.col("ord").alias("_ord"), "groups")
    claims = _claims(parsed, links, usable, existing)
    groups = claims.join(cells, F.col("ord") == F.col("_ord")).select("simulant_id", F.explode("groups").alias("group", "cell"))
    shares = groups.select("simulant_id", "group", F.explode(mineral_shares(F.col("cell"))).alias("component_name", "share"))
    positive = shares.withColumn("value_pct", decimal_text(F.col("share"))).filter("value_pct > 0")
    return positive.select("simulant_id", F.lit("mineral").alias("component_type"), "component_name", "value_pct", "group")


def merge_chemistry(rows: DataFrame, links: DataFrame, existing: DataFrame) -> DataFrame:
    """New oxide rows for entities that have none."""
    parsed = rows.select("name", "ord", chemical_pairs(F.col("chemical_composition_raw")).alias("pairs"))
    usable = F.coalesce(F.size("pairs"), F.lit(0)) > 0
    cells = parsed.filter(usable).select(F.col("ord").alias("_ord"), "pairs")
    claims = _claims(parsed, links, usable, existing)
    found = claims.join(cells, F.col("ord") == F.col("_ord")).select("simulant_id", F.inline("pairs"))
    return found.select("simulant_id", F.lit("oxide").alias("component_type"),
                        F.col("name").alias("component_name"), F.col("value").alias("value_wt_pct"))


def merge_sourcing(existing: DataFrame, refined: DataFrame, preliminary: DataFrame) -> DataFrame:
    """Enrich sourcing records from two sheets.

    ``refined`` (ord, name, source_mineral, mining_locations, mining_company) may add
    minerals; ``preliminary`` (ord, constituent, supplier, chemistry, description,
    description_simple, further_reading, european_sources) only enriches, its blank
    constituents taking the one above. A source mineral filled in also replaces the
    chemistry.
    """
    first_fields = ("source_mineral", "mining_locations", "mining_company")
    second_fields = ("supplier", "chemistry", "description", "description_simple", "further_reading", "european_sources")
    named = refined.filter(~is_missing(F.col("name"))).withColumn("_key", F.lower("name"))
    one = first_values(named, ["_key"], ["name", *first_fields])
    filled = forward_filled(preliminary, "constituent", [F.col("ord")])
    two = first_values(filled.filter("constituent is not null").withColumn("_key", F.lower("constituent")), ["_key"],
                       second_fields)
    old = existing.withColumn("_key", F.lower("mineral_name"))
    rows = old.join(one.select("_key", *[F.col(f"{f}.v").alias(f"_1_{f}") for f in ("name", *first_fields)]), "_key", "full_outer")
    rows = rows.join(two.select("_key", *[F.col(f"{f}.v").alias(f"_2_{f}") for f in second_fields]), "_key", "left")

    def blank(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")) == ""

    new_source = blank("source_mineral") & F.col("_1_source_mineral").isNotNull()
    values = {"mineral_name": F.coalesce("mineral_name", "_1_name")}
    for f in first_fields:
        values[f] = F.when(blank(f), F.coalesce(f"_1_{f}", f)).otherwise(F.col(f))
    chemistry = F.when(new_source, F.col("_1_source_mineral")).otherwise(F.col("chemistry"))
    for f in second_fields:
        base = chemistry if f == "chemistry" else F.col(f)
        values[f] = F.when(F.coalesce(base, F.lit("")) == "", F.coalesce(F.col(f"_2_{f}"), base)).otherwise(base)
    return rows.select(*[values.get(c, F.col(c)).alias(c) for c in existing.columns])


def merge_statistics(
    rows: DataFrame, links: DataFrame, entities: DataFrame, extras: DataFrame, minerals: DataFrame, chemistry: DataFrame
) -> DataFrame:
    """(measure, n): rows matched and unmatched, fields filled, rows added."""
    matched = rows.join(links.select("name").distinct().withColumn("_hit", F.lit(True)), "name", "left")
    by_row = matched.agg(F.count("_hit").alias("rows_matched"), F.count_if(F.col("_hit").isNull()).alias("rows_unmatched"))
    parts = [by_row.select(F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("n"))
                                              for m in ("rows_matched", "rows_unmatched")])))]
    fills = entities.select(F.size("filled_fields").alias("k")).unionByName(extras.select(F.size("filled_fields").alias("k")))
    parts.append(fills.agg(F.coalesce(F.sum("k"), F.lit(0)).cast("bigint").alias("n")).select(F.lit("fields_filled").alias("measure"), "n"))
    for name, df in (("minerals_added", minerals), ("chemistry_added", chemistry)):
        parts.append(df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("measure"), "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def clashing_owners(existing: DataFrame, new: DataFrame, owner: str = "simulant_id") -> DataFrame:
    """All owners of new rows that already have rows."""
    return new.select(owner).distinct().join(existing.select(owner).distinct(), owner, "left_semi")


def appended(existing: DataFrame, new: DataFrame, key: str, prefix: str, order: Sequence[Column], owner: str = "simulant_id") -> DataFrame:
    """Append keyed rows; refuse when an owner already has rows, a value is no number or columns differ.

    The refusal counts the clashing owners; `clashing_owners` is their table.
    """
    clash = clashing_owners(existing, new, owner).agg(F.count(F.lit(1)), F.min(owner), F.max(owner)).first()
    if clash[0]:
        raise ValueError(f"already present: {clash[0]} of {owner}, {clash[1]} to {clash[2]}")
    for f in new.schema:
        declared = existing.schema[f.name]
        if declared.dataType != f.dataType:
            raise ValueError(f"{f.name} is {f.dataType.simpleString()}, expected {declared.dataType.simpleString()}")
    keyed_rows = with_new_keys(new, existing, key, prefix, order)
    if set(keyed_rows.columns) != set(existing.columns):
        raise ValueError(f"columns differ: {sorted(set(keyed_rows.columns) ^ set(existing.columns))}")
    return existing.unionByName(keyed_rows)
