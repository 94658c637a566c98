"""Composition tables: totals, overlays on reference profiles, families, comparisons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog import fixed
from stratalog.functions.labels import key_order
from stratalog.functions.numbers import strict_number
from stratalog.operators.filters import positive_components
from stratalog.operators.ordering import with_position


def first_components(components: DataFrame, value: str, key: str = "composition_id", name: str = "component_name") -> DataFrame:
    """(simulant_id, component_name, value): the first row of each component of an entity."""
    ranked = F.struct(F.length(key).alias("l"), F.col(key).alias("k"), F.col(value).alias("value"))
    best = components.groupBy("simulant_id", F.col(name).alias("component_name")).agg(F.min(ranked).alias("_first"))
    return best.select("simulant_id", "component_name", F.col("_first.value").alias("value"))


def profile_components(profiles: DataFrame, column: str) -> DataFrame:
    """(sample_id, component_name, value) of one map of the reference profiles."""
    return profiles.select("sample_id", F.explode(column).alias("component_name", "value"))


def composition_totals(rows: DataFrame, value: str = "value", reference: str | None = None) -> DataFrame:
    """Detail rows plus one total row per entity (component_name null, is_total true)."""
    sums = [F.sum(value).alias(value)]
    if reference:
        sums.append(F.sum(F.coalesce(reference, F.lit(0.0))).alias(reference))
    grouping = F.grouping("component_name").cast("boolean").alias("is_total")
    rolled = rows.rollup("simulant_id", "component_name").agg(*sums, grouping)
    # An entity total; the grand total over all entities has no id and no use here.
    return rolled.filter(F.col("simulant_id").isNotNull())


def overlay(rows: DataFrame, profile: DataFrame, on: str = "sample_id") -> DataFrame:
    """Entity components beside the value of the entity's reference profile.

    ``reference`` is null where the profile lacks the component (table form);
    ``reference_or_zero`` has 0 there (chart form).
    """
    side = profile.select(on, "component_name", F.col("value").alias("reference"))
    joined = rows.join(side, [on, "component_name"], "left")
    return joined.withColumn("reference_or_zero", F.coalesce("reference", F.lit(0.0)))


def family_shares(rows: DataFrame, families: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(simulant_id, family, value): components rolled up into families, dense with zeros.

    The mapping is a short literal, so it is folded into a CASE expression. Missing
    families come from exploding the family list per entity, not from a cross join.
    """
    families = families or fixed.MINERAL_FAMILIES
    family = F.coalesce(*[F.when(F.col("component_name").isin(list(m)), f) for f, m in families.items()])
    mapped = rows.select("simulant_id", family.alias("family"), "value").filter(F.col("family").isNotNull())
    sums = mapped.groupBy("simulant_id").agg(
        *[F.coalesce(F.sum(F.when(F.col("family") == f, F.col("value"))), F.lit(0.0)).alias(f"f{i}")
          for i, f in enumerate(families)]
    )
    pairs = F.array(*[F.struct(F.lit(f).alias("family"), F.col(f"f{i}").alias("value")) for i, f in enumerate(families)])
    return sums.select("simulant_id", F.inline(pairs))


def _side_by_side(matched: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(…keys, component_name, value_1, value_2) of rows (…keys, component_name, side, value).

    One aggregation with map-side combine takes the place of a full outer join.
    """
    def of(side: int) -> Column:
        return F.coalesce(F.max(F.when(F.col("side") == side, F.col("value"))), F.lit(0.0)).alias(f"value_{side}")

    both = matched.groupBy(*keys, "component_name").agg(of(1), of(2))
    return both.filter((F.col("value_1") > 0) | (F.col("value_2") > 0))


def _pair_sides(components: DataFrame, pairs: DataFrame) -> DataFrame:
    """The components of both entities of every pair, by a single join."""
    sides = F.array(*[F.struct(F.lit(n).alias("side"), F.col(f"id_{n}").alias("simulant_id")) for n in (1, 2)])
    rows = components.select("simulant_id", "component_name", "value")
    return pairs.select("pair_id", F.inline(sides)).join(rows, "simulant_id")


def comparison_order(keys: Sequence[str] = ("pair_id",)) -> list[Column]:
    """Larger components first inside each pair."""
    return [*[F.col(k) for k in keys], F.desc(F.col("value_1") + F.col("value_2")), F.col("component_name")]


def compare_pairs(components: DataFrame, pairs: DataFrame, exclude_sum: bool = True) -> DataFrame:
    """Two entities component by component, for every (pair_id, id_1, id_2).

    ``components`` holds one row per entity and component (see `first_components`).
    """
    rows = components.filter("component_name <> 'sum'") if exclude_sum else components
    both = _side_by_side(_pair_sides(rows, pairs), ["pair_id"])
    delta = F.col("value_1") - F.col("value_2")
    return both.select(
        "*",
        delta.alias("delta"),
        F.abs(delta).alias("abs_delta"),
        F.when(delta > 0, "first").when(delta < 0, "second").otherwise("tie").alias("larger"),
    )


def compare_to_profiles(
    components: DataFrame, profiles: DataFrame, pairs: DataFrame, aliases: Mapping[str, str] | None = None
) -> DataFrame:
    """Entities against reference profiles, for every (simulant_id, sample_id) pair.

    The difference is given only where both sides are positive. ``aliases`` maps
    entity component names to those of the profiles.
    """
    rows = components.filter("value > 0")
    if aliases:
        alias = F.coalesce(*[F.when(F.col("component_name") == a, F.lit(b)) for a, b in aliases.items()],
                           F.col("component_name"))
        rows = rows.withColumn("component_name", alias)
    columns = ["simulant_id", "sample_id", "component_name", "value"]
    keyed = pairs.select("simulant_id", "sample_id")
    own = keyed.join(rows, "simulant_id").select(*columns, F.lit(1).alias("side"))
    reference = keyed.join(profiles, "sample_id").select(*columns, F.lit(2).alias("side"))
    both = _side_by_side(own.unionByName(reference), ["simulant_id", "sample_id"])
    delta = F.when((F.col("value_1") > 0) & (F.col("value_2") > 0), F.col("value_1") - F.col("value_2"))
    return both.select("*", delta.alias("delta"), F.abs(delta).alias("abs_delta"))


def compared_properties(entities: DataFrame) -> DataFrame:
    """(simulant_id, component_name, value) of the eight compared physical properties."""
    items = F.array(*[
        F.struct(F.lit(label).alias("component_name"), F.coalesce(strict_number(F.col(p)), F.lit(0.0)).alias("value"))
        for p, label in fixed.COMPARED_PROPERTIES.items()
    ])
    return entities.select("simulant_id", F.inline(items))


def compare_physical(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """Two entities property by property; properties positive on neither side are left out."""
    return _side_by_side(_pair_sides(compared_properties(entities), pairs), ["pair_id"])


def totals_above(components: DataFrame, value: str, limit: float = 100.0, tolerance: float = 1e-6) -> DataFrame:
    """Entities whose components add up to more than ``limit``, rounding aside."""
    total = components.groupBy("simulant_id").agg(F.sum(value).alias("total"))
    return total.filter(F.col("total") > limit + tolerance)


def ordered_components(components: DataFrame, value: str, key: str = "composition_id", name: str = "component_name",
                       oxides_only: bool = False) -> DataFrame:
    """Positive components with their position inside the entity: largest value first, equal ones in key order."""
    rows = positive_components(components, value, oxides_only)
    return with_position(rows, [F.desc(value), *key_order(F.col(key)), F.col(name)], ["simulant_id"])
