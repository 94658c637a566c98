"""Integrity and coverage checks over the catalogue tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog import fixed
from stratalog.operators.compose import totals_above
from stratalog.sources.catalog import Catalog


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _issue(df: DataFrame, check: str, severity: str, key: Column, detail: Column) -> DataFrame:
    return df.select(
        F.lit(check).alias("check"), F.lit(severity).alias("severity"),
        key.cast("string").alias("key"), detail.cast("string").alias("detail"),
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows without a parent.

    Child keys are counted before the join, so a key that most child rows share is one
    row; the rows themselves then come from a join with the few orphan keys.
    """
    keys = child.select(child_key).distinct()
    lost = keys.join(parent.select(F.col(parent_key).alias("_p")), F.col(child_key) == F.col("_p"), "left_anti")
    return child.join(lost, child[child_key].eqNullSafe(lost[child_key]), "left_semi")


def orphan_keys(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Orphan keys with the number of rows that hold them."""
    counted = child.groupBy(F.col(child_key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return counted.join(parent.select(F.col(parent_key).alias("_p")), F.col("key") == F.col("_p"), "left_anti")


def without_children(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """Parents no child row refers to."""
    present = child.select(F.col(child_key).alias("_c")).distinct()
    return parent.join(present, F.col(parent_key) == F.col("_c"), "left_anti")


def enforced(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> tuple[DataFrame, DataFrame]:
    """(rows that satisfy the foreign key, rows to quarantine). A null key is allowed."""
    bad = orphans(child.filter(F.col(child_key).isNotNull()), parent, child_key, parent_key)
    keys = parent.select(F.col(parent_key).alias("_p")).distinct()
    linked = child.join(keys, F.col(child_key) == F.col("_p"), "left_semi")
    return linked.unionByName(child.filter(F.col(child_key).isNull())), bad


def missing_required(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """(key, field) for every blank required field."""
    fields = F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c)) for c in columns])
    return df.select(F.col(key).alias("key"), F.explode(F.array_compact(fields)).alias("field"))


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    """Counts per value, blank shown as 'null', most frequent first."""
    shown = F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit("null"))
    counted = df.groupBy(shown.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "value")


def nonstandard_values(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    odd = df.filter((F.coalesce(F.col(column), F.lit("")) != "") & ~F.col(column).isin(list(allowed)))
    return odd.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def coverage(parent: DataFrame, children: Mapping[str, DataFrame], parent_key: str, child_key: str) -> DataFrame:
    """(child, covered, missing, total) per child table.

    `covered` counts distinct ids in the child table, known or not; `missing` counts
    parents without a row there. Ids are made distinct map-side; one pass tags all tables.
    """
    ids = parent.select(F.col(parent_key).alias("id"), F.lit("").alias("child")).distinct()
    tagged = _union([ids, *[df.select(F.col(child_key).alias("id"), F.lit(n).alias("child")).distinct()
                            for n, df in children.items()]])
    names = list(children)
    per_id = tagged.groupBy("id").agg(
        F.max(F.col("child") == "").alias("known"),
        *[F.max(F.col("child") == n).alias(f"has_{i}") for i, n in enumerate(names)],
    )
    sums = per_id.agg(
        F.count_if("known").alias("total"),
        *[F.count_if(f"has_{i}").alias(f"covered_{i}") for i in range(len(names))],
        *[F.count_if(F.col("known") & ~F.col(f"has_{i}")).alias(f"missing_{i}") for i in range(len(names))],
    )
    rows = F.array(*[
        F.struct(F.lit(n).alias("child"), F.col(f"covered_{i}").alias("covered"), F.col(f"missing_{i}").alias("missing"))
        for i, n in enumerate(names)
    ])
    return sums.select(F.inline(rows), "total").select("child", "covered", "missing", "total")


CHILD_TABLES = ("simulant_extra", "sites", "compositions", "chemical_compositions", "references", "mineral_groups")
WARNED = {
    "compositions": "mineral composition",
    "chemical_compositions": "chemical composition",
    "references": "references",
    "sites": "site/location",
}


def integrity_issues(catalog: Catalog) -> DataFrame:
    """All errors and warnings as (check, severity, key, detail)."""
    entities = catalog.simulants
    dup = duplicate_keys(entities, ["simulant_id"])
    parts = [_issue(dup, "duplicate_key", "error", F.col("simulant_id"), F.concat(F.col("n"), F.lit(" times")))]
    for name in CHILD_TABLES:
        lost = orphan_keys(catalog.tables[name], entities, "simulant_id", "simulant_id")
        parts.append(_issue(lost, f"orphan:{name}", "error", F.col("key"), F.concat(F.col("n"), F.lit(" rows"))))
    blank = missing_required(entities, ["name", "simulant_id"], "simulant_id")
    parts.append(_issue(blank, "missing_field", "error", F.col("key"), F.col("field")))
    seen = coverage(entities, {n: catalog.tables[n] for n in WARNED}, "simulant_id", "simulant_id")
    parts.append(_issue(seen.filter("missing > 0"), "missing_child", "warning", F.col("child"),
                        F.concat(F.col("missing"), F.lit(" entities"))))
    odd = nonstandard_values(entities, "availability", fixed.STANDARD_AVAILABILITY)
    parts.append(_issue(odd, "nonstandard_availability", "warning", F.col("value"),
                        F.concat(F.col("n"), F.lit(" records"))))
    return _union(parts)


def composition_sum_issues(components: DataFrame, value: str) -> DataFrame:
    """Entities whose composition adds up to more than 100 %."""
    high = totals_above(components, value)
    return _issue(high, "composition_sum", "error", F.col("simulant_id"), F.round("total", 4))


def verdict(issues: DataFrame) -> DataFrame:
    """(result, errors, warnings): PASS when there is no error."""
    counted = issues.agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )
    return counted.select(F.when(F.col("errors") == 0, "PASS").otherwise("FAIL").alias("result"), "errors", "warnings")
