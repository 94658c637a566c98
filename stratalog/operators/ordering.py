"""Order as data: first and last row per key, positions, forward fill, ids.

A window over a hot key would sort a third of all rows in one task. The operators
here therefore reduce with partial aggregates, or split the rows by range first and
carry a small per-part summary across the parts.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions.labels import key_text
from stratalog.session import durable


def _row_without(df: DataFrame, keys: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in df.columns if c not in keys])


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row with the greatest ``order`` per key, reduced map-side first."""
    best = df.groupBy(*keys).agg(F.max_by(_row_without(df, keys), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row with the least ``order`` per key, reduced map-side first."""
    best = df.groupBy(*keys).agg(F.min_by(_row_without(df, keys), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def _range_parts(df: DataFrame, within: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows split by range of (within, order) and sorted, with `_part` and `_at` (from 0 in the part).

    The numbers rise with the order. They are only good together with the rows they
    were computed for, so the lineage is cut here.
    """
    keys = [*[F.col(c).asc_nulls_first() for c in within], *order]
    sorted_parts = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # The id is the partition number above 33 bits that count the rows of the partition.
    kept = durable(sorted_parts.withColumn("_id", F.monotonically_increasing_id()))
    return kept.withColumns({
        "_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)),
    }).drop("_id")


def _join_carried(parts: DataFrame, carried: DataFrame, within: Sequence[str], name: str) -> DataFrame:
    """Add what a group brings along from earlier parts.

    Of all groups in a part only its first can have begun in an earlier part, so
    ``carried`` has at most one row per part: a proven bound for the broadcast.
    """
    keys = [*within, "_part"]
    small = carried.select(*[F.col(c).alias(f"_s_{c}") for c in keys], name)
    on = F.lit(True)
    for c in keys:
        on = on & parts[c].eqNullSafe(small[f"_s_{c}"])
    return parts.join(F.broadcast(small), on, "left").drop(*[f"_s_{c}" for c in keys])


def _before(within: Sequence[str]) -> Window:
    """The earlier parts of a group. It runs over one row per group and part."""
    return Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def with_position(
    df: DataFrame, order: Sequence[Column], within: Sequence[str] = (), name: str = "position"
) -> DataFrame:
    """Number rows 1, 2, … by ``order`` inside each ``within`` group, or over all rows.

    ``order`` must be total (end it with a unique column). No task holds more than
    one range part, however large the group is; over all rows there is no shuffle but
    the one that splits them.
    """
    parts = _range_parts(df, within, order)
    counts = parts.groupBy(*within, "_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(*within, "_part", F.sum("_n").over(_before(within)).alias("_offset")).filter("_offset > 0")
    row = F.col("_at") + 1
    if within:
        row = F.row_number().over(Window.partitionBy(*within, "_part").orderBy("_at"))
    numbered = _join_carried(parts.withColumn("_row", row), offsets, within, "_offset")
    position = (F.col("_row") + F.coalesce("_offset", F.lit(0))).cast("bigint")
    return numbered.withColumn(name, position).drop("_part", "_at", "_row", "_offset")


def forward_filled(
    df: DataFrame, value: str, order: Sequence[Column], within: Sequence[str] = (), name: str | None = None
) -> DataFrame:
    """Carry the last non-null ``value`` forward by ``order`` inside each group."""
    parts = _range_parts(df, within, order)
    lasts = parts.groupBy(*within, "_part").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_at"))).alias("_last")
    )
    carry = F.last("_last", ignorenulls=True).over(_before(within))
    carried = lasts.select(*within, "_part", carry.alias("_carry")).filter("_carry is not null")
    upto = Window.partitionBy(*within, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = parts.withColumn("_own", F.last(value, ignorenulls=True).over(upto))
    filled = _join_carried(own, carried, within, "_carry").withColumn(name or value, F.coalesce("_own", "_carry"))
    return filled.drop("_part", "_at", "_own", "_carry")


def highest_number(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """One row with the greatest number (decimal(38,0)) among keys of the form prefix + digits, 0 if none.

    Digits are compared by their number, then as text, so keys of any length count; a greatest one of more than 38 digits is an error.
    """
    digits = F.regexp_extract(F.col(key), f"^{re.escape(prefix)}0*([0-9]+)$", 1)
    top = F.max(F.when(digits != "", F.struct(F.length(digits).alias("n"), digits.alias("digits"))))
    return df.agg(top.alias("top")).select(
        F.when(F.col("top.n") > 38, F.raise_error(F.concat(F.lit("a key has more than 38 digits: "), F.col("top.digits"))).cast("decimal(38,0)"))
        .otherwise(F.coalesce(F.col("top.digits").cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))).alias("highest"))


def with_new_keys(new: DataFrame, existing: DataFrame, key: str, prefix: str, order: Sequence[Column]) -> DataFrame:
    """Give the new rows keys that follow the greatest existing one."""
    highest = highest_number(existing, key, prefix).first()["highest"]
    numbered = with_position(new, order, name="_n")
    number = (F.col("_n").cast("decimal(38,0)") + F.lit(highest).cast("decimal(38,0)")).cast("decimal(38,0)")
    keyed = numbered.withColumn(key, key_text(prefix, number))
    return keyed.select(key, *[c for c in new.columns if c != key])
