"""Cutting a table into value ranges of about equal row counts, with cuts that every plan sees alike.

`repartitionByRange` samples anew for each plan, so two branches may cut differently. Here the cuts
are computed once and become a literal of the plan: a row's range is then a function of its value.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cut_points(df: DataFrame, column: str, parts: int) -> list:
    """At most ``parts - 1`` ascending values of ``column`` between ranges of about equal size.

    Each is a value that occurs. Only they reach the driver, so their number is the caller's to bound.
    """
    if parts < 2:
        return []
    fractions = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(F.col(column), fractions, max(10_000, 20 * parts)).alias("cuts")).first()
    return sorted(set(found["cuts"] or []))


def range_number(value: Column, cuts: list) -> Column:
    """How many cuts are below ``value``: range i holds what is above cut i-1 and up to cut i. Null: 0.

    A binary search over the literal, one step per bit.
    """
    if not cuts:
        return F.lit(0)
    literal, n = F.lit(np.array(cuts, np.int64)), len(cuts)
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(n.bit_length()))])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when((at + step <= n) & (F.get(literal, at + step - 1) < value), at + step).otherwise(at),
    )
