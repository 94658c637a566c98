"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0 to N-1 in a stated order. A keyed permutation of 0..N-1 maps number to place; shard
is place mod S and slot is place div S. So counts differ by one at most, slots have no gap, the shuffle
is the same in every run, and anyone who knows N, S and the seed computes shard and slot of a row number (`place`)
or the row number at a slot (`row_number_at`) without the table.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.llm.columns import fresh, require, shuffle_partitions
from stratalog.llm.ranges import cut_points, range_number

ROUNDS = 8
#: The round function works modulo this prime; products of two residues fit 64 bits.
PRIME = 2**31 - 1
#: Domains that overshoot N by more than this are walked this many steps at most. An overshoot is below the
#: square root of N, so the chance that a row walks on is under (1/64)**64.
WALK = 64


class Permutation:
    """A keyed bijection of 0..n-1: an unbalanced Feistel network on a grid of rows x columns >= n."""

    def __init__(self, n: int, seed: int):
        if not 0 <= n < 2**61:
            raise ValueError("the number of rows must be below 2**61")
        self.n = n
        self.rows = max(1, math.isqrt(max(n - 1, 0)) + 1)
        self.columns = max(1, -(-n // self.rows))
        drawn = random.Random(seed)
        self.keys = [tuple(drawn.randrange(1, PRIME) for _ in range(3)) for _ in range(ROUNDS)]
        self.steps = min(self.rows * self.columns - n, WALK)

    def _mixed(self, v: int, key: tuple) -> int:
        x = (v * key[0] + key[1]) % PRIME
        return (x * x % PRIME * key[2] + x) % PRIME

    def place(self, number: int) -> int:
        """The place of a row number, by plain arithmetic."""
        x = number
        while True:
            for i, key in enumerate(self.keys):
                left, right = divmod(x, self.columns)
                if i % 2:
                    right = (right + self._mixed(left, key)) % self.columns
                else:
                    left = (left + self._mixed(right, key)) % self.rows
                x = left * self.columns + right
            if x < self.n:
                return x

    def row_number_at(self, place: int) -> int:
        """The row number at a place: the inverse of `place`."""
        x = place
        while True:
            for i, key in reversed(list(enumerate(self.keys))):
                left, right = divmod(x, self.columns)
                if i % 2:
                    right = (right - self._mixed(left, key)) % self.columns
                else:
                    left = (left - self._mixed(right, key)) % self.rows
                x = left * self.columns + right
            if x < self.n:
                return x

    def column(self, number: Column) -> Column:
        """`place` as a column expression."""
        size = F.lit(self.n).cast("bigint")
        rows, columns = F.lit(self.rows).cast("bigint"), F.lit(self.columns).cast("bigint")
        keys = F.array(*[F.struct(*[F.lit(v).cast("bigint").alias(c) for v, c in zip(k, "abc")], F.lit(i % 2 == 1).alias("odd"))
                         for i, k in enumerate(self.keys)])

        def mixed(v: Column, key: Column) -> Column:
            x = (v * key.a + key.b) % PRIME
            return (x * x % PRIME * key.c + x) % PRIME

        def turn(x: Column, key: Column) -> Column:
            left, right = F.call_function("div", x, columns), x % columns
            return F.when(key.odd, left * columns + (right + mixed(left, key)) % columns).otherwise(
                (left + mixed(right, key)) % rows * columns + right)

        def once(x: Column) -> Column:
            return F.aggregate(keys, x, turn)

        walk = F.array_repeat(F.lit(0), self.steps)
        return F.aggregate(walk, once(number), lambda x, _: F.when(x >= size, once(x)).otherwise(x))


def with_row_number(df: DataFrame, order: list[str], name: str, parts: int | None = None) -> tuple[DataFrame, int]:
    """``df`` with 0-based global row numbers by ``order`` (nulls first), and the number of rows.

    The first order column must be numeric. Its ranges are numbered one by one (`row_number` in a window per range) and
    shifted by the counts of the ranges before: no task holds more than a range. Rows that agree in all of ``order``
    get adjacent numbers in no stated order. ``parts`` ranges (default four per shuffle partition); one count of each
    reaches the driver.
    """
    cuts = cut_points(df, order[0], parts or 4 * shuffle_partitions(df))
    part = fresh(df, "range")
    cut = df.withColumn(part, range_number(F.col(order[0]), cuts))
    counts = dict(cut.groupBy(part).count().collect())
    before, total = [], 0
    for i in range(len(cuts) + 1):
        before.append(total)
        total += counts.get(i, 0)
    window = Window.partitionBy(part).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    shift = F.get(F.array(*[F.lit(b).cast("bigint") for b in before]), F.col(part))
    return cut.withColumn(name, shift + F.row_number().over(window) - 1).drop(part), total


def assign_shards(df: DataFrame, shards: int, order: list[str], seed: int = 0, names: tuple[str, str] = ("shard", "slot")) -> DataFrame:
    """``df`` with the shard (int) and slot (bigint) of every row.

    ``order`` must tell different rows apart for the result to be the same in every run; rows alike in all of it
    may swap places. Null order values sort first, empty and repeated rows count like any other, an empty table stays empty.
    ``names`` must not be columns of ``df``.
    """
    require(df, *order)
    if shards < 1:
        raise ValueError("at least one shard is needed")
    clash = [n for n in names if n.lower() in {c.lower() for c in df.columns}]
    if clash:
        raise ValueError(f"columns {clash} exist already; pass other names")
    number = fresh(df, "row_number")
    numbered, total = with_row_number(df, order, number)
    place = fresh(df, "place")
    placed = numbered.withColumn(place, Permutation(total, seed).column(F.col(number)))
    return placed.withColumns({
        names[0]: (F.col(place) % shards).cast("int"),
        names[1]: F.call_function("div", F.col(place), F.lit(shards)),
    }).drop(number, place)
