"""Document fingerprints: a threshold-scaled sketch of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, however long the text; where none is, the least hash, so
that only texts without words have an empty sketch. So sketches of parts merge to the sketch of the whole (`merged`), and the share of a small document found in a very large one
(`containment`) is as well estimated as between equals. All of it is column expressions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.llm.columns import fresh, let, require, shuffle_partitions, words_of
from stratalog.llm.ranges import cut_points, range_number

#: Words in a shingle; a text of fewer words is one shingle.
SHINGLE = 5
#: Share of the hash range that is kept.
FRACTION = 1 / 4
#: Bits of a shingle hash.
BITS = 48


def below(hashes: Column, fraction: float) -> Column:
    """The hashes below ``fraction`` of 2**48; where none is, the least of them."""
    limit = int(fraction * 2**BITS)
    least = F.when(F.size(hashes) > 0, F.array(F.array_min(hashes))).otherwise(hashes)
    return let(F.filter(hashes, lambda h: h < limit), lambda kept: F.when(F.size(kept) > 0, kept).otherwise(least))


def sketch(words: Column, fraction: float = FRACTION, shingle: int = SHINGLE) -> Column:
    """Ascending distinct shingle hashes that `below` keeps, from an array of words. No words: empty.

    ``words`` must be a plain column, or its expression is evaluated anew for each shingle.
    """
    def cut(h: Column) -> Column:
        return F.shiftrightunsigned(h, 64 - BITS)

    short = F.when(F.size(words) > 0, F.array(cut(F.xxhash64(words)))).otherwise(F.array().cast("array<bigint>"))
    long = F.transform(F.sequence(F.lit(0), F.size(words) - shingle), lambda i: cut(F.xxhash64(*[F.get(words, i + k) for k in range(shingle)])))
    kept = let(F.when(F.size(words) < shingle, short).otherwise(long), lambda hashes: below(hashes, fraction))
    return F.sort_array(F.array_distinct(kept))


def merged(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """The sketch of two texts' shingles together, from their sketches of the same ``fraction``."""
    return F.sort_array(let(F.array_union(a, b), lambda both: below(both, fraction)))


def similarity(a: Column, b: Column) -> Column:
    """Estimated share of common shingles among all of both (0 to 1). Both sketches empty: 0, for nothing is known to agree."""
    common = F.size(F.array_intersect(a, b))
    return F.coalesce(common / F.nullif(F.size(a) + F.size(b) - common, F.lit(0)), F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has too (0 to 1). Empty a: 0."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(a), F.lit(0)), F.lit(0.0))


def as_text(a: Column) -> Column:
    """The sketch as ascending decimal numbers with commas between."""
    return F.concat_ws(",", a.cast("array<string>"))


def with_sketch(df: DataFrame, text: str, name: str, fraction: float = FRACTION) -> DataFrame:
    """``df`` with the sketch of a text column."""
    words = fresh(df, "words")
    return df.withColumn(words, words_of(F.col(text))).withColumn(name, sketch(F.col(words), fraction)).drop(words)


def with_next(df: DataFrame, order: str, columns: list[str], prefix: str = "next_") -> DataFrame:
    """``df`` with ``columns`` of the next row by descending ``order`` (numeric, nulls last), after the last the first.

    Rows are dealt by ranges of ``order``; the first row of each range is also sent to the range before it as a guest, and the
    first of all to the last range, so one window per range is enough. Ties in ``order`` are broken by ``columns``.
    """
    cuts = cut_points(df, order, 4 * shuffle_partitions(df))
    top = df.agg(F.max(order).alias("top")).first()["top"]
    part, guest, visit = fresh(df, "range"), fresh(df, "guest"), fresh(df, "visit")
    # Range i ends with cut i, which occurs: descending, it comes first there, and last in range i + 1 as a guest.
    own = range_number(F.col(order), cuts)
    is_cut = F.coalesce(F.get(F.lit(np.array(cuts, np.int64)), own) == F.col(order), F.lit(False)) if cuts else F.lit(False)
    is_top = F.col(order).eqNullSafe(F.lit(top))

    def seat(at: Column, as_guest: int) -> Column:
        return F.struct(at.cast("int").alias("at"), F.lit(as_guest).alias("guest"))

    seats = F.filter(
        F.array(seat(own, 0), F.when(is_cut, seat(own + 1, 1)), F.when(is_top, seat(F.lit(0), 2))), lambda s: s.isNotNull())
    dealt = df.withColumn(visit, F.explode(seats)).withColumns({part: F.col(f"{visit}.at"), guest: F.col(f"{visit}.guest")}).drop(visit)
    window = Window.partitionBy(part).orderBy(F.col(guest), F.col(order).desc_nulls_last(), *[F.col(c) for c in columns])
    ahead = dealt.withColumns({f"{prefix}{c}": F.lead(c).over(window) for c in columns})
    return ahead.where(F.col(guest) == 0).drop(part, guest)


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last third (of code points, rounded down) replaced by as many first ones of ``following``, or all."""
    n = F.length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(following, F.lit(1), third))


def fingerprint_report(df: DataFrame, doc_id: str = "doc_id", text: str = "text", fraction: float = FRACTION) -> DataFrame:
    """Fingerprints of every text, of its edited form (`edited`, with the next document's text), and their likeness.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and the containments
    contained_edited, contained_next. Null text counts as empty; the fingerprint of a text without words is the empty string and
    like nothing; any other is like itself in full. Null doc_id comes last; a repeated doc_id
    is ordered by text. A single document is its own next one. Other columns are not read. An empty table gives no rows.
    """
    require(df, doc_id, text)
    rows = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    near = with_next(with_sketch(rows, "text", "sketch", fraction), "doc_id", ["text", "sketch"])
    changed = near.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), edited(F.col("text"), F.col("next_text")).alias("edited"),
                          "sketch", "next_sketch")
    both = with_sketch(changed, "edited", "edited_sketch", fraction)
    mine, other, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return both.select(
        "doc_id", "n_chars",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        as_text(mine).alias("fingerprint"), as_text(other).alias("edited_fingerprint"),
        similarity(mine, other).alias("near_edited"), similarity(mine, following).alias("near_next"),
        containment(mine, other).alias("contained_edited"), containment(mine, following).alias("contained_next"),
    )
