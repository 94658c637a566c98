"""Benchmark decontamination: SimHash fingerprints of item-sized windows against those of the items.

1. Items and documents become sequences of hashed five-word shingles (lower case, ASCII white space between words).
2. Windows of an item's number of words that hold none of the items' shingles cannot resemble any, so only places near such a
   shingle are looked at. A bitmap of the items' hashes, a literal of the plan, finds these places while the texts are scanned; the
   texts themselves are never shuffled.
3. Such places give ranges of window starts. Along a range the SimHash rolls: running sums of what enters and leaves the window, for all 64
   bits at once, so a window costs the same however long its item is. The fingerprint is cut into 8 blocks; within a Hamming radius of 23 at
   least one block differs by 2 bits at most, so the items' blocks are listed with all their neighbours within 2 bits and joined by
   equality: no fingerprint within the radius is missed.
4. Candidates are verified on the shingles: 2 * common / (both sizes), counting repeats, must reach 0.8. The shingles that document and item
   share are joined, and a running sum over window starts gives the common ones of every window. At 0.8 two fingerprints differ by 13
   bits with a deviation of 3, so the radius keeps 999 of 1000 such windows, and a leak has many overlapping ones.

All of it is DataFrame operations.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.llm.columns import let, require, words_of
from stratalog.session import durable

SHINGLE, SIMILAR = 5, 0.8
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 8, 8, 2
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
#: Bits of the bitmap: at least so many per item shingle, within these bounds; each hash sets three. A fuller bitmap filters less but loses nothing.
BITS_PER_SHINGLE, FEWEST_BITS, MOST_BITS, PROBES = 128, 1 << 16, 1 << 21, (0, 21, 42)
#: Two bits are counted in one 64-bit lane, in 32 bits each, so windows may have up to 2**32 shingles.
LANES, LANE = 32, (1 << 32) + 1


def shingles(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words; ``words`` must be a plain column."""
    some = F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))
    return F.when(F.size(words) >= size, some).otherwise(F.array().cast("array<bigint>"))


def lane(h: Column, k: int) -> Column:
    """Bits k and k + 32 of a hash, as two counters in one number. Sums of lanes count both bits; differences undo sums."""
    return F.shiftrightunsigned(h, k).bitwiseAND(F.lit(LANE))


def majority(lanes: list[str], total: Column) -> Column:
    """The fingerprint of summed lanes: a bit is set where over half of ``total`` hashes have it."""
    def bit(k: int, j: int) -> Column:
        count = F.shiftrightunsigned(F.col(lanes[k]), LANES * j).bitwiseAND(F.lit((1 << 32) - 1))
        at = 1 << (k + LANES * j)
        return F.when(count * 2 > total, F.lit(at - (1 << 64) if at >> 63 else at)).otherwise(F.lit(0)).cast("bigint")

    found = bit(0, 0)
    for k in range(LANES):
        for j in range(2):
            if k or j:
                found = found.bitwiseOR(bit(k, j))
    return found


def with_simhash(df: DataFrame, hashes: str, name: str) -> DataFrame:
    """``df`` with the SimHash of an array of hashes: a bit is set where over half of them have it."""
    sums = {f"lane{k}": F.aggregate(hashes, F.lit(0).cast("bigint"), lambda a, h: a + lane(h, k)) for k in range(LANES)}
    return df.withColumns(sums).withColumn(name, majority(list(sums), F.size(hashes))).drop(*sums)


def prepared_items(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """Items with words, each pair of id and text once: entry (item_id and a hash of the words), n (words), size (words in a shingle), hashes and fp."""
    words = items.select(F.col(item_id).alias("item_id"), words_of(F.lower(text)).alias("words")).where(F.size("words") > 0)
    parts = [words.where(F.size("words") >= SHINGLE).withColumn("hashes", shingles(F.col("words"), SHINGLE)),
             words.where(F.size("words") < SHINGLE).withColumn("hashes", F.array(F.xxhash64("words")))]
    both = parts[0].unionByName(parts[1]).select(
        F.struct("item_id", F.xxhash64("words").alias("item")).alias("entry"), F.size("words").alias("n"), F.least(F.size("words"), F.lit(SHINGLE)).alias("size"), "hashes")
    return durable(with_simhash(both.dropDuplicates(["entry"]), "hashes", "fp"))


def bitmap(items: DataFrame) -> tuple[Column, int]:
    """A literal array of 64-bit words with three bits of each of the items' hashes set, and its number of bits, a power of two."""
    hashes = items.select(F.explode("hashes").alias("h"))
    bits = FEWEST_BITS
    count = hashes.count()
    while bits < MOST_BITS and bits < BITS_PER_SHINGLE * count:
        bits *= 2
    low = F.explode(F.array(*[F.shiftrightunsigned("h", p).bitwiseAND(F.lit(bits - 1)) for p in PROBES])).alias("low")
    ones = hashes.select(low).select(F.shiftright("low", 6).alias("at"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("low").bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    found = dict(ones.groupBy("at").agg(F.bit_or("bit")).collect())
    return F.lit(np.array([found.get(i, 0) for i in range(bits // 64)], np.int64)), bits


def suspects(docs: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """Documents with a place whose shingle may be an item's: doc, n, hashes, places."""
    literal, bits = bitmap(items)

    def may_be(h: Column) -> Column:
        def one(p: int) -> Column:
            low = F.shiftrightunsigned(h, p).bitwiseAND(F.lit(bits - 1))
            word = F.get(literal, F.shiftright(low, 6).cast("int"))
            return F.call_function("shiftrightunsigned", word, low.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

        return one(PROBES[0]) & one(PROBES[1]) & one(PROBES[2])

    def found(words: Column) -> Column:
        return let(shingles(words, size), lambda hashes: F.struct(
            F.size(words).alias("n"), hashes.alias("hashes"),
            F.filter(F.transform(hashes, lambda h, i: F.when(may_be(h), i)), lambda i: i.isNotNull()).alias("places")))

    # One generator finds and filters: a filter by itself would be worked out apart from the columns.
    some = F.filter(F.array(let(F.col("words"), found)), lambda s: F.size(s.places) > 0)
    return docs.select("doc", F.inline(some)).dropDuplicates(["doc"])


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
          similar: float = SIMILAR) -> DataFrame:
    """One row per document and item it leaks: doc_id, text_hash, item_id, similarity, start (first word of the most similar window),
    distance (of the fingerprints).

    Items may be of any length. Items without words leak nowhere; items under five words are one shingle. A document shorter than an item is one
    window. Null texts have no words. Rows are told apart by doc_id (null is a value) and text: repeated rows give one result.
    An item_id with several texts counts by its most similar one. Ties between windows: the earliest. Other columns are not read;
    empty tables give no rows.
    """
    require(docs, doc_id, text)
    require(items, item_id, item_text)
    ready = prepared_items(items, item_id, item_text)
    # In a struct a null id is a value that joins and groups like any other.
    lower = docs.select(F.struct(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash")).alias("doc"), words_of(F.lower(text)).alias("words"))
    sizes = [r[0] for r in ready.select("size").distinct().orderBy("size").collect()]  # 1 to 5
    if not sizes:
        return most_similar(_leaks(lower.limit(0), ready, SHINGLE, similar))
    found = None
    for size in sizes:
        part = _leaks(lower, ready.where(F.col("size") == size), size, similar)
        found = part if found is None else found.unionByName(part)
    return most_similar(found)


def _leaks(lower: DataFrame, items: DataFrame, size: int, similar: float) -> DataFrame:
    """Windows that reach ``similar`` among those within the radius: doc, entry, start, distance, similarity."""
    near = durable(suspects(lower, items, size))
    place = F.explode(F.transform("places", lambda p: F.struct(p.alias("p"), F.get("hashes", p).alias("h")))).alias("at")
    hits = near.select("doc", "n", place).select("doc", "n", "at.p", "at.h")
    candidates = durable(near_windows(fingerprinted(start_ranges(hits, items, size), near), items))
    return verified(candidates, hits, items, size, similar)


def start_ranges(hits: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """Ranges of starts of windows, as long as some item, that hold a place with a shingle of such an item: doc, length (words of the item),
    own (shingles of a window), low, high. Ranges of a document and length do not overlap; a shorter document is its own window."""
    item_shingles = items.select(F.col("n").alias("length"), F.explode("hashes").alias("h")).distinct()
    own = (F.least("length", "n") - size + 1).alias("own")
    last = F.greatest(F.col("n") - F.col("length"), F.lit(0)).alias("last")
    grouped = hits.join(item_shingles, "h").groupBy("doc", "n", "length").agg(F.sort_array(F.collect_set("p")).alias("places")).select("doc", "length", own, last, "places")

    def low(p: Column) -> Column:
        return F.least(F.greatest(p - F.col("own") + 1, F.lit(0)), F.col("last"))

    def high(p: Column) -> Column:
        return F.least(p, F.col("last"))

    # Both ends rise with the place, so a range begins where there is a gap to the place before and ends where there is one to the next.
    def begins(p: Column, i: Column) -> Column:
        return F.when((i == 0) | (low(p) > high(F.get("places", i - 1)) + 1), low(p))

    def ends(p: Column, i: Column) -> Column:
        return F.when((i == F.size("places") - 1) | (low(F.get("places", i + 1)) > high(p) + 1), high(p))

    lows, highs = (F.filter(F.transform("places", f), lambda x: x.isNotNull()).alias(name) for f, name in ((begins, "low"), (ends, "high")))
    both = F.explode(F.arrays_zip(lows, highs)).alias("range")
    return grouped.select("doc", "length", "own", both).select("doc", "length", "own", "range.low", "range.high")


def fingerprinted(ranges: DataFrame, near: DataFrame) -> DataFrame:
    """The SimHash of every window of the ranges: doc, length, own, start, window_fp."""
    part = F.slice("hashes", F.col("low") + 1, F.col("high") - F.col("low") + F.col("own")).alias("part")
    # Dealt as arrays: the rows per place are made where their running sums are.
    dealt = ranges.join(near.select("doc", "hashes"), "doc").select("doc", "length", "own", "low", part).repartition("doc", "length", "low")
    step = F.transform("part", lambda h, i: F.struct(i.alias("i"), h.alias("enters"), F.when(i >= F.col("own"), F.get("part", i - F.col("own"))).alias("leaves")))
    rows = dealt.select("doc", "length", "own", "low", F.explode(step).alias("step")).select("doc", "length", "own", "low", "step.*")
    along = Window.partitionBy("doc", "length", "low").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lanes = [f"lane{k}" for k in range(LANES)]
    sums = [F.sum(lane(F.col("enters"), k) - F.coalesce(lane(F.col("leaves"), k), F.lit(0))).over(along).alias(name) for k, name in enumerate(lanes)]
    full = rows.select("doc", "length", "own", "low", "i", *sums).where(F.col("i") >= F.col("own") - 1)
    return full.select("doc", "length", "own", (F.col("low") + F.col("i") - F.col("own") + 1).alias("start"), majority(lanes, F.col("own")).alias("window_fp"))


def near_windows(windows: DataFrame, items: DataFrame) -> DataFrame:
    """Windows and items of their length whose fingerprints are within the radius: doc, entry, start, distance, total (shingles of both)."""
    # Blocks of the items with all values within the block radius; blocks of the windows as they are.
    masks = [sum(1 << b for b in c) for r in range(BLOCK_RADIUS + 1) for c in combinations(range(BLOCK_BITS), r)]

    def blocks(fp: str) -> Column:
        return F.explode(F.array(*[F.struct(F.lit(b).alias("block"), F.shiftrightunsigned(F.col(fp), BLOCK_BITS * b).bitwiseAND(F.lit(2**BLOCK_BITS - 1)).alias("value"))
                                   for b in range(BLOCKS)]))

    of_items = items.select("entry", F.col("n").alias("length"), "fp", F.size("hashes").alias("shingles"), blocks("fp").alias("at")).select(
        "entry", "length", "fp", "shingles", F.col("at.block").alias("block"), F.explode(F.transform(F.lit(masks), lambda m: F.col("at.value").bitwiseXOR(m.cast("bigint")))).alias("value"))
    of_windows = windows.withColumn("at", blocks("window_fp")).select("doc", "length", "own", "start", "window_fp", F.col("at.block").alias("block"), F.col("at.value").alias("value"))
    # A pair that meets in several blocks counts in the first.
    apart = F.col("fp").bitwiseXOR(F.col("window_fp"))
    meets = [F.bit_count(F.shiftrightunsigned(apart, BLOCK_BITS * b).bitwiseAND(F.lit(2**BLOCK_BITS - 1))) <= BLOCK_RADIUS for b in range(BLOCKS)]
    first = F.coalesce(*[F.when(m, F.lit(b)) for b, m in enumerate(meets)])
    pairs = of_windows.join(of_items, ["length", "block", "value"]).where((F.bit_count(apart) <= RADIUS) & (F.col("block") == first))
    return pairs.select("doc", "entry", "start", F.bit_count(apart).alias("distance"), (F.col("own") + F.col("shingles")).alias("total"))


def verified(candidates: DataFrame, hits: DataFrame, items: DataFrame, size: int, similar: float) -> DataFrame:
    """Candidates whose windows share enough shingles with the item: doc, entry, start, distance, similarity.

    A window has min(c, its own number) of a shingle that the item has c times: of the shingle's places in the document, one counts for a
    window that holds it but not the place c before it. So each place counts for one range of window starts, and a sum over the ranges' ends gives
    the common shingles at each candidate's start.
    """
    wanted = items.select("entry", F.col("n").alias("length"), F.explode("hashes").alias("h")).groupBy("entry", "length", "h").agg(F.count(F.lit(1)).cast("int").alias("c"))
    shared = candidates.select("doc", "entry").distinct().join(wanted, "entry").join(hits, ["doc", "h"])
    own = (F.least("length", "n") - size + 1).alias("own")
    last = F.greatest(F.col("n") - F.col("length"), F.lit(0)).alias("last")
    grouped = shared.groupBy("doc", "entry", "length", "n", "h", "c").agg(F.sort_array(F.collect_list("p")).alias("places")).select("doc", "entry", own, last, "c", "places")

    def span(p: Column, i: Column) -> Column:
        before = F.when(i >= F.col("c"), F.get("places", i - F.col("c"))).otherwise(F.lit(-1))
        return F.struct(F.greatest(before + 1, p - F.col("own") + 1, F.lit(0)).alias("low"), F.least(p, F.col("last")).alias("high"))

    spans = grouped.select("doc", "entry", F.explode(F.transform("places", span)).alias("s")).where(F.col("s.low") <= F.col("s.high"))
    ends = F.explode(F.array(F.struct(F.col("s.low").alias("start"), F.lit(1).alias("step")), F.struct((F.col("s.high") + 1).alias("start"), F.lit(-1).alias("step")))).alias("e")
    steps = spans.select("doc", "entry", ends).select("doc", "entry", "e.start", "e.step", F.lit(None).cast("int").alias("distance"), F.lit(None).cast("int").alias("total"))
    asked = candidates.select("doc", "entry", "start", F.lit(0).alias("step"), "distance", "total")
    events = steps.unionByName(asked).groupBy("doc", "entry", "start").agg(F.sum("step").alias("step"), F.max("distance").alias("distance"), F.max("total").alias("total"))
    common = F.sum("step").over(Window.partitionBy("doc", "entry").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    known = events.withColumn("similarity", 2 * common / F.col("total")).where(F.col("distance").isNotNull())
    return known.where(F.col("similarity") >= similar).select("doc", "entry", "start", "distance", "similarity")


def most_similar(windows: DataFrame) -> DataFrame:
    """Of each document and item the most similar window, the earliest of equal ones."""
    best = F.max_by(F.struct("start", "distance"), F.struct("similarity", -F.col("start")))
    grouped = windows.groupBy("doc", F.col("entry.item_id").alias("item_id")).agg(F.max("similarity").alias("similarity"), best.alias("best"))
    return grouped.select("doc.doc_id", "doc.text_hash", "item_id", "similarity", F.col("best.start").alias("start"), F.col("best.distance").alias("distance"))


def without_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that leak no item, all columns as they were."""
    bad = durable(leaks(docs, items, doc_id, text, item_id, item_text).select(F.col("doc_id").alias("_leak_doc_id"), F.col("text_hash").alias("_leak_text_hash")).distinct())
    return docs.join(bad, docs[doc_id].eqNullSafe(bad["_leak_doc_id"]) & (F.xxhash64(docs[text]) == bad["_leak_text_hash"]), "left_anti")
