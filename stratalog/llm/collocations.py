"""Phrase collocations by dynamic itemset counting.

The corpus is dealt into shards, which are scanned in a cycle, one per step. Words are counted from the first step on. A longer phrase is
activated as soon as both its subphrases (without its last, without its first word) have been counted often enough *so far*, so
lengths interleave: while words still finish their cycle, pairs of words are counted already. Each phrase is counted for
exactly one full cycle from its activation on, so every count that is kept is exact. Steps end when nothing was activated for a whole cycle.

What is active follows from two filters alone: the subphrases frequent before this step, and those frequent one cycle ago. A phrase
whose subphrases both pass the first filter, but not both the second, is counted. The filter is a bitmap of hashes of one fixed size (`filter_bits`, at
most FILTER_BITS) and only gains bits, so a chance hit activates a phrase early, for a full cycle as well: it costs time and changes no count.

Texts are cut into words once; steps work on arrays of word numbers in packs (rows of some megabytes of one language). A pack sends what it counts
in a step to buckets of key values, as in `exchange`: per phrase the 64-bit hash, 16 bits of a second one and the count, not the words. Two
phrases are taken for one only if all 80 bits are equal. A bucket adds the counts to those of the steps before. A phrase that ends its cycle below
the threshold leaves the table. The words of the frequent ones are asked once, at the end, of the first pack that counted them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalog.llm.columns import give_back, require
from stratalog.llm.exchange import ROWS, bucket_count, mix, rows_in, squeeze, to_bytes, unsqueeze
from stratalog.session import durable

LONGEST, LEAST, TOP, UNKNOWN = 5, 100, 2000, "und"
#: Shards in a cycle. Every step deals the open counts again, so more shards cost more shuffle.
SHARDS = 2
#: Bytes of texts in a pack.
PACK_BYTES = 8 << 20
#: Bytes of rows that go to a Python worker at once; a longer row goes by itself.
BATCH_BYTES = 4 << 20
#: The filter has so many bits per phrase that can become frequent, between these bounds.
BITS_PER_PHRASE, FEWEST_BITS, FILTER_BITS = 16, 1 << 16, 1 << 26
#: Bits in a piece of the filter as it is built.
CHUNK = 1 << 18
#: The pack of rows that hold a bucket's counts so far.
KEPT = -1

# A-Z in lower case, ends of pieces as line feeds, tabs as spaces.
_BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
_BREAK = b"\n"


class Pack:
    """Words of texts of one language: distinct words with two 64-bit hashes of each and the language, and their numbers in order; -1 ends a piece."""

    def __init__(self, words: pa.Array, codes: np.ndarray, keys: np.ndarray, checks: np.ndarray):
        self.words, self.codes, self.keys, self.checks = words, codes, keys, checks

    @staticmethod
    def of_texts(texts: list[bytes], lang: str) -> Pack:
        # Split by Arrow: as Python objects the words of a pack would take ten times its bytes.
        joined = pa.array([_BREAK.join(texts).translate(_BYTES).replace(_BREAK, b" \n ")], pa.large_binary())
        coded = pc.split_pattern(joined, " ").values.dictionary_encode()
        words, codes = coded.dictionary.cast(pa.binary()), coded.indices.to_numpy()
        del joined, coded
        number = np.empty(len(words), np.int32)
        real = np.array([w not in (b"", _BREAK) for w in words.to_pylist()], bool)
        number[real] = np.arange(real.sum())
        number[~real] = [-1 if w == _BREAK else -2 for w in words.filter(pa.array(~real)).to_pylist()]
        codes = number[codes]
        words, seed = words.filter(pa.array(real)), xxhash.xxh64_intdigest(lang.encode())
        keys, checks = (np.array([h(w, seed) for w in words.to_pylist()], np.uint64) for h in (xxhash.xxh64_intdigest, xxhash.xxh3_64_intdigest))
        return Pack(words, codes[codes != -2].astype(np.int32), keys, checks)

    def to_bytes(self) -> bytes:
        return squeeze((to_bytes(pa.table([self.words], ["w"])), self.codes, self.keys, self.checks))

    @staticmethod
    def of_bytes(raw: bytes) -> Pack:
        words, codes, keys, checks = unsqueeze(raw)
        return Pack(rows_in(words).column("w").combine_chunks(), codes, keys, checks)

    def phrases(self, starts: np.ndarray, size: int) -> pa.Array:
        """The words of phrases, joined by spaces."""
        parts = [self.words.take(pa.array(self.codes[starts + k])) for k in range(size)]
        return pc.binary_join_element_wise(*parts, b" ").cast(pa.string()) if size > 1 else parts[0].cast(pa.string())

    def second(self, starts: np.ndarray, size: int) -> np.ndarray:
        """16 bits of the second hash of phrases."""
        check = self.checks[self.codes[starts]]
        for k in range(1, size):
            check = longer_key(check, self.checks[self.codes[starts + k]])
        return (check >> np.uint64(48)).astype(np.uint16)


def longer_key(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase and one more word."""
    return mix(key * np.uint64(0x9E3779B97F4A7C15) + word, 0x5D)


class Filter:
    """Which phrases may be frequent: a bitmap of their hashes. Only gains bits."""

    def __init__(self, bits: int, raw: np.ndarray | None = None):
        self.bits, self.raw = bits, np.zeros(bits // 8, np.uint8) if raw is None else raw

    def has(self, keys: np.ndarray) -> np.ndarray:
        place = keys & np.uint64(self.bits - 1)
        return (self.raw[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

    def joined(self, chunks: list[tuple[int, bytes]]) -> Filter:
        raw = self.raw.copy()
        for number, packed in chunks:
            part = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
            raw[number * len(part) : (number + 1) * len(part)] |= part
        return Filter(self.bits, raw)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Filter) and np.array_equal(self.raw, other.raw)


def filter_bits(words: int, least: int) -> int:
    """Bits for all phrases that ``words`` words can make frequent, up to FILTER_BITS: each length has at most words / least of them."""
    wanted, bits = BITS_PER_PHRASE * (LONGEST - 1) * (words // least), FEWEST_BITS
    while bits < min(wanted, FILTER_BITS):
        bits *= 2
    return bits


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Lowers the session's Arrow batches, if they are Spark's default, while the packs are worked on. Changes memory only, no result."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name)
    lowers = held.rstrip("b") == str(64 << 20)
    if lowers:
        spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        if lowers:
            spark.conf.set(name, held)


def packed(docs: DataFrame, text: str, lang: str, shards: int, pack_bytes: int) -> DataFrame:
    """Packs as a written table: pack (its number), shard, lang, n (words), payload. Nothing is shuffled."""
    rows = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        number, held, size = task, defaultdict(list), 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal number
            for name, texts in held.items():
                made = Pack.of_texts(texts, name)
                yield pa.RecordBatch.from_arrays([pa.array([(task << 32) + number - task], pa.int64()), pa.array([number % shards], pa.int32()), pa.array([name]),
                                                  pa.array([int((made.codes >= 0).sum())], pa.int64()), pa.array([made.to_bytes()], pa.binary())],
                                                 ["pack", "shard", "lang", "n", "payload"])
                number += 1
            held.clear()
            give_back()

        for batch in batches:
            for t, name in zip(batch.column(0), batch.column(1)):
                raw = t.as_buffer().to_pybytes()
                held[name.as_py()].append(raw)
                size += len(raw) + 64
                if size >= pack_bytes:
                    yield from out()
                    size = 0
        yield from out()

    return durable(rows.mapInArrow(run, "pack bigint, shard int, lang string, n bigint, payload binary"))


def counted(pack: Pack, now: Filter, before: Filter | None, words: bool, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """What a pack counts in a step: (size, a start, hash and count of each distinct phrase). ``before``: the filter of one cycle ago; ``words``: single words too."""
    codes = pack.codes
    of_word = pack.keys
    at = np.flatnonzero(codes >= 0).astype(np.int32)
    if words and len(at):
        start = np.empty(len(of_word), np.int32)
        start[codes[at[::-1]]] = at[::-1]
        yield 1, start, of_word, np.bincount(codes[at], minlength=len(of_word))
    # Per place that still counts: where, and the phrase' number. Per distinct phrase: its hash, whether it is frequent now, whether it was one cycle ago.
    name, key = codes[at], of_word
    is_now = now.has(key)
    was = before.has(key) if before is not None else np.zeros(len(key), bool)
    for size in range(2, longest + 1):
        keep = is_now[name]
        at, name = at[keep], name[keep]
        both = np.flatnonzero(at[1:] == at[:-1] + 1)
        if len(both) == 0:
            return
        head, rest, at = name[both], name[both + 1], at[both]
        del keep, both
        last = codes[at + (size - 1)]
        first, name, count = _numbered(head.astype(np.int64) * (len(pack.words) + 1) + last)
        # Whether a phrase is active follows from its words, so it is the same at all its places.
        active_before = was[head[first]] & was[rest[first]]
        key = longer_key(key[head[first]], of_word[last[first]])
        del head, rest, last
        new = np.flatnonzero(~active_before)
        if len(new):
            yield size, at[first[new]], key[new], count[new]
        is_now = now.has(key)
        was = active_before & before.has(key) if before is not None else np.zeros(len(key), bool)


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct values, ascending: the first place, the number at each place, how often it occurs. Sorted, which takes less memory than hashing."""
    order = np.argsort(values, kind="stable")
    values = values[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    del values
    at, name = np.flatnonzero(new), np.empty(len(order), np.int32)
    name[order] = np.cumsum(new, dtype=np.int32) - 1
    return order[at], name, np.diff(at, append=len(order))


def _lean(numbers: np.ndarray) -> np.ndarray:
    """Counts in the fewest bytes that hold them."""
    return numbers.astype(np.min_scalar_type(int(numbers.max(initial=0))))


def _planes(keys: np.ndarray) -> np.ndarray:
    """Ascending keys as bytes of their steps, so that those that are mostly zero lie together."""
    return np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.copy()


def _keys(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(planes.T.copy().view("<u8").ravel(), dtype=np.uint64)


def sent(number: int, pack: Pack, now: Filter, before: Filter | None, words: bool, longest: int, buckets: int) -> pa.Table:
    """What a pack counts in a step, for each bucket that gets any: ROWS with keys, second hashes, sizes and counts."""
    found = [(key, pack.second(start, size), np.full(len(key), size, np.uint8), _lean(count)) for size, start, key, count in counted(pack, now, before, words, longest)]
    if not found:
        return pa.table([pa.array([], t) for t in (pa.int32(), pa.int64(), pa.binary())], ["bucket", "pack", "payload"])
    keys, check, size, count = _joined(found)
    order = np.argsort(keys)
    keys = keys[order]
    check, size, count = (x[order] for x in (check, size, count))
    ends = _ends(keys, buckets)
    full = np.flatnonzero(np.diff(ends))
    payload = [squeeze((_planes(keys[a:b]), check[a:b], size[a:b], _lean(count[a:b]))) for a, b in zip(ends[full], ends[full + 1])]
    return pa.table([pa.array(full, pa.int32()), pa.array([number] * len(full), pa.int64()), pa.array(payload, pa.binary())], ["bucket", "pack", "payload"])


def _joined(parts: list[tuple]) -> list[np.ndarray]:
    """Each column of ``parts`` as one array; ``parts`` is emptied, so that no column is held twice for long."""
    columns = [list(x) for x in zip(*parts)]
    parts.clear()
    return [np.concatenate(columns.pop(0)) for _ in range(len(columns))]


def _ends(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins and ends in ascending keys, as `deal` gives them, without arrays of the length of the keys."""
    least = [-((-b << 32) // buckets) << 32 for b in range(buckets)]
    return np.append(np.searchsorted(keys, np.array(least, np.uint64)), len(keys))


def adder(step: int, least: int, longest: int, shards: int) -> Callable[[pa.Table], pa.Table]:
    """Makes a bucket's counts after a step: one row of the pack KEPT; ``frequent`` holds the keys of frequent phrases that a longer one may have."""

    def add(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pack")  # what was kept comes first
        parts = []
        for number, raw in zip(rows.column("pack").to_pylist(), rows.column("payload")):
            planes, check, size, c, *more = unsqueeze(raw.as_py())
            since, pack = more or (np.full(len(check), step, np.int32), np.full(len(check), number, np.int64))
            parts.append((_keys(planes), check, size, c, since, pack))
        key, check, size, c, since, pack = _joined(parts)
        order = np.lexsort((check, key))  # stable: equal ones stay by pack
        key, check = key[order], check[order]
        new = np.ones(len(order), bool)
        new[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
        at = np.flatnonzero(new)
        c, since = np.add.reduceat(c[order], at, dtype=np.int64), since[order[at]]
        # Counted since its first shard at the latest; a rare one that has been round is out.
        keep = (c >= least) | (since + shards - 1 > step)
        key, check, size, c, since, pack = key[at][keep], check[at][keep], size[order[at]][keep], c[keep], since[keep], pack[order[at]][keep]
        state = squeeze((_planes(key), check, size, _lean(c), since, pack))
        frequent = squeeze((key[(c >= least) & (size < longest)],))
        return pa.table([rows.column("bucket")[:1], pa.array([KEPT], pa.int64()), pa.array([state], pa.binary()), pa.array([frequent], pa.binary())],
                        ["bucket", "pack", "payload", "frequent"])

    return add


def chunks_of(table: DataFrame, bits: int) -> DataFrame:
    """Pieces of the filter that the frequent phrases of a table set: (chunk, compressed bits), at most bits / CHUNK rows."""
    size = min(CHUNK, bits)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                place = np.unique(unsqueeze(raw.as_py())[0] & np.uint64(bits - 1)).astype(np.int64)
                yield from pa.table([pa.array((place // size).astype(np.int32)), pa.array((place % size).astype(np.int32))], ["chunk", "place"]).to_batches(20_000)

    def pack_bits(rows: pa.Table) -> pa.Table:
        mask = np.zeros(size, np.uint8)
        mask[rows.column("place").to_numpy()] = 1
        raw = zstandard.ZstdCompressor(level=1).compress(np.packbits(mask, bitorder="little").tobytes())
        return pa.table([rows.column("chunk")[:1], pa.array([raw], pa.binary())], ["chunk", "bits"])

    some = table.select("frequent").mapInArrow(places, "chunk int, place int").distinct()
    return some.groupBy("chunk").applyInArrow(pack_bits, "chunk int, bits binary")


def phrase_counts(packs: DataFrame, least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS) -> DataFrame:
    """(lang, phrase, size, c) of all phrases of up to ``longest`` words that occur ``least`` times or more, counted exactly."""
    spark, buckets = packs.sparkSession, bucket_count(packs)
    words = packs.agg(F.sum("n")).first()[0] or 0
    filters = [Filter(filter_bits(words, least))]
    table = None
    step = 0
    while step < shards or filters[step] != filters[step - shards]:
        now, before = filters[step], filters[step - shards] if step >= shards else None
        known = spark.sparkContext.broadcast((now, before))

        def run(batches: Iterator[pa.RecordBatch], known=known, counts_words=step < shards) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                    yield from sent(number, Pack.of_bytes(raw.as_py()), *known.value, counts_words, longest, buckets).to_batches()
                    give_back()

        found = packs.where(F.col("shard") == step % shards).select("pack", "payload").mapInArrow(run, ROWS)
        both = found if table is None else table.select("bucket", "pack", "payload").unionByName(found)
        table = durable(both.groupBy("bucket").applyInArrow(adder(step, least, longest, shards), f"{ROWS}, frequent binary"))
        filters.append(now.joined([(r["chunk"], bytes(r["bits"])) for r in chunks_of(table, now.bits).collect()]))
        known.unpersist()
        step += 1
    return named(packs, table, filters[-1], least, longest)


def named(packs: DataFrame, table: DataFrame, known: Filter, least: int, longest: int) -> DataFrame:
    """The frequent phrases of a table with their words, as a written table: lang, phrase, size, c. The first pack that counted a phrase tells them."""
    shared = packs.sparkSession.sparkContext.broadcast(known)

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                planes, check, size, c, _, pack = unsqueeze(raw.as_py())
                some = np.flatnonzero(c >= least)
                some = some[np.argsort(pack[some], kind="stable")]
                key, check, size, c, pack = (x[some] for x in (_keys(planes), check, size, c, pack))
                at = np.flatnonzero(np.diff(pack, prepend=np.int64(-1)))
                payload = [squeeze((key[a:b], check[a:b], size[a:b], c[a:b])) for a, b in zip(at, [*at[1:], len(pack)])]
                yield from pa.table([pa.array(pack[at], pa.int64()), pa.array(payload, pa.binary())], ["pack", "payload"]).to_batches()

    def tell(left: pa.Table, right: pa.Table) -> pa.Table:
        asked = [np.concatenate(x) for x in zip(*(unsqueeze(r.as_py()) for r in right.column("payload")))]
        parts = []
        if asked:
            pack = Pack.of_bytes(left.column("payload")[0].as_py())
            goal = pd.DataFrame(dict(zip(("key", "check", "size", "c"), asked)))
            for size, start, key, _ in counted(pack, shared.value, None, True, longest):
                some = np.flatnonzero(np.isin(key, goal["key"]))
                own = pd.DataFrame({"key": key[some], "check": pack.second(start[some], size), "start": start[some]})
                hit = own.merge(goal[goal["size"] == size], on=["key", "check"])
                parts.append((pack.phrases(hit["start"].to_numpy(), size), np.full(len(hit), size, np.int32), hit["c"].to_numpy(np.int64)))
        phrases = pa.chunked_array([p[0] for p in parts], pa.string())
        sizes, counts = (np.concatenate([np.zeros(0, t), *(p[k] for p in parts)]) for k, t in ((1, np.int32), (2, np.int64)))
        return pa.table([pa.repeat(left.column("lang")[0], len(sizes)), phrases, pa.array(sizes), pa.array(counts)], ["lang", "phrase", "size", "c"])

    asks = table.select("payload").mapInArrow(wanted, "pack bigint, payload binary")
    sides = packs.select("pack", "lang", "payload").groupBy("pack").cogroup(asks.groupBy("pack"))
    found = durable(sides.applyInArrow(tell, "lang string, phrase string, size int, c bigint"))
    shared.unpersist()
    return found


def scored(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Candidates with their lowest-scoring cut: lang, phrase, size, a, l, r, n, score. ``totals``: lang, n.

    score = floor(1000 a n / (l r)) in 38-digit decimals; ties to the earliest cut.
    """
    words = F.split("phrase", " ")
    phrases = counts.where(F.col("size") > 1).select("lang", "phrase", "size", F.col("c").alias("a"))
    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    cuts = phrases.select("*", cut).select(
        "*", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice(words, F.col("k") + 1, F.col("size")), " ").alias("rest"))
    part = counts.select("lang", "phrase", "c")
    found = (cuts.join(part.withColumnsRenamed({"phrase": "head", "c": "l"}), ["lang", "head"])
             .join(part.withColumnsRenamed({"phrase": "rest", "c": "r"}), ["lang", "rest"]).join(totals, "lang"))

    def wide(c: str) -> Column:
        return F.col(c).cast("decimal(19,0)")

    # Spark's `div` of decimals is exact; the quotient is at most 1000 n / least, so it fits.
    score = F.call_function("div", (F.lit(1000).cast("decimal(4,0)") * (wide("a") * wide("n")).cast("decimal(34,0)")).cast("decimal(38,0)"), (wide("l") * wide("r")).cast("decimal(38,0)"))
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")
    chosen = found.groupBy("lang", "phrase", "size", "a", "n").agg(best)
    return chosen.select("lang", "phrase", "size", "a", "best.l", "best.r", "n", "best.score")


def not_inside_longer(candidates: DataFrame, percent: int = 100) -> DataFrame:
    """Candidates no longer one contains and (nearly: ``percent``) always accompanies.

    Counts only fall as phrases grow, so if a longer candidate does, one of just one word more does.
    """
    words = F.split("phrase", " ")
    longer = candidates.where(F.col("size") > 2).select(
        "lang", F.explode(F.array(F.array_join(F.slice(words, F.lit(1), F.col("size") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("size") - 1), " "))).alias("phrase"),
        F.col("a").alias("with_more"))
    most = longer.groupBy("lang", "phrase").agg(F.max("with_more").alias("with_more"))
    kept = candidates.join(most, ["lang", "phrase"], "left")
    return kept.where(F.coalesce(F.lit(100) * F.col("with_more") < F.lit(percent) * F.col("a"), F.lit(True))).drop("with_more")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int | None = TOP, longest: int = LONGEST,
                 percent: int = 100, shards: int = SHARDS) -> DataFrame:
    """Per language the ``top`` phrases of 2 to ``longest`` words by score: lang, rank (from 1), phrase, a, l, r, n, score. ``top`` None: all.

    Null texts count as empty, null languages as `und`. Repeated rows count as often as they stand; ties go by a descending, then phrase in UTF-8
    byte order. Other columns are not read; an empty table, or one without frequent phrases, gives no rows.
    """
    require(docs, text, lang)
    with small_batches(docs.sparkSession):
        packs = packed(docs, text, lang, shards, PACK_BYTES)
        counts = phrase_counts(packs, least, longest, shards)
    totals = packs.groupBy("lang").agg(F.sum("n").alias("n"))
    kept = not_inside_longer(scored(counts, totals), percent)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("bigint"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)  # becomes a limit per partition before the shuffle
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
