"""Line dedup: a suffix array over the corpus' lines, sorted by distributed prefix doubling.

Every line of every document is the start of a suffix: the lines from there to the document's end. Round 0 ranks suffixes by their first line;
each further round ranks them by twice as many lines, from the ranks of two places: (rank of i, rank of i + h). A
rank is the place of a suffix' group in the sorted order, so equal ranks are equal prefixes. Suffixes alone in their group, or that end within the
depth reached, are done and are asked about no more; the order of lines is that of their hashes, and a suffix comes before those it begins.

Ranked to a depth of ``min_lines``, suffixes with equal rank are exactly the intervals of the array whose longest common prefix reaches
min_lines: the repeated runs. A maximal repeated run is a chain of such places, so deleting the first min_lines of every
suffix but the earliest of its interval deletes the later copies of all maximal runs whole. Deeper ranks do not change what goes; where the array itself
is wanted (``place``), rounds go on until no suffix is left undecided.
A run of one line that counts by its words, or because it is a whole document, is judged by the ranks of round 0, and its owner by another 64 bits of the line too.

Ranks are worked out by bucket (see `exchange`): each pack of documents sends its distinct keys, with how many places have
them, and gets their ranks. Buckets hold ranges of the order, so bucket and place in the bucket make a global rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

from stratalog.llm.columns import require
from stratalog.llm.exchange import (ROWS, TALLY, answer, ask, bucket_count, by_doc_id, distinct, firsts, flags, kept, mix, numbered, numbers, order_keys, pack,
                                    question, rows_in, to_bytes, unsqueeze, use)

#: A repeated run has at least so many lines; blank lines neither count nor break a run.
MIN_LINES = 2
#: What the query and the pipeline pass as ``min_words``: a run of one line counts from so many words, as many as a window of op 3.
MIN_WORDS = 20
#: What comes after a suffix' last line: before all lines. Ranks of suffixes alone in their group are sent as ~rank, so they are negative.
END = np.int64(-1)
#: Bits for the place in a bucket.
PLACE_BITS = 40


class Lines:
    """Hashes of a pack's lines that are not blank, document after document by ascending doc_id. ``codes`` name lines, ``checks`` are 64 more bits."""

    def __init__(self, codes: np.ndarray, checks: np.ndarray, sizes: np.ndarray, order: np.ndarray):
        self.codes, self.checks, self.sizes, self.order = codes, checks, sizes, order
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        #: How many lines the suffix has.
        self.left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))

    def to_table(self) -> pa.Table:
        ends = pa.array(np.append(0, np.cumsum(self.sizes)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (self.codes, self.checks)]
        return pa.table([pa.array(self.order), *lists], ["order", "codes", "checks"])

    @staticmethod
    def of_table(rows: pa.Table) -> Lines:
        codes, checks = (rows.column(c).combine_chunks() for c in ("codes", "checks"))
        sizes = pc.list_value_length(codes).to_numpy().astype(np.int64)
        return Lines(codes.flatten().to_numpy(), checks.flatten().to_numpy(), sizes, rows.column("order").to_numpy())


def hashed(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each line."""
    both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in lines]), "<u8").reshape(-1, 2)
    return both[:, 0].astype(np.uint64), both[:, 1].astype(np.uint64)


class Texts:
    """The documents of a pack by ascending doc_id, cut into lines."""

    def __init__(self, rows: pa.Table, doc_id: str, text: str):
        self.rows = by_doc_id(rows, doc_id)
        self.texts = self.rows.column(text).to_pylist()
        self.split = [t.split("\n") if t else [] for t in self.texts]
        self.filled = [[i for i, line in enumerate(lines) if line.strip()] for lines in self.split]
        codes, checks = hashed([lines[i].encode() for lines, filled in zip(self.split, self.filled) for i in filled])
        self.lines = Lines(codes, checks, np.array([len(f) for f in self.filled], np.int64), order_keys(self.rows, doc_id))


def doublings(depth: int) -> list[int]:
    """By how many lines the second half of each round lies behind: 1, 2, 4, and last what is missing to ``depth``."""
    steps, h = [], 1
    while h < depth:
        steps.append(min(h, depth - h))
        h = min(2 * h, depth)
    return steps


def place_of(rank: np.ndarray) -> np.ndarray:
    """Places in the order, of suffixes alone in their group too."""
    return np.where(rank < 0, ~rank, rank)


def by_rank(rank: np.ndarray) -> np.ndarray:
    """Uniform numbers by which ranks are dealt to buckets: a group stays together, for its members' ranks depend on each other."""
    return mix(rank.astype(np.uint64), 0x31)


def rank_first(asked, _packs, buckets: int):
    """Ranks of lines: of each key the number of places with a smaller one in the bucket; turned negative (~) where one place has it."""
    sizes = [len(a[0]) for a in asked]
    keys, counts = np.concatenate([a[0] for a in asked]), np.concatenate([a[1] for a in asked]).astype(np.int64)
    return _ranked((keys,), counts, sizes, (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32))


def rank_pairs(asked, _packs):
    """Ranks of pairs of ranks. A pair's group keeps the rank of its first half, moved on by the places before it."""
    sizes = [len(a[0]) for a in asked]
    first, second = (np.concatenate([a[k] for a in asked]) for k in (0, 1))
    counts = np.concatenate([a[2] for a in asked]).astype(np.int64)
    return _ranked((second, first), counts, sizes, None)


def _ranked(keys: tuple, counts: np.ndarray, sizes: list[int], bucket):
    order = np.lexsort(keys)
    major = keys[-1][order]
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    group = np.cumsum(new) - 1
    total = np.bincount(group, counts[order]).astype(np.int64)
    before = np.cumsum(total) - total
    if bucket is None:
        # Count from where the group of the first half begins.
        head = np.ones(len(order), bool)
        head[1:] = major[1:] != major[:-1]
        base = np.maximum.accumulate(np.where(head, before[group], 0))
        value = major.astype(np.int64) + before[group] - base
    else:
        value = (bucket[order].astype(np.int64) << PLACE_BITS) + before[group]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.where(total[group] > 1, value, ~value)
    return [(r,) for r in np.split(rank, np.cumsum(sizes)[:-1])]


def lines_asked(asked) -> tuple[np.ndarray]:
    """How many lines a bucket was asked about."""
    return (np.array([sum(int(a[1].sum()) for a in asked)], np.int64),)


def distinct_lines(rank: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`distinct` of pairs of a rank and a check."""
    both = np.empty(len(rank), [("rank", np.int64), ("check", np.uint64)])
    both["rank"], both["check"] = rank, check
    return distinct(both)


def owners_of(asked, packs):
    """`firsts` for keys (first array) with a check (second), a kind (third) and a doc_id (fourth). The kind becomes the check's last bit."""
    return firsts([(key, check & ~np.uint64(1) | kind.astype(np.uint64), doc) for key, check, kind, doc in asked], packs)


def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES, removed: str = "n_lines_removed",
                min_words: int | None = None, place: str | None = None) -> DataFrame:
    """``df`` with later copies of repeated line runs cut out of ``text``, and how many lines each row lost.

    A line goes if a run of ``min_lines`` lines that covers it also starts earlier: at a smaller doc_id, or earlier in the same
    document; runs are judged on the input. With ``min_words`` (``min_lines`` at most 2) a run of one line counts too if it has so many words
    or is all of its document, so that a passage on one line and a copy of a one-line document go, while short headings stay. Lines end at a line feed and are compared exactly; blank ones (white space only) belong to no run and
    stay, unless nothing else is left, then the text is empty. Null texts stay null, texts without such runs stay as they are. Null
    doc_id comes after all others; rows that share a doc_id are ordered by their place in the table. Other columns stay;
    ``removed`` and ``place`` must not be among them. An empty table stays empty.

    ``place`` names a column for the place of the whole text in the suffix array: how many suffixes of all texts' lines come before its lines.
    Texts with equal lines have equal places; those that begin alike lie next to each other. Texts without a line have none.
    """
    require(df, doc_id, text)
    added = [removed] if place is None else [removed, place]
    for name in added:
        if name.lower() in {c.lower() for c in df.columns}:
            raise ValueError(f"column {name} exists already; pass another name")
    if min_lines < 1:
        raise ValueError("a run has at least one line")
    if min_words is not None and min_lines > 2:
        raise ValueError("runs count by words only where min_lines is 2 at most")
    packs = pack(df)
    buckets = bucket_count(df)
    steps = doublings(min_lines)
    rounds_of_runs = len(steps)

    def round_question(k: int) -> int:
        """The number of a round's question; that of the owners stands between the rounds of the runs and those after them."""
        return k + 1 if k < rounds_of_runs else k + 2

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, raw in zip(batch.column("pack").to_pylist(), batch.column("payload")):
                payload = to_bytes(Texts(rows_in(raw.as_py()), doc_id, text).lines.to_table())
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([payload], pa.binary())], ["pack", "payload"])

    def ask_lines(rows: pa.Table):
        keys, counts = np.unique(Lines.of_table(rows).codes, return_counts=True)
        return keys, (keys, counts.astype(np.int32))

    def ranks(lines: Lines, answered, rounds: int) -> np.ndarray:
        """Ranks of all suffixes after so many rounds, from the answers to the questions before."""
        keys, number = np.unique(lines.codes, return_inverse=True)
        rank = numbers(answered(keys))[number]
        for k in range(rounds):
            at, _, first, number = pairs(lines, rank, k)
            rank[at] = numbers(answered(by_rank(rank[at[first]]), round_question(k)))[number]
        return rank

    def pairs(lines: Lines, rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Suffixes that go on, for they share their rank and do not end within its depth; the places of their second halves; their distinct pairs."""
        at = np.flatnonzero((rank >= 0) & (lines.left >= 1 + sum(steps[:k])))
        second = np.where(lines.left[at] > steps[k], place_of(rank[np.minimum(at + steps[k], len(rank) - 1)]), END)
        both = mix(rank[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ mix(second.astype(np.uint64), 0x21), 0x22)
        return at, second, *distinct(both)

    def ask_pairs(k: int):
        def work(number, rows, answered):
            lines = Lines.of_table(rows)
            rank = ranks(lines, answered, k)
            at, second, first, pair = pairs(lines, rank, k)
            one = at[first]
            arrays = rank[one], second[first], np.bincount(pair, minlength=len(first)).astype(np.int32)
            return question(number, by_rank(rank[one]), arrays, buckets)

        return work

    def runs(lines: Lines, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Suffixes in an interval with a common prefix of min_lines; of each interval the first one and its key."""
        at = np.flatnonzero((rank >= 0) & (lines.left >= min_lines))
        first, number = distinct(rank[at]) if min_lines > 1 else distinct_lines(rank[at], lines.checks[at])
        return at, first, number, by_rank(rank[at][first])

    def singles(lines: Lines, answered) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lines that occur again, where runs of one line are judged too; of each line the first one and its key."""
        rank = ranks(lines, answered, 0)
        at = np.flatnonzero(rank >= 0) if min_words is not None and min_lines > 1 else np.zeros(0, np.int64)
        first, number = distinct_lines(rank[at], lines.checks[at])
        return at, first, number, by_rank(rank[at][first])

    def ask_owner(number, rows, answered):
        lines = Lines.of_table(rows)
        at, first, _, keys = runs(lines, ranks(lines, answered, rounds_of_runs))
        one, one_first, _, one_keys = singles(lines, answered)
        places = np.concatenate([at[first], one[one_first]])
        # Ranks of two lines and more stand for 128 bits or more; those of one line get 64 more.
        check = lines.checks[places]
        if min_lines > 1:
            check[: len(keys)] = 0
        kind = np.repeat(np.array([0, 1], np.uint8), [len(keys), len(one_keys)])
        both = np.concatenate([keys, one_keys])
        return question(number, both, (both, check, kind, lines.order[lines.doc[places]]), buckets)

    def clean(_number, rows, answered):
        whole = Texts(rows, doc_id, text)
        lines = whole.lines
        at, first, number, keys = runs(lines, ranks(lines, answered, rounds_of_runs))
        one, one_first, one_number, one_keys = singles(lines, answered)
        owner, one_owner = np.split(flags(answered(np.concatenate([keys, one_keys]), rounds_of_runs + 1)), [len(keys)])
        later = ~owner[number] | (first[number] != np.arange(len(at)))
        change = np.zeros(len(lines.codes) + 1, np.int32)
        np.add.at(change, at[later], 1)
        np.add.at(change, at[later] + min_lines, -1)
        gone = np.cumsum(change[:-1]) > 0
        again = one[~one_owner[one_number] | (one_first[one_number] != np.arange(len(one)))]
        starts = np.cumsum(lines.sizes) - lines.sizes
        for i in again[~gone[again]]:
            d = lines.doc[i]
            line = whole.split[d][whole.filled[d][i - starts[d]]]
            gone[i] = lines.sizes[d] == 1 or len(line.encode().split()) >= min_words
        texts, lost = whole.texts, np.zeros(len(lines.sizes), np.int64)
        ends = np.cumsum(lines.sizes)
        for d in np.unique(lines.doc[gone]):
            own = gone[ends[d] - lines.sizes[d] : ends[d]]
            drop = {i for i, g in zip(whole.filled[d], own) if g}
            lost[d] = len(drop)
            texts[d] = "" if own.all() else "\n".join([x for i, x in enumerate(whole.split[d]) if i not in drop])
        out = whole.rows.set_column(whole.rows.schema.get_field_index(text), text, pa.array(texts, pa.string()))
        out = out.append_column(removed, pa.array(lost))
        if place is None:
            return out
        # Without a line a text begins no suffix; the number read in its stead is masked.
        first_line = np.minimum(starts, max(0, len(lines.codes) - 1))
        at = place_of(ranks(lines, answered, len(steps))[first_line]) if len(lines.codes) else np.zeros(len(starts), np.int64)
        return out.append_column(place, pa.array(before[at >> PLACE_BITS] + (at & ((1 << PLACE_BITS) - 1)), mask=lines.sizes == 0))

    # The rounds run on the lines' hashes; the texts are needed for the cutting alone.
    small = kept(packs.mapInArrow(cut, "pack bigint, payload binary"))
    found = kept(answer(ask(small, ask_lines, buckets), lambda asked, p: rank_first(asked, p, buckets), lines_asked))
    # Lines in the buckets before each one: a number for each bucket.
    before = np.zeros(buckets, np.int64)
    for r in found.where(found["pack"] == TALLY).collect():
        before[r["bucket"]] = unsqueeze(r["payload"])[0][0]
    before = np.cumsum(before) - before
    found = found.where(found["pack"] != TALLY)
    for k in range(rounds_of_runs):
        found = kept(found.union(numbered(answer(use(small, found, ask_pairs(k), ROWS), rank_pairs), round_question(k))))
    if place is not None:
        while True:
            steps.append(1 + sum(steps))
            undecided = kept(use(small, found, ask_pairs(len(steps) - 1), ROWS))
            if undecided.isEmpty():
                steps.pop()
                break
            found = kept(found.union(numbered(answer(undecided, rank_pairs), round_question(len(steps) - 1))))
    owners = numbered(answer(use(small, found, ask_owner, ROWS), owners_of), rounds_of_runs + 1)
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return use(packs, found.union(owners), clean, ", ".join([fields, *(f"`{name}` bigint" for name in added)]))
