"""Substring dedup by recompression: repeated runs of words are found through symbols that equal substrings share.

Each text is a sequence of word symbols. Recompression renames it in rounds: runs of one symbol get a name, then pairs
whose left symbol falls on one side of a random split of all names and whose right symbol on the other. A name is a hash of
what it stands for, so all tasks give the same substring the same name without a dictionary. Whether a symbol comes to be
depends on few words around it; that reach is carried along. If a window of words is repeated elsewhere, every symbol whose reach lies
within the window is there as well.

Two rounds of questions to the whole corpus (see `exchange`) follow. The first counts the symbols: a window with a symbol
that occurs once cannot be repeated, and drops out. The second verifies what is left: 96 bits of hash over the exact words of each remaining window,
and who has each first. Later copies are removed.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.columns import require
from stratalog.llm.exchange import (ROWS, answer, ask, bucket_count, by_doc_id, distinct, firsts, flags, mix, numbered, order_keys, pack, question,
                                    use)
from stratalog.session import durable

WINDOW = 20
#: Runs longer than this keep one symbol per word, marked as in a long run.
LONG_RUN = 7
ROUNDS = 3


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


@dataclass
class Words:
    """The words of a pack's documents, one after the other."""

    words: list[bytes]
    sizes: np.ndarray
    codes: np.ndarray

    @staticmethod
    def of(rows: pa.Table) -> Words:
        words, sizes, codes = [], [], _Codes()
        for text in rows.column("text"):
            own = (text.as_py() or "").encode().split()
            words += own
            sizes.append(len(own))
        return Words(words, np.array(sizes, np.int64), np.fromiter(map(codes.__getitem__, words), np.uint64, len(words)))

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)


@dataclass
class Symbols:
    """Names with the words [start, end) they stand for and the words [low, high) on which they depend."""

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray


def recompress(codes: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> Symbols:
    """The symbols after run naming and ``rounds`` of pair naming. Documents stay apart."""
    n = len(codes)
    new = np.ones(n, bool)
    new[1:] = (codes[1:] != codes[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, n))
    long = size > LONG_RUN
    keep = new | np.repeat(long, size)
    start = np.flatnonzero(keep)
    run = np.repeat(np.arange(len(begin)), np.where(long, size, 1))
    first, k = begin[run], size[run]
    long = long[run]
    end = np.where(long, start + 1, start + k)
    name = mix(codes[start], 0x51)
    name = np.where(long, mix(name, 0x71), np.where(k > 1, mix(name + k.astype(np.uint64), 0x61), name))
    fixed = k > 1  # runs pair with nothing
    low = np.where(long, np.maximum(start - LONG_RUN, first), start - 1)
    high = np.where(long, low + LONG_RUN + 1, end + 1)
    doc = doc[start]
    for r in range(rounds):
        if len(name) < 2:
            break
        side = (mix(name, 0x1000 + r) & np.uint64(1)).astype(bool)  # False: may stand left, True: may stand right
        same = doc[1:] == doc[:-1]
        pair = ~side[:-1] & side[1:] & ~fixed[:-1] & ~fixed[1:] & same
        second = np.append(False, pair)
        # A symbol that stays single has seen the neighbour that it might have joined; at a document's end, the end.
        single_left = ~fixed & ~side & ~np.append(pair, False)
        single_right = ~fixed & side & ~second
        after_low, after_high = np.append(low[1:], n), np.append(high[1:], n)
        ends = np.append(~same, True)
        see_low = np.where(single_left & ~ends, np.minimum(low, after_low), low)
        see_high = np.where(single_left, np.where(ends, np.maximum(high, end + 1), np.maximum(high, after_high)), high)
        before_low, before_high = np.append(0, low[:-1]), np.append(0, high[:-1])
        begins = np.append(True, ~same)
        see_low = np.where(single_right, np.where(begins, np.minimum(see_low, start - 1), np.minimum(see_low, before_low)), see_low)
        see_high = np.where(single_right & ~begins, np.maximum(see_high, before_high), see_high)
        at = np.flatnonzero(pair)
        name = name.copy()
        name[at] = mix(name[at] * np.uint64(0x9E3779B97F4A7C15) ^ mix(name[at + 1], 0x81), 0x91 + r)
        end = end.copy()
        end[at] = end[at + 1]
        see_low[at], see_high[at] = np.minimum(low[at], low[at + 1]), np.maximum(high[at], high[at + 1])
        stay = ~second
        name, start, end, low, high, fixed, doc = (a[stay] for a in (name, start, end, see_low, see_high, fixed, doc))
    return Symbols(name, start, end, low, high)


def usable(s: Symbols, window: int) -> np.ndarray:
    """Places of the symbols that can rule out a window: of two words and more, with a reach that fits."""
    return np.flatnonzero((s.high - s.low <= window) & (s.end - s.start > 1))


def window_starts(sizes: np.ndarray, window: int) -> np.ndarray:
    """Which words begin a window within their document."""
    n = int(sizes.sum())
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)
    return left >= window


def candidates(w: Words, shared: np.ndarray, s: Symbols, at: np.ndarray, window: int) -> np.ndarray:
    """Starts of windows without a symbol (``at``) that is not ``shared``."""
    n = len(w.words)
    lone = at[~shared]
    change = np.zeros(n + window + 2, np.int32)
    np.add.at(change, np.maximum(s.high[lone] - window, 0), 1)
    np.add.at(change, np.maximum(s.low[lone], -1) + 1, -1)
    return np.flatnonzero((np.cumsum(change[:n]) == 0) & window_starts(w.sizes, window))


def window_keys(codes: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of hash of the windows' words."""
    a = np.full(len(starts), window, np.uint64)
    b = np.full(len(starts), 0x5BD1E995, np.uint64)
    for k in range(window):
        c = codes[starts + k]
        a = (a ^ c) * np.uint64(0x9E3779B97F4A7C15)
        a ^= a >> np.uint64(32)
        b = (b + c) * np.uint64(0xC2B2AE3D27D4EB4F)
        b ^= b >> np.uint64(29)
    return mix(a, 0xA1), (mix(b, 0xB1) >> np.uint64(32)).astype(np.uint32)


def removed_words(starts: np.ndarray, later: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which words a later window covers."""
    change = np.zeros(n + 1, np.int32)
    at = starts[later]
    np.add.at(change, at, 1)
    np.add.at(change, at + window, -1)
    return np.cumsum(change[:n]) > 0


def dedup_words(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and kept (text): the words left, joined by one space.

    A word goes if a window of ``window`` words that covers it also starts earlier: at a smaller doc_id, or earlier in the same
    document. Windows are judged on the input. Words are runs of anything but ASCII white space. Null text has no words; a
    text shorter than a window keeps all. Null doc_id comes after all others; rows that share a doc_id are ordered by their place in
    the table. Other columns are not read; an empty table gives no rows.
    """
    require(df, doc_id, text)
    packs = pack(df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")))
    buckets = bucket_count(df)

    def symbols_of(w: Words) -> tuple[Symbols, np.ndarray, np.ndarray, np.ndarray]:
        s = recompress(w.codes, w.doc, rounds)
        at = usable(s, window)
        first, number = distinct(s.name[at])
        return s, at, first, number

    def ask_symbols(rows: pa.Table):
        s, at, first, number = symbols_of(Words.of(by_doc_id(rows)))
        names = s.name[at][first]
        return names, ((names & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.bincount(number, minlength=len(first)) > 1)

    def count_symbols(asked, _packs):
        sizes = [len(a[0]) for a in asked]
        _, number = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
        seen = np.bincount(number) + np.bincount(number, np.concatenate([a[1] for a in asked]))
        return [(np.packbits(f),) for f in np.split(seen[number] > 1, np.cumsum(sizes)[:-1])]

    def windows_of(w: Words, answered):
        s, at, first, number = symbols_of(w)
        shared = flags(answered(s.name[at][first]))[number]
        starts = candidates(w, shared, s, at, window)
        high, low = window_keys(w.codes, starts, window)
        first, number = distinct(high ^ low.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return starts, first, number, high[first], low[first]

    def ask_windows(number, rows, answered):
        rows = by_doc_id(rows)
        w = Words.of(rows)
        starts, first, _, high, low = windows_of(w, answered)
        return question(number, high, (high, low, order_keys(rows)[w.doc[starts[first]]]), buckets)

    def clean(number, rows, answered):
        rows = by_doc_id(rows)
        w = Words.of(rows)
        starts, first, place, high, _ = windows_of(w, answered)
        is_first = flags(answered(high, 1))
        later = ~is_first[place]
        later[:] |= first[place] != np.arange(len(starts))
        gone = removed_words(starts, later, len(w.words), window)
        ends = np.cumsum(w.sizes)
        kept, counts = [], []
        for start, end in zip(ends - w.sizes, ends):
            part = gone[start:end]
            own = w.words[start:end]
            lost = int(part.sum())
            kept.append((b" ".join(own) if not lost else b" ".join([x for x, g in zip(own, part) if not g])).decode())
            counts.append(lost)
        return pa.table([rows.column("doc_id"), pa.array(w.sizes), pa.array(counts, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    shared = durable(answer(ask(packs, ask_symbols, buckets), count_symbols))
    owners = answer(use(packs, shared, ask_windows, ROWS), firsts)
    return use(packs, shared.union(numbered(owners, 1)), clean, "doc_id bigint, n_words bigint, n_removed bigint, kept string")
