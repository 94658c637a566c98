"""Language-model scoring by deleted interpolation.

The model mixes maximum-likelihood estimates: p(w | h) = a2 * c(h, w) / c(h) + a1 * c(w) / N + a0 / (V + 1). The weights
depend on a bucket of how often the context h was seen, so rare contexts lean on their words alone. Expectation-maximisation
learns them on held-out counts: each training document of one fold is held out in turn by deleting its own counts from those of the corpus.

N-gram counts are gathered over the whole corpus by one question of packs to buckets (see `exchange`): each pack sends its
distinct n-grams with its training counts, and gets back those of all packs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.columns import require
from stratalog.llm.exchange import TALLY, answer, ask, bucket_count, mix, numbers, pack, unsqueeze, use
from stratalog.session import durable

#: Folds by crc32 of the doc_id as text: fold 0 is held out of training, fold 1 also serves to learn the weights.
FOLDS, HELD_OUT, DELETED = 10, 0, 1
#: Contexts are in bucket b when seen 2**(b-1) to 2**b - 1 times; bucket 0 is the unseen, the last open.
CONTEXTS = 24
#: Held-out probabilities are counted by steps of 1/8 of a power of two, so their table is bounded however large the corpus.
STEPS, DEEPEST = 8, 60
ROUNDS, TOLERANCE = 100, 1e-7
#: Hashes of what is no word.
END, START = 0x9AE16A3B2F90404F, 0xC949D7C7509E6557


#: Stands for the end among the words of a pack; no word holds a space.
_END = b" "


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        return code


@dataclass
class Tokens:
    """A pack's tokens, document after document: every word, then one end. ``code`` numbers the distinct ones, ``hashes`` are theirs."""

    sizes: np.ndarray
    fold: np.ndarray
    code: np.ndarray
    hashes: np.ndarray

    @staticmethod
    def of(rows: pa.Table) -> Tokens:
        known, sizes, words = _Codes({_END: 0}), [], []
        for text in rows.column("text"):
            own = (text.as_py() or "").encode().lower().split()
            own.append(_END)
            words += own
            sizes.append(len(own))
        code = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        hashes = np.array([END, *map(xxhash.xxh3_64_intdigest, list(known)[1:])], np.uint64)
        fold = np.array([zlib.crc32(("" if i is None else str(i)).encode()) % FOLDS for i in rows.column("doc_id").to_pylist()], np.int64)
        return Tokens(np.array(sizes, np.int64), fold, code, hashes)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct n-grams asked for, words first, and for each token the numbers of its pair, its word and its context among them.

        Every word is followed by another or the end, so a context occurs as often as its word, and the start as often as the end."""
        words, ends = len(self.hashes), np.cumsum(self.sizes)
        context = np.empty_like(self.code)
        context[1:] = self.code[:-1]
        context[ends - self.sizes] = words
        pair, distinct = pd.factorize(context * (words + 1) + self.code)
        before, after = np.append(self.hashes, np.uint64(START))[distinct // (words + 1)], self.hashes[distinct % (words + 1)]
        keys = np.concatenate([mix(self.hashes, 1), mix(mix(before, 3) * np.uint64(0x9E3779B97F4A7C15) + after, 4)])
        context[ends - self.sizes] = self.code[ends - 1]
        return keys, pair + words, self.code, context


def context_bucket(seen: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(seen.astype(np.float64))[1], CONTEXTS - 1)


def _share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.divide(count, total, out=np.zeros(len(count)), where=total > 0)


def _step(p: np.ndarray) -> np.ndarray:
    """The step of a probability, 0 for none."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, 1 + np.minimum(DEEPEST * STEPS - 1, np.round(-np.log2(np.where(p > 0, p, 1)) * STEPS)), 0).astype(np.int64)


def _value(step: np.ndarray) -> np.ndarray:
    return np.where(step > 0, 2.0 ** (-(step - 1) / STEPS), 0.0)


def learn(held_out: list[tuple[int, int, int, int]], floor: float) -> np.ndarray:
    """Weights (pair, word, uniform) of each context bucket by expectation-maximisation.

    ``held_out``: context bucket, step of the pair's estimate, step of the word's, number of tokens. Buckets without tokens lean on
    the word, or share the weights of the nearest fuller bucket below.
    """
    weights = np.tile([0.0, 0.9, 0.1], (CONTEXTS, 1))
    table = np.array(held_out, np.int64).reshape(-1, 4)
    for b in range(CONTEXTS):
        own = table[table[:, 0] == b]
        if not len(own):
            if b > 1:
                weights[b] = weights[b - 1]
            continue
        p = np.stack([_value(own[:, 1]), _value(own[:, 2]), np.full(len(own), floor)], 1)
        n = own[:, 3].astype(float)
        a = np.array([0.4, 0.4, 0.2]) if b else np.array([0.0, 0.6, 0.4])
        for _ in range(ROUNDS):
            part = p * a
            new = (part / part.sum(1, keepdims=True) * n[:, None]).sum(0) / n.sum()
            new = np.maximum(new, 1e-9 * (a > 0))
            new /= new.sum()
            if np.abs(new - a).max() < TOLERANCE:
                break
            a = new
        weights[b] = new
    weights[:, 2] = np.maximum(weights[:, 2], 1e-9)  # no token is impossible
    return weights / weights.sum(1, keepdims=True)


def score_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, all log10.

    Learns from documents outside fold 0 (crc32 of the doc_id as text modulo 10). Tokens are words (ASCII letters in lower case) and
    one end per document. ``base_score`` adds 0.1 to every count of single words; ``score`` is the interpolated model's. Null and
    empty texts are one end. A null doc_id has the fold of the empty text. Repeated rows count each time. Other columns
    are not read; an empty table gives no rows, and without training documents all is uniform.
    """
    require(df, doc_id, text)
    packs = pack(df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")))
    buckets = bucket_count(df)

    def ask_counts(rows: pa.Table):
        t = Tokens.of(rows)
        keys, pair, word, _ = t.grams()
        train = (t.fold != HELD_OUT)[t.doc]
        counts = sum(np.bincount(x[train], minlength=len(keys)) for x in (pair, word))
        # A bucket tells its keys apart by 48 bits; the upper ones have dealt them already.
        rest = keys & np.uint64(0xFFFFFFFFFFFF)
        is_word = np.arange(len(keys)) < len(t.hashes)
        return keys, ((rest >> np.uint64(16)).astype(np.uint32), (rest & np.uint64(0xFFFF)).astype(np.uint16), counts.astype(np.uint32), is_word)

    def add(asked, _packs):
        sizes = [len(a[0]) for a in asked]
        keys = np.concatenate([a[0].astype(np.uint64) << np.uint64(16) | a[1].astype(np.uint64) for a in asked])
        found, number = np.unique(keys, return_inverse=True)
        total = np.bincount(number, np.concatenate([a[2] for a in asked]), len(found)).astype(np.int64)[number]
        return [(x if x.max(initial=0) >= 2**32 else x.astype(np.uint32),) for x in np.split(total, np.cumsum(sizes)[:-1])]

    def tally(asked):
        """Distinct training words of a bucket, and their tokens."""
        keys = np.concatenate([(a[0].astype(np.uint64) << np.uint64(16) | a[1].astype(np.uint64))[a[3] & (a[2] > 0)] for a in asked])
        return np.array([len(np.unique(keys)), sum(int(a[2][a[3]].sum(dtype=np.int64)) for a in asked)], np.int64)

    answers = durable(answer(ask(packs, ask_counts, buckets), add, tally))
    totals = answers.where(F.col("pack") != TALLY)

    # N: training tokens; V: distinct ones.
    stats = vocabulary(answers).first()
    n, v = int(stats["tokens"] or 0), int(stats["words"] or 0)
    floor = 1 / (v + 1)

    def counts_of(t: Tokens, answered):
        keys, pair, word, context = t.grams()
        total = numbers(answered(keys))
        return pair, word, context, total

    def hold_out(_number, rows, answered):
        t = Tokens.of(rows)
        chosen = np.flatnonzero((t.fold == DELETED)[t.doc])
        pair, word, context, total = counts_of(t, answered)
        doc = t.doc[chosen]
        left = []
        for x in (pair, word, context):
            # What the corpus has of it without this document's own.
            own = x[chosen] * np.int64(len(t.sizes)) + doc
            _, number, count = np.unique(own, return_inverse=True, return_counts=True)
            left.append(total[x[chosen]] - count[number])
        rest = n - t.sizes[doc]
        bucket = context_bucket(left[2])
        base = DEEPEST * STEPS + 1
        found = (bucket * base + _step(_share(left[0], left[2]))) * base + _step(_share(left[1], rest))
        found, count = np.unique(found, return_counts=True)
        columns = found // base**2, found // base % base, found % base, count
        return pa.table([pa.array(c.astype(np.int64)) for c in columns], ["context", "pair", "word", "n"])

    held = use(packs, totals, hold_out, "context bigint, pair bigint, word bigint, n bigint")
    table = held.groupBy("context", "pair", "word").agg(F.sum("n").alias("n")).collect()
    weights = learn(sorted(map(tuple, table)), floor)

    def score(_number, rows, answered):
        t = Tokens.of(rows)
        pair, word, context, total = counts_of(t, answered)
        c, seen = total[word], total[context]
        a = weights[context_bucket(seen)]
        p = a[:, 0] * _share(total[pair], seen) + a[:, 1] * (c / n if n else 0.0) + a[:, 2] * floor
        base = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
        at = np.cumsum(t.sizes) - t.sizes
        sums = [np.add.reduceat(x, at) for x in ((c > 0).astype(np.int64), base, np.log10(p))]
        return pa.table([rows.column("doc_id"), pa.array(t.fold == HELD_OUT), pa.array(t.sizes), pa.array(sums[0]), pa.array(np.full(len(at), n, np.int64)),
                         pa.array(sums[1]), pa.array(sums[2])],
                        ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return use(packs, totals, score, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def vocabulary(answers: DataFrame) -> DataFrame:
    """One row: training tokens, and how many distinct ones, from the tallies of the buckets."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([unsqueeze(x.as_py()) for x in batch.column("payload")], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["words", "tokens"])

    parts = answers.where(F.col("pack") == TALLY).select("payload").mapInArrow(unpack, "words bigint, tokens bigint")
    return parts.agg(F.sum("words").alias("words"), F.sum("tokens").alias("tokens"))
