"""Language identification by error-correcting output codes.

Every language has a codeword of +1 and -1. One binary classifier per bit (logistic regression on hashed character n-grams)
tells on which side of it a text lies. Decoding sums, for each language, the weighted logistic loss of all bits against its
codeword; the nearest codeword wins, and a text whose two nearest codewords lie close together is flagged.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.llm.columns import require
from stratalog.session import durable

#: n-grams of 1 to 3 letters are hashed to this many features.
FEATURES = 4096
#: Bound of the training sample: labelled rows per language, and of all languages together.
ROWS_PER_LANGUAGE, ROWS = 500, 4000
#: Counts of up to so many labels are sent to all tasks (a few megabytes); of more, they are joined as Spark sees fit.
SENT_LABELS = 50_000
#: Up to so many languages all two-way splits are bits, above so many random ones.
EXHAUSTIVE, RANDOM_BITS = 5, 24
#: A text is ambiguous if its second codeword's loss exceeds the first one's by less than this share of all bits' weight.
MARGIN = 0.1
UNKNOWN = "und"
STEPS, RATE, DECAY = 300, 0.3, 1e-4

_PRIMES = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def features(text: str | None) -> np.ndarray | None:
    """Square roots of n-gram shares of a whole lower-cased text, as a vector of length 1; None without a letter.

    Everything but letters counts as a space, and spaces in a row as one, so n-grams see word borders.
    """
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    is_letter = letters()[points]
    if not is_letter.any():
        return None
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first space after a word
    c = np.where(is_letter, points, np.uint32(32))[keep]
    c = np.concatenate([np.array([32], np.uint32), c])
    one = c[c != 32] * _PRIMES[0]
    two = c[:-1] * _PRIMES[1] ^ c[1:] * _PRIMES[0] + np.uint32(1)
    three = (c[:-2] * _PRIMES[2] ^ c[1:-1] * _PRIMES[1]) * _PRIMES[1] ^ c[2:] * _PRIMES[0] + np.uint32(2)
    hashed = np.concatenate([one, two, three])
    hashed = (hashed ^ (hashed >> np.uint32(15))) * _PRIMES[0]
    counts = np.bincount(hashed >> np.uint32(32 - 12), minlength=FEATURES)
    return np.sqrt(counts / len(hashed)).astype(np.float32)


def codewords(languages: int, seed: int = 0) -> np.ndarray:
    """One row of +1 and -1 per language. All splits in two for few languages, else the best spread of random ones."""
    if languages < 2:
        return np.zeros((languages, 0), np.float32)
    if languages <= EXHAUSTIVE:
        bits = [(1, *b) for b in itertools.product((1, -1), repeat=languages - 1) if -1 in b]
        return np.array(bits, np.float32).T
    drawn, best, found = np.random.default_rng(seed), -1, None
    for _ in range(200):
        code = drawn.choice(np.array([1, -1], np.float32), (languages, RANDOM_BITS + languages // 8))
        code = code[:, np.abs(code.sum(0)) < languages]
        apart = code.shape[1] - np.abs(code @ code.T + 0)
        np.fill_diagonal(apart, code.shape[1])
        if apart.min() > best:
            best, found = apart.min(), code
    return found


@dataclass(frozen=True)
class Model:
    """What is learned: languages, their codewords, the bits' classifiers and the weights of the bits."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For feature rows: the language's number, a score (0 to 1) and whether it is ambiguous."""
        if len(self.languages) == 1:
            return np.zeros(len(x), int), np.ones(len(x)), np.zeros(len(x), bool)
        f = x @ self.weights + self.bias
        loss = np.logaddexp(0, -f[:, None, :] * self.code[None]) @ self.trust
        order = np.argsort(loss, axis=1, kind="stable")
        first, second = (np.take_along_axis(loss, order[:, k : k + 1], 1)[:, 0] for k in (0, 1))
        likely = np.exp(first[:, None] - loss)
        return order[:, 0], 1 / likely.sum(1), second - first < MARGIN * self.trust.sum()


def train(x: np.ndarray, y: np.ndarray, languages: list[str]) -> Model:
    """Logistic regression of every bit, by gradient steps over all sample rows; languages weigh alike."""
    code = codewords(len(languages))
    target = code[y] if len(y) else np.zeros((0, code.shape[1]), np.float32)
    w, b = np.zeros((FEATURES, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    share = (1 / (np.bincount(y, minlength=len(languages))[y] * len(languages))).astype(np.float32)[:, None] if len(y) else None
    momentum_w, momentum_b = np.zeros_like(w), np.zeros_like(b)
    for _ in range(STEPS if code.shape[1] else 0):
        margin = target * (x @ w + b)
        pull = target * share / (1 + np.exp(np.clip(margin, -30, 30)))
        momentum_w = 0.9 * momentum_w + x.T @ pull - DECAY * w
        momentum_b = 0.9 * momentum_b + pull.sum(0)
        w, b = w + RATE * 10 * momentum_w, b + RATE * momentum_b
    wrong = ((target * (x @ w + b) <= 0) * share).sum(0) if len(y) else np.zeros(code.shape[1])
    return Model(languages, code, w, b, np.maximum(0.05, 1 - 2 * wrong).astype(np.float32))


def sample(df: DataFrame, label: str, key: str, per_label: int = ROWS_PER_LANGUAGE, in_all: int = ROWS) -> DataFrame:
    """At most ``per_label`` distinct keys of each label, and ``in_all`` together, chosen by a hash of ``key``: the same in every run.

    Returns label, key. Keys of many rows count once; null keys and labels are not chosen. How many keys a label has (estimated) gives the share of the
    hash range in which its sample lies with near certainty, so only some three times the sample is made distinct and ranked, however large the table.
    """
    known = df.select(F.col(label).alias("label"), F.col(key).alias("key")).where(F.col("label").isNotNull() & F.col("key").isNotNull())
    sizes = durable(known.groupBy("label").agg(F.approx_count_distinct("key", 0.05).alias("keys")))
    labels = sizes.count()
    most = max(1, min(per_label, in_all // max(1, labels)))
    # Sent to the rows, or all rows of a label would meet in one task.
    sizes = F.broadcast(sizes) if labels <= SENT_LABELS else sizes
    hashed = known.withColumn("hash", F.xxhash64(F.lit(42), F.col("key")))
    # A row's place in the hash range, 0 to 1, against twice the wanted share and some more for small samples and the estimate's error.
    place = F.col("hash") / F.lit(2.0**64) + 0.5
    passed = hashed.join(sizes, "label").where(place * F.col("keys") <= 2 * most + 50).select("label", "key", "hash").distinct()
    order = ["hash", "key"]
    rank = F.row_number().over(Window.partitionBy("label").orderBy(*order))
    return passed.withColumn("rank", rank).where(F.col("rank") <= most).orderBy(*order, "label").limit(in_all).select("label", "key")


def fit(df: DataFrame, text: str, label: str, key: str) -> Model:
    """Learn from a bounded sample (`sample`) of rows with a label. The driver gets one feature vector for each key and label chosen.

    Rows that repeat a key and label count once, by their least vector; texts without a letter teach nothing.
    """
    rows = df.select(F.col(text).alias("text"), F.col(label).cast("string").alias("label"), F.col(key).alias("key"))
    chosen = {(r["label"], r["key"]) for r in sample(rows, "label", "key").collect()}
    near = rows.where(F.col("label").isNotNull() & F.col("key").isin(sorted({k for _, k in chosen})))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, kind = {}, None
        for batch in batches:
            kind = batch.schema.field("key").type
            for t, *at in zip(*(c.to_pylist() for c in batch.columns)):
                x = features(t) if tuple(at) in chosen else None
                if x is not None:
                    least[tuple(at)] = min(least.get(tuple(at), b"\xff"), x.astype(np.float16).tobytes())
        if least:
            yield pa.RecordBatch.from_arrays([pa.array([l for l, _ in least], pa.string()), pa.array([k for _, k in least], kind), pa.array(list(least.values()), pa.binary())], ["label", "key", "x"])

    found = near.mapInArrow(run, f"label string, key {near.schema['key'].dataType.simpleString()}, x binary")
    got = sorted((r["label"], bytes(r["x"])) for r in found.groupBy("label", "key").agg(F.min("x").alias("x")).collect())
    languages = sorted({l for l, _ in got})
    x = np.array([np.frombuffer(v, np.float16) for _, v in got], np.float32).reshape(len(got), FEATURES)
    return train(x, np.array([languages.index(l) for l, _ in got], int), languages)


def any_language() -> Model:
    """A model of one unnamed language, which takes every text with a letter."""
    return train(np.zeros((0, FEATURES), np.float32), np.zeros(0, int), [""])


def predict(df: DataFrame, model: Model, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """``df`` with the predicted language, its score (0 to 1) and a flag for two near codewords.

    A text that is null or has no letter gets `und`, score 0, not ambiguous; so does every text if nothing was learned.
    Other columns stay; ``names`` must not be among them. Rows are independent of each other.
    """
    require(df, text)
    clash = [n for n in names if n.lower() in {c.lower() for c in df.columns}]
    if clash:
        raise ValueError(f"columns {clash} exist already; pass other names")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                lang, score, ambiguous = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows), np.zeros(part.num_rows, bool)
                vectors = [features(t.as_py()) for t in part.column(text)]
                at = [i for i, v in enumerate(vectors) if v is not None]
                if at and model.languages:
                    which, score[at], ambiguous[at] = model.decode(np.array([vectors[i] for i in at]))
                    for i, k in zip(at, which):
                        lang[i] = model.languages[k]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ambiguous, pa.bool_())],
                                                 [*part.schema.names, *names])

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, `{names[0]}` string, `{names[1]}` double, `{names[2]}` boolean")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as an empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds).cast("int")
