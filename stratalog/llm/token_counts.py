"""Token counts of a unigram tokenizer: a Viterbi search that carries best score and piece count only.

An Aho-Corasick automaton lists the vocabulary pieces that end at each character; the search keeps, for each prefix, the
best sum of scores and how many ids its path gives. No pieces are stored and nothing is traced back.

Tie rules, those of the tokenizers library's Unigram model: a later candidate must be strictly better, and candidates
come by ascending start, so of equal sums the longest last piece stays. A character that is no piece by itself may be
unknown, at the least score of the vocabulary minus 10; with byte fallback it counts once per UTF-8 byte, else unknown
neighbours count as one. Spaces become U+2581, one is put in front, and each word is searched apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.columns import require

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Words that a task remembers; when full, it starts anew. Longer words are not remembered.
REMEMBERED, LONGEST_REMEMBERED = 400_000, 64


def read_vocabulary(model: str) -> list[tuple[str, float]]:
    """Pieces and scores, by id, of a sentencepiece model file, read by the driver."""
    from sentencepiece import SentencePieceProcessor

    read = SentencePieceProcessor(model_file=model)
    return [(read.id_to_piece(i), read.get_score(i)) for i in range(read.get_piece_size())]


class Counter:
    """Counts unigram ids of texts."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        pieces = {p for p, _ in vocabulary}
        self.byte_fallback = byte_fallback and all(f"<0x{b:02X}>" in pieces for b in range(256))
        self.known: dict[str, int] = {}

    def search(self, text: str) -> tuple[float, int]:
        """Best score and number of ids of one word."""
        n = len(text)
        best, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        matches = self.automaton.iter(text)
        end, found = next(matches, (n, None))
        for at in range(1, n + 1):
            top, ids, single = None, 0, False
            while end == at - 1:
                size, score = found
                candidate = score + best[at - size]
                single = single or size == 1
                if top is None or candidate > top:
                    top, ids = candidate, count[at - size] + 1
                end, found = next(matches, (n, None))
            if not single:
                candidate = self.unknown + best[at - 1]
                if top is None or candidate > top:
                    more = len(text[at - 1].encode()) if self.byte_fallback else int(not unknown[at - 1])
                    top, ids, unknown[at] = candidate, count[at - 1] + more, True
            best[at], count[at] = top, ids
        return best[n], count[n]

    def _word(self, word: str) -> int:
        found = self.known.get(word)
        if found is None:
            found = self.search(SPACE + word)[1]
            if len(word) <= LONGEST_REMEMBERED:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[word] = found
        return found

    def count(self, text: str | None) -> int:
        """Number of ids of a text; null and empty give 0."""
        if not text:
            return 0
        words = text.replace(" ", SPACE).split(SPACE)
        if words[0] == "":  # it begins with a space: none is put in front
            del words[0]
        known, word = self.known, self._word
        return sum([known.get(w) or word(w) for w in words])


@lru_cache(2)
def counter_for(vocabulary: tuple, byte_fallback: bool) -> Counter:
    return Counter(list(vocabulary), byte_fallback)


def count_tokens(df: DataFrame, vocabulary: list[tuple[str, float]], doc_id: str = "doc_id", text: str = "text", byte_fallback: bool = True) -> DataFrame:
    """Per document: doc_id, n_tokens, n_words (between single spaces), n_bytes (UTF-8).

    Null and empty texts have 0 of each. Null and repeated doc_id pass through; other columns are not read; an empty
    table gives no rows. ``vocabulary``: pieces and scores by id (`read_vocabulary`), fixed by the tokenizer.
    """
    require(df, doc_id, text)
    fixed = tuple(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_for(fixed, byte_fallback)
        for batch in batches:
            counts, words, sizes = [], [], []
            for t in batch.column(1):
                t = t.as_py() or ""
                counts.append(counter.count(t))
                words.append(t.count(" ") + 1 if t else 0)
                sizes.append(len(t.encode()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (counts, words, sizes))],
                                             ["doc_id", "n_tokens", "n_words", "n_bytes"])

    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, n_words bigint, n_bytes bigint")
