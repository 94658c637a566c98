"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

BPE gives every prefix of a text one encoding, so each prefix has one last token. It is the longest vocabulary token that ends
there and is compatible with the last token of the prefix before it: two neighbours are compatible if encoding
their joined bytes gives just these two. An automaton over the vocabulary lists the tokens ending at each byte, the
compatibility test walks the two merge trees along their touching sides, and back-pointers give the ids. No merge is replayed.
Work is linear in the text, for runs of any length.

The pre-tokenizer's pieces are encoded apart, so each distinct piece is worked out once per task while it is remembered.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.columns import give_back, require

# The pre-tokenizer's pattern, as published with the vocabulary.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

#: Pieces, words and pairs that a task remembers; when full, it starts anew. Longer pieces are not remembered.
REMEMBERED, LONGEST_REMEMBERED = 400_000, 64
#: A rank above that of any merge.
MERGES = 1 << 62


@lru_cache(1)
def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, others for 256 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """A byte-level BPE vocabulary: tokens as bytes, merge trees, ranks and the automaton."""

    def __init__(self, definition: str, remember: int = REMEMBERED):
        self.remember = remember
        read = json.loads(definition)
        model, letters = read["model"], byte_letters()
        if model["type"] != "BPE" or read["pre_tokenizer"]["type"] != "ByteLevel" or read["normalizer"] is not None:
            raise ValueError("a byte-level BPE definition without normalizer is needed")
        self.ids: dict[str, int] = model["vocab"]
        as_bytes = {token: bytes(letters[c] for c in token) for token in self.ids}
        self.special = {t["content"]: t["id"] for t in read["added_tokens"]}
        self.bytes_of = {i: as_bytes[t] for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.split_specials = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        # Nodes of the merge trees are token ids; a byte's children are none, its rank is below all merges.
        self.rank, self.left, self.right = {i: -1 for i in self.ids.values()}, {}, {}
        self.joined: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            i, j, k = self.ids[a], self.ids[b], self.ids[a + b]
            self.joined[i, j] = rank
            if k not in self.left:
                self.rank[k], self.left[k], self.right[k] = rank, i, j
        self.size_of = {i: len(b) for i, b in self.bytes_of.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ids.items():
            raw = as_bytes[token]
            if len(raw) == 1 or (i in self.left and self.compatible(self.left[i], self.right[i], below=self.rank[i])):
                self.automaton.add_word(raw.decode("latin-1"), (len(raw), i))
        self.automaton.make_automaton()

    def compatible(self, a: int, b: int, below: int | None = None) -> bool:
        """Whether encoding the bytes of ``a`` and ``b`` together leaves just these two tokens.

        Only merges across the border can spoil them. Going back in time, the later made of the two border nodes
        is undone; a pair that stood side by side must not have a merge that comes before the next change on either side.
        ``below``: test only merges of a lower rank, for the two halves of a token itself.
        """
        joined, rank, left, right = self.joined.get, self.rank, self.left, self.right
        until = MERGES if below is None else below
        while joined((a, b), MERGES) >= until:
            # The pair (a, b) has stood side by side since the later of the two was made.
            x, y = rank[a], rank[b]
            if x > y:
                until, a = x, right[a]
            elif y >= 0:
                # Equal merges happen from left to right: one to the left of the same rank comes first and spoils b.
                until, b = y + 1, left[b]
            else:
                return True
        return False

    def encode_piece(self, raw: bytes) -> list[int]:
        """Token ids of one pre-tokenizer piece."""
        n = len(raw)
        last, pairs = [-1] * (n + 1), self.pairs
        for end, (size, token) in self.automaton.iter(raw.decode("latin-1")):  # for each end the longest first
            if last[end + 1] < 0:
                start = end + 1 - size
                if start:
                    before = last[start]
                    if before < 0:
                        continue
                    fits = pairs.get((before, token))
                    if fits is None:
                        if len(pairs) >= self.remember:
                            pairs.clear()
                        fits = pairs[before, token] = self.compatible(before, token)
                    if not fits:
                        continue
                last[end + 1] = token
        ids, at = [], n
        while at:
            token = last[at]
            if token < 0:
                raise ValueError(f"the vocabulary lacks byte {raw[at - 1]}")
            ids.append(token)
            at -= self.size_of[token]
        ids.reverse()
        return ids


class Codec:
    """Encodes texts to ids as little-endian 32-bit bytes and back, remembering pieces."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.remember = vocabulary, vocabulary.remember
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.words: dict[str, tuple[bytes, bytes] | None] = {}

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        table = self.vocabulary.bytes_of
        return b"".join([table[i] for i in ids if i in table])

    def _piece(self, piece: str) -> tuple[bytes, bytes]:
        """Ids of a piece, and the bytes these ids decode to."""
        found = self.known.get(piece)
        if found is None:
            ids = array("I", self.vocabulary.encode_piece(piece.encode()))
            found = ids.tobytes(), self.decode_bytes(ids)
            if len(piece) <= LONGEST_REMEMBERED:
                if len(self.known) >= self.remember:
                    self.known.clear()
                self.known[piece] = found
        return found

    def _pieces(self, text: str) -> tuple[bytes, bytes]:
        parts = [self._piece(p) for p in PIECES.findall(text)]
        return b"".join([p[0] for p in parts]), b"".join([p[1] for p in parts])

    def _word(self, word: str) -> tuple[bytes, bytes] | None:
        """What a space and ``word`` encode to; None if a neighbour could change it, as white space at its ends could."""
        if not word or word[0].isspace() or word[-1].isspace():
            return None
        found = self._piece(" " + word) if word.isalpha() else self._pieces(" " + word)
        if len(word) <= LONGEST_REMEMBERED:
            if len(self.words) >= self.remember:
                self.words.clear()
            self.words[word] = found
        return found

    def _plain(self, text: str) -> tuple[bytes, bytes]:
        """A text without special tokens. Between a letter that is no space and a single space before another such, pieces always end."""
        words = text.split(" ")
        parts = [self._pieces(words[0])] if words[0] and not words[0][-1].isspace() else [None]
        known = self.words
        for w in words[1:]:
            parts.append(known.get(w) or self._word(w))
        if None in parts:
            parts = self._joined(words, parts)
        return b"".join([p[0] for p in parts]), b"".join([p[1] for p in parts])

    def _joined(self, words: list[str], parts: list) -> list[tuple[bytes, bytes]]:
        """Words with unsure borders go together with what touches them."""
        out, held, i, n = [], None, 0, len(words)
        while i < n:
            if parts[i] is not None and (i + 1 == n or parts[i + 1] is not None):
                out.append(parts[i])
                i += 1
                continue
            # From a word whose end or follower is unsure on to the next sure border.
            j = i + 1
            while j < n and not (parts[j - 1] is not None and parts[j] is not None):
                j += 1
            held = " ".join(words[i:j])
            out.append(self._pieces(held if i == 0 else " " + held))
            i = j
        return out

    def encode(self, text: str | None) -> tuple[bytes, bytes]:
        """Ids as little-endian unsigned 32-bit integers, and the bytes that they decode to. Null: nothing."""
        if not text:
            return b"", b""
        v = self.vocabulary
        if v.split_specials is None or not any(t in text for t in v.special):
            return self._plain(text)
        parts = []
        for i, part in enumerate(v.split_specials.split(text)):
            if i % 2:
                raw = array("I", [v.special[part]])
                parts.append((raw.tobytes(), self.decode_bytes(raw)))
            elif part:
                parts.append(self._plain(part))
        return b"".join([p[0] for p in parts]), b"".join([p[1] for p in parts])

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, ids without a token are left out."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(2)
def codec_for(definition: str, remember: int = REMEMBERED) -> Codec:
    made = Codec(Vocabulary(definition, remember))
    give_back()
    return made


def encode_documents(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "token_ids", decoded: str = "decoded",
                     remember: int = REMEMBERED) -> DataFrame:
    """``df`` with the token ids of a text column (array<int>) and the text these ids decode to.

    ``tokenizer``: the path of a byte-level BPE definition, read by the driver. Null and empty texts give no ids and an
    empty text. Rows are independent: repeated rows give equal results, an empty table stays empty, other columns stay as
    they are; ``ids`` and ``decoded`` must not be among them. ``remember``: how many pieces, words and pairs a Python worker
    keeps, some 0.8 kB each; it changes speed and memory only.
    """
    require(df, text)
    clash = [n for n in (ids, decoded) if n.lower() in {c.lower() for c in df.columns}]
    if clash:
        raise ValueError(f"columns {clash} exist already; pass other names")
    definition = _definition(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(definition, remember)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                done = [codec.encode(t) for t in part.column(text).to_pylist()]
                flat = pa.Array.from_buffers(pa.int32(), sum(len(d[0]) for d in done) // 4, [None, pa.py_buffer(b"".join([d[0] for d in done]))])
                ends = pa.array([0, *pc.cumulative_sum(pa.array([len(d[0]) // 4 for d in done], pa.int32())).to_pylist()], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.ListArray.from_arrays(ends, flat), pa.array([d[1].decode("utf-8", "replace") for d in done], pa.string())],
                    [*part.schema.names, ids, decoded])
        give_back()

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, `{ids}` array<int>, `{decoded}` string")


def digests(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 (of little-endian 32-bit ids) and decoded_sha256 (of the decoded text in UTF-8).

    Null text counts as empty; null and repeated doc_id pass through; other columns are not read.
    """
    require(df, doc_id, text)
    definition = _definition(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(definition)
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for t in batch.column(1):
                raw, back = codec.encode(t.as_py())
                counts.append(len(raw) // 4)
                of_ids.append(hashlib.sha256(raw).hexdigest())
                of_text.append(hashlib.sha256(back.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _definition(tokenizer: str) -> str:
    with open(tokenizer, encoding="utf-8") as f:
        return f.read()
