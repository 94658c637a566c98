"""Plain versions of the operators for small inputs: what the results must be, by the shortest route."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import xxhash

LAST = float("inf")


def by_id(docs):
    """Rows (doc_id, text, ...) by doc_id, null last, ties as they stand."""
    return sorted(docs, key=lambda d: LAST if d[0] is None else d[0])


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def covered(sequences: list[list], window: int) -> list[list[bool]]:
    """Per sequence, which elements a window covers that also starts earlier."""
    seen, out = {}, []
    for n, s in enumerate(sequences):
        for k in range(len(s) - window + 1):
            seen.setdefault(tuple(s[k : k + window]), (n, k))
    for n, s in enumerate(sequences):
        gone = [False] * len(s)
        for k in range(len(s) - window + 1):
            if seen[tuple(s[k : k + window])] != (n, k):
                gone[k : k + window] = [True] * window
        out.append(gone)
    return out


def dedup_lines(docs, min_lines: int, min_words: int | None = None) -> list[tuple]:
    """(doc_id, text, lines removed), in order. ``min_words``: later copies of single lines of so many words, or that are all of a document, go too."""
    docs = by_id(docs)
    split = [d[1].split("\n") if d[1] else [] for d in docs]
    filled = [[i for i, x in enumerate(s) if x.strip()] for s in split]
    marks = covered([[s[i] for i in f] for s, f in zip(split, filled)], min_lines)
    out, seen = [], set()
    for d, s, f, m in zip(docs, split, filled, marks):
        if min_words is not None:
            for n, i in enumerate(f):
                m[n] = m[n] or s[i] in seen and (len(f) == 1 or len(s[i].encode().split()) >= min_words)
                seen.add(s[i])
        drop = {i for i, g in zip(f, m) if g}
        text = d[1] if not drop else "" if all(m) else "\n".join(x for i, x in enumerate(s) if i not in drop)
        out.append((d[0], text, len(drop)))
    return out


def dedup_words(docs, window: int) -> list[tuple]:
    """(doc_id, words, words removed, kept text), in order."""
    docs = by_id(docs)
    words = [(d[1] or "").encode().split() for d in docs]
    marks = covered(words, window)
    return [(d[0], len(w), sum(m), b" ".join(x for x, g in zip(w, m) if not g).decode()) for d, w, m in zip(docs, words, marks)]


def simhash(text) -> int:
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < 3 else [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(fps: list[int], radius: int = 2) -> list[int]:
    """For each fingerprint the least place in its component."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def near_duplicates(docs) -> list[tuple]:
    """(doc_id, fingerprint, component_id), in order of doc_id; doc_ids distinct, nulls last."""
    docs = by_id(docs)
    fps = [simhash(d[1]) for d in docs]
    return [(d[0], f"{f:016x}", docs[r][0]) for d, f, r in zip(docs, fps, linked(fps))]


def leaks(docs, items, similar: float = 0.8) -> dict:
    """(doc_id, item_id) -> (similarity, start)."""
    found = {}
    for item_id, item in items:
        w = (item or "").lower().encode().split()
        if not w:
            continue
        size = min(5, len(w))
        want = Counter(tuple(w[k : k + size]) for k in range(len(w) - size + 1))
        for doc in docs:
            own = (doc[1] or "").lower().encode().split()
            n = min(len(w), len(own))
            for start in range(len(own) - n + 1 if n >= size else 0):
                have = Counter(tuple(own[k : k + size]) for k in range(start, start + n - size + 1))
                value = 2 * (have & want).total() / (have.total() + want.total())
                if value >= similar and value > found.get((doc[0], item_id), (0,))[0]:
                    found[doc[0], item_id] = value, start
    return found


def base_scores(docs) -> dict:
    """doc_id -> (held out, tokens, known, training tokens, base score); doc_ids distinct."""
    tokens = {d[0]: [*(d[1] or "").encode().lower().split(), None] for d in docs}
    fold = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 for i in tokens}
    counts = Counter(t for i, own in tokens.items() if fold[i] for t in own)
    n, v = counts.total(), len(counts)
    return {i: (fold[i] == 0, len(own), sum(counts[t] > 0 for t in own), n, sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own))
            for i, own in tokens.items()}


def fingerprint_inputs(docs) -> list[tuple]:
    """(doc_id, code points, text, edited text, next text), descending doc_id (distinct, null last)."""
    docs = by_id(docs)
    order = [d for d in reversed(docs) if d[0] is not None] + [d for d in docs if d[0] is None]
    out = []
    for k, d in enumerate(order):
        text, following = d[1] or "", order[(k + 1) % len(order)][1] or ""
        third = len(text) // 3
        out.append((d[0], len(text), text, text[: len(text) - third] + following[:third], following))
    return out
