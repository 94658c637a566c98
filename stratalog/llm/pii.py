"""Personal data by anchor expansion.

One automaton (Aho-Corasick) finds *anchors* in a single pass over a text: at-signs, plus signs, touching digits, schemes and identifier cues.
Each anchor starts a small parser that expands it to the left and right to the boundaries of what it belongs to, and validates it.
A parser remembers how far it has come, so every character is expanded over once per kind, however many anchors lie there.

Kinds with fixed grammars (`BASE`): email, ip, card, phone, each leftmost and non-overlapping. Added by the method:

* ``address``: a scheme with a person or a machine behind it: ``scheme://`` with user information or a numeric host, ``mailto:``,
  ``sip:``, ``sips:`` and ``xmpp:`` with a user and any host, ``tel:`` with 7 to 15 digits.
* ``account``: a number behind a cue such as IBAN, account or passport, with its own test (IBAN by its check digits).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.llm.columns import require

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "address", "account")
SPANS = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"

# Characters, lengths and cues of the grammars.
DIGITS = frozenset("0123456789")
ALNUM = DIGITS | frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOCAL, LABEL, IN_PHONE = ALNUM | frozenset("._%+-"), ALNUM | frozenset("-"), DIGITS | frozenset(" ().-")
IN_SCHEME, IN_USER, IN_HOST6 = ALNUM | frozenset("+.-"), ALNUM | frozenset("._~%!$&'()*+,;=:-"), frozenset("0123456789abcdefABCDEF:.")
CARD_DIGITS, PHONE_DIGITS, TEL_DIGITS, HIGHEST_PART = (13, 19), (9, 15), (7, 15), 255
USER_SCHEMES = ("mailto:", "sip:", "sips:", "xmpp:")
#: Cue -> what follows it. ``number``: 6 to 20 digits; ``ssn``: 3-2-4 digits; ``mixed``: 6 to 12 letters and digits with a digit.
CUES = {"iban": "iban", "account": "number", "acct": "number", "a/c": "number", "konto": "number", "kontonummer": "number", "compte": "number",
        "cuenta": "number", "ssn": "ssn", "social security": "ssn", "passport": "mixed", "passeport": "mixed", "pasaporte": "mixed", "reisepass": "mixed"}
FILLERS = ("number", "numéro", "número", "nummer", "no", "nr", "num", "n°", "#", ":", "=", ".", "is", "ist")

Span = tuple[str, int, int]


def run_right(text: str, at: int, allowed: frozenset) -> int:
    """Where the run of allowed characters from ``at`` ends."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def run_left(text: str, at: int, allowed: frozenset, least: int) -> int:
    """Where the run of allowed characters that ends before ``at`` begins, not before ``least``."""
    while at > least and text[at - 1] in allowed:
        at -= 1
    return at


def luhn(digits: str) -> bool:
    """Whether the check digit fits: from the right, every second digit doubled, nines cast out."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if k % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v)
    return total % 10 == 0


def iban_fits(compact: str) -> bool:
    """Two letters, two check digits and 11 to 30 letters or digits that give 1 modulo 97."""
    if not (15 <= len(compact) <= 34 and compact[:2].isalpha() and compact[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


class Parsers:
    """The parsers over one text. Each gets an anchor's place and length; ``done`` holds how far each kind has been read."""

    def __init__(self, text: str):
        self.text = text
        self.found: list[Span] = []
        self.done = dict.fromkeys(KINDS, 0)

    def keep(self, kind: str, start: int, end: int) -> None:
        self.found.append((kind, start, end))

    def email(self, at: int, _size: int) -> None:
        """At an at-sign: the local part to the left, two labels or more to the right."""
        start = run_left(self.text, at, LOCAL, self.done["email"])
        end = self.labels(at + 1)
        if start < at and end:
            self.keep("email", start, end)
            self.done["email"] = end

    def labels(self, at: int) -> int:
        """The end of labels joined by single dots, at least two of them; else 0."""
        text, end, count = self.text, run_right(self.text, at, LABEL), 0
        if end == at:
            return 0
        while end + 1 < len(text) and text[end] == "." and text[end + 1] in LABEL:
            end, count = run_right(text, end + 1, LABEL), count + 1
        return end if count else 0

    def ip(self, at: int, _size: int) -> None:
        """At a dot between digits: all numbers joined by single dots here, in fours from the left; parts of 255 at most."""
        if at < self.done["ip"]:
            return
        text, parts = self.text, []
        start = run_left(text, at, DIGITS, self.done["ip"])
        while True:
            end = run_right(text, start, DIGITS)
            parts.append((start, end))
            if not (end + 1 < len(text) and text[end] == "." and text[end + 1] in DIGITS):
                break
            start = end + 1
        for k in range(0, len(parts) - 3, 4):
            if all(self.small(a, b) for a, b in parts[k : k + 4]):
                self.keep("ip", parts[k][0], parts[k + 3][1])
        self.done["ip"] = parts[-1][1]

    def small(self, start: int, end: int) -> bool:
        value = self.text[start:end].lstrip("0")
        return len(value) <= 3 and int(value or "0") <= HIGHEST_PART

    def card(self, at: int, _size: int) -> None:
        """At two digits, touching or with one space or hyphen between: the whole chain of such digits."""
        if at < self.done["card"]:
            return
        text, n, low = self.text, len(self.text), self.done["card"]
        start = at
        while start > low and (text[start - 1] in DIGITS or (text[start - 1] in " -" and start - 1 > low and text[start - 2] in DIGITS)):
            start -= 1
        end = run_right(text, at, DIGITS)
        while end + 1 < n and text[end] in " -" and text[end + 1] in DIGITS:
            end = run_right(text, end + 1, DIGITS)
        self.done["card"] = end
        digits = text[start:end].replace(" ", "").replace("-", "")
        if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
            self.keep("card", start, end)

    def phone(self, at: int, _size: int) -> None:
        """At a plus sign: a digit, then digits and separators up to the last digit."""
        text = self.text
        if at < self.done["phone"] or not (at + 1 < len(text) and text[at + 1] in DIGITS):
            return
        end = run_right(text, at + 2, IN_PHONE)
        while end > at + 3 and text[end - 1] not in DIGITS:
            end -= 1
        if end <= at + 3:
            return
        self.done["phone"] = end
        if PHONE_DIGITS[0] <= sum(c in DIGITS for c in text[at:end]) <= PHONE_DIGITS[1]:
            self.keep("phone", at, end)

    def authority(self, at: int, size: int) -> None:
        """At ``://``: the scheme to the left; user information or a numeric host to the right makes it an address."""
        text, low = self.text, self.done["address"]
        start = run_left(text, at, IN_SCHEME, low)
        while start < at and not text[start].isalpha():
            start += 1
        host = begin = at + size
        user = run_right(text, begin, IN_USER)
        named = user > begin and user < len(text) and text[user] == "@"
        if named:
            host = user + 1
        if host < len(text) and text[host] == "[":
            end = run_right(text, host + 1, IN_HOST6)
            numeric = end < len(text) and text[end] == "]" and text[host + 1 : end].count(":") >= 2
            end = end + 1 if numeric else host
        else:
            end = run_right(text, host, LABEL | {"."})
            end = host + len(text[host:end].rstrip(".-"))
            parts = text[host:end].split(".")
            numeric = len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= HIGHEST_PART for p in parts)
        if start < at and end > host and (named or numeric):
            port = run_right(text, end + 1, DIGITS) if end < len(text) and text[end] == ":" else end
            end = port if port > end + 1 else end
            self.keep("address", start, end)
            self.done["address"] = end

    def user_scheme(self, at: int, size: int) -> None:
        """At ``mailto:`` and the like: a user, an at-sign and a host of any number of labels."""
        text, sign = self.text, run_right(self.text, at + size, LOCAL)
        if at < self.done["address"] or (at and text[at - 1] in IN_SCHEME):
            return
        if sign > at + size and sign < len(text) and text[sign] == "@":
            end = self.labels(sign + 1) or run_right(text, sign + 1, LABEL)
            if end > sign + 1:
                self.keep("address", at, end)
                self.done["address"] = end

    def tel(self, at: int, size: int) -> None:
        """At ``tel:``: digits and separators, with or without a plus sign."""
        text, begin = self.text, at + size
        if at < self.done["address"] or (at and text[at - 1] in IN_SCHEME):
            return
        end = run_right(text, begin + (text[begin : begin + 1] == "+"), IN_PHONE)
        while end > begin and text[end - 1] not in DIGITS:
            end -= 1
        if TEL_DIGITS[0] <= sum(c in DIGITS for c in text[begin:end]) <= TEL_DIGITS[1]:
            self.keep("address", at, end)
            self.done["address"] = end

    def cue(self, at: int, size: int, what: str) -> None:
        """At an identifier cue that is a word by itself: past fillers such as "no." and ":", the identifier it announces."""
        text, begin = self.text, at + size
        if at < self.done["account"] or (at and text[at - 1].isalnum()) or text[begin : begin + 1].isalpha():
            return
        begin = self.past_fillers(begin)
        end = getattr(self, what)(begin)
        if end:
            self.keep("account", begin, end)
            self.done["account"] = end

    def past_fillers(self, at: int) -> int:
        """Past white space and at most four fillers."""
        text = self.text
        for _ in range(4):
            while at < len(text) and text[at] in " \t":
                at += 1
            head = text[at : at + 8].lower()
            filler = next((f for f in FILLERS if head.startswith(f) and not (f.isalpha() and head[len(f) : len(f) + 1].isalnum())), None)
            if filler is None:
                break
            at += len(filler)
        return at

    def grouped(self, at: int, allowed: frozenset, most: int) -> tuple[str, list[int]]:
        """Up to ``most`` allowed characters with single spaces or hyphens between, and where each ends."""
        text, out, ends = self.text, [], []
        while at < len(text) and len(out) <= most:
            if text[at] in allowed:
                out.append(text[at])
                ends.append(at + 1)
            elif not (text[at] in " -" and out and at + 1 < len(text) and text[at + 1] in allowed and text[at - 1] in allowed):
                break
            at += 1
        return "".join(out), ends

    def number(self, at: int) -> int:
        digits, ends = self.grouped(at, DIGITS, 20)
        return ends[-1] if 6 <= len(digits) <= 20 and not self.text[ends[-1] : ends[-1] + 1].isalpha() else 0

    def ssn(self, at: int) -> int:
        part = self.text[at : at + 11]
        whole = len(part) == 11 and part[3] == part[6] and part[3] in "- " and all(c in DIGITS for c in part[:3] + part[4:6] + part[7:])
        return at + 11 if whole and self.text[at + 11 : at + 12] not in DIGITS else 0

    def mixed(self, at: int) -> int:
        end = run_right(self.text, at, ALNUM)
        return end if 6 <= end - at <= 12 and any(c in DIGITS for c in self.text[at:end]) else 0

    def iban(self, at: int) -> int:
        """The longest prefix whose check digits fit: words may follow without a border."""
        compact, ends = self.grouped(at, ALNUM, 34)
        for n in range(min(34, len(compact)), 14, -1):
            if iban_fits(compact[:n].upper()):
                return ends[n - 1]
        return 0


@lru_cache(1)
def anchors() -> ahocorasick.Automaton:
    """All anchors with their parser: (method, length, argument)."""
    made: dict[str, tuple[str, int, str | None]] = {"@": ("email", 1, None), "+": ("phone", 1, None), "://": ("authority", 3, None)}
    for a in sorted(DIGITS):
        for b in sorted(DIGITS):
            made[a + "." + b] = ("ip", 3, None)
            for between in ("", " ", "-"):
                made[a + between + b] = ("card", 2 + len(between), None)
    for scheme, method in [*((s, "user_scheme") for s in USER_SCHEMES), ("tel:", "tel")]:
        for form in {scheme, scheme.upper(), scheme.capitalize()}:
            made[form] = (method, len(form), None)
    for cue, what in CUES.items():
        for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            made[form] = ("cue", len(form), what)
    automaton = ahocorasick.Automaton()
    for word, value in made.items():
        automaton.add_word(word, value)
    automaton.make_automaton()
    return automaton


def find(text: str | None) -> list[Span]:
    """All spans (kind, start, end) of a text in code points, end exclusive, by kind as in KINDS, then start."""
    if not text:
        return []
    parsers = Parsers(text)
    methods: dict[str, Callable] = {m: getattr(parsers, m) for m in ("email", "ip", "card", "phone", "authority", "user_scheme", "tel", "cue")}
    for last, (method, size, argument) in anchors().iter(text):
        at = last + 1 - size
        if argument is None:
            methods[method](at, size)
        else:
            parsers.cue(at, size, argument)
    number = {k: n for n, k in enumerate(KINDS)}
    return sorted(parsers.found, key=lambda s: (number[s[0]], s[1]))


def find_private(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """``df`` with the personal data of a text column: an array of (kind, start, end, value), by kind as in KINDS, then start.

    Places count code points, the end is exclusive. Spans of one kind never overlap, spans of different kinds may. Null and empty
    texts have none. Rows are independent: repeated rows give equal results, an empty table stays empty, other columns stay as they
    are; ``spans`` must not be among them. Work is linear in the text, also for runs without any border.
    """
    require(df, text)
    if spans.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column {spans} exists already; pass another name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                out = []
                for t in part.column(text):
                    own = t.as_py()
                    out.append([{"kind": k, "start": a, "end": b, "value": own[a:b]} for k, a, b in find(own)])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, kind)], [*part.schema.names, spans])

    fields = "".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}, " for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}`{spans}` {SPANS}")


def digest(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def report(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, counts of the base kinds, SHA-256 of their digest, and the digest of all spans. Other columns are not read."""
    require(df, doc_id, text)
    found = find_private(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), spans="found").drop("text")

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s.kind == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("found", lambda s: s.kind.isin(*BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("found")).alias("spans"))


def redacted(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with every span of ``text`` replaced by its kind in brackets; of overlapping spans the earliest, then longest, stands for all. Null stays null."""
    require(df, text)

    def clean(own: str | None) -> str | None:
        spans = sorted(find(own), key=lambda s: (s[1], -s[2]))
        if not spans:
            return own
        parts, at, covered = [], 0, 0
        for kind, start, end in spans:
            if start >= covered:
                parts += [own[at:start], f"[{kind}]"]
            covered = at = max(covered, end)
        return "".join([*parts, own[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(text)
            columns = list(batch.columns)
            columns[place] = pa.array([clean(t.as_py()) for t in batch.column(place)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return df.mapInArrow(run, df.schema)
