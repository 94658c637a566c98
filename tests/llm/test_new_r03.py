"""Personal data, collocations and whitening against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import sys
from collections import Counter
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).resolve().parent))

from stratalog.llm import collocations, pii, queries, whitening  # noqa: E402


def stored(folder, **tables):
    for name, df in tables.items():
        df.write.parquet(str(folder / f"{name}.parquet"))
    return str(folder)


# --- personal data ---------------------------------------------------------------------------------------------------------

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_luhn(digits: str) -> bool:
    values = [int(d) for d in digits][::-1]
    return sum(values[::2] + [sum(divmod(2 * v, 10)) for v in values[1::2]]) % 10 == 0


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern in PATTERNS.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            fits = {"email": True, "phone": 9 <= len(digits) <= 15, "card": 13 <= len(digits) <= 19 and plain_luhn(digits),
                    "ip": kind == "ip" and all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m.group().split("."))}[kind]
            if fits:
                out.append((kind, m.start(), m.end()))
    return out


def base(text):
    return [s for s in pii.find(text) if s[0] in pii.BASE]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="0123456789.+-@ ()aZ%_\né٣", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert base(text) == plain_spans(text)


def test_awkward_base_spans():
    cards = ["4111111111111111", "4111 1111-1111 1111", "4111  1111", "0" * 13, "0" * 20, "5500-0000-0000-0004 7"]
    numbers = ["1.2.3.4.5.6.7.8.9", "001.002.003.004", "256.1.1.1", "1.2.3.4.", "1..2.3.4.5", "9" * 5000 + ".1.1.1", "1.2.3.4.5.6.7"]
    phones = ["+1 (017) 555-7713", "+1", "+12", "+123456789", "+12345678", "+1 2 3 4 5 6 7 8 9 ).", "++491234567890", "+1)))))", "+" + "1" * 16]
    mails = ["a@b.c@d.e", "a@b@c.d", "@b.c", "a@b..c", "a@b.c..d", "x" * 3000 + "@" + "y" * 3000 + ".z", "a.b+c%d_e-f@g-h.i-j.k", "a@@b.c", "éa@b.cé"]
    r = random.Random(0)
    texts = cards + numbers + phones + mails + [" ".join(r.sample(cards + numbers + phones + mails, 4)) for _ in range(300)] + ["".join(r.sample(cards + numbers + phones + mails, 3)) for _ in range(300)]
    for text in texts:
        assert base(text) == plain_spans(text), text
    long = "\n".join(["1.2.3.4" * 400, "+1" * 400, "a@" * 400, "1 " * 400])  # apart, for the patterns are quadratic in a local part
    assert base(long) == plain_spans(long)


def test_added_spans():
    def values(text):
        return [(k, text[a:b]) for k, a, b in pii.find(text) if k not in pii.BASE]

    assert values("see ftp://joe:secret@files.example:21/x and https://example.com/clean") == [("address", "ftp://joe:secret@files.example:21")]
    assert values("http://10.0.0.1:8080/a, http://[2001:db8::1]/ http://300.1.1.1/") == [("address", "http://10.0.0.1:8080"), ("address", "http://[2001:db8::1]")]
    assert values("MAILTO:root@localhost Tel:+49-30-1234567 mailto:nobody sip:a@b.c") == [
        ("address", "MAILTO:root@localhost"), ("address", "Tel:+49-30-1234567"), ("address", "sip:a@b.c")]
    assert values("IBAN: DE89 3704 0044 0532 0130 00 and iban DE88370400440532013000") == [("account", "DE89 3704 0044 0532 0130 00")]
    assert values("Account no. 1234-5678-90, account of 12, Konto 99 888 777; subaccount 12345678") == [("account", "1234-5678-90"), ("account", "99 888 777")]
    assert values("SSN 078-05-1120 ssn 078-05-11201 Passport No: X1234567 passport holder") == [("account", "078-05-1120"), ("account", "X1234567")]
    assert values("the account is closed, a card, http://, ://x@y, mailto:, tel: 12, token = 0a1b2c3d4e5f6a7b8c9d") == []


def test_query_of_private_data(spark, tmp_path):
    texts = [(1, "ä a.b@c.de und 97.51.17.173, +1 (017) 555-7713"), (2, None), (3, ""), (None, "4111111111111111"), (1, "mailto:x@localhost"), (5, "clean text. 12 3.4")]
    rows = spark.createDataFrame([(*t, "z") for t in texts], "doc_id bigint, text string, spans string")
    got = queries.QUERIES["op11_pii"](spark, stored(tmp_path, documents=rows)).collect()

    def want(i, t):
        spans = plain_spans(t or "")
        count = Counter(s[0] for s in spans)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        every = ",".join(f"{k}:{a}:{b}" for k, a, b in pii.find(t))
        return (i, *[count[k] for k in pii.BASE], hashlib.sha256(joined.encode()).hexdigest(), every)

    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got), key=key) == sorted((want(*t) for t in texts), key=key)
    assert any(r["spans"] == "address:0:18" for r in got)
    with pytest.raises(ValueError):
        pii.find_private(rows)
    assert pii.report(rows.limit(0)).count() == 0
    clean = {r["text"] for r in pii.redacted(rows).collect()}
    assert clean == {"ä [email] und [ip], [phone]", None, "", "[card]", "[address]", "clean text. 12 3.4"}
    full = pii.find_private(rows.drop("spans")).collect()
    assert all(s["value"] == r["text"][s["start"] : s["end"]] for r in full for s in r["spans"])


# --- collocations ----------------------------------------------------------------------------------------------------------

def plain_collocations(docs, least, top, longest=5):
    """Rows by the shortest route: count everything."""
    count, totals = Counter(), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                for k in range(len(words) - size + 1):
                    count[lang, tuple(words[k : k + size])] += 1
    found = {}
    for (lang, words), a in count.items():
        if len(words) > 1 and a >= least:
            cuts = [(1000 * a * totals[lang] // (count[lang, words[:k]] * count[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            found[lang, words] = (a, count[lang, words[:k]], count[lang, words[k:]], totals[lang], score)
    inside = set()
    for (lang, words), (a, *_) in found.items():
        for size in range(2, len(words)):
            for k in range(len(words) - size + 1):
                if 100 * a >= 100 * found[lang, words[k : k + size]][0]:
                    inside.add((lang, words[k : k + size]))
    rows = []
    for lang in totals:
        own = [(" ".join(w), v) for (g, w), v in found.items() if g == lang and (g, w) not in inside]
        own.sort(key=lambda x: (-x[1][4], -x[1][0], x[0].encode()))
        rows += [(lang, n + 1, p, *v) for n, (p, v) in enumerate(own[:top])]
    return sorted(rows)


@pytest.mark.parametrize("seed,shards,pack", [(0, 1, 300), (1, 3, 200)])
def test_collocations_equal_plain_counts(spark, monkeypatch, seed, shards, pack):
    monkeypatch.setattr(collocations, "PACK_BYTES", pack)
    r = random.Random(seed)
    words = [f"W{k}" for k in range(12)] + ["é", "İ", "a\x00b", " ", "x "]
    docs = []
    for i in range(160):
        own = [r.choice(words) for _ in range(r.randrange(30))]
        own[r.randrange(len(own) + 1) : 0] = r.choice([["new", "york", "city"], ["one", "two", "one", "two", "one"], ["A", "b", "c", "d", "e", "f"]])
        text = "".join(w + r.choice([" ", "  ", "\t", ". ", "\n", " ,", "\x0b"] if r.random() < 0.3 else [" "]) for w in own)
        docs.append((text, r.choice(["en", "en", "en", None, "und", "fr\t"])))
    docs += [(None, "en"), ("", "de"), (" .,\n", "de"), ("\U0001F600 " * 30, "xx"), ("a " * 400, "en")]
    df = spark.createDataFrame([(t, g, 1) for t, g in docs], "text string, lang string, n int").repartition(5)
    least, top = (8, 5) if seed else (3, 10**6)
    got = collocations.collocations(df, least=least, top=top, shards=shards)
    assert sorted(tuple(x) for x in got.collect()) == plain_collocations(docs, least, top)


def test_full_filter_changes_no_count(spark, monkeypatch):
    """Chance hits of the filter activate phrases early and count them whole."""
    monkeypatch.setattr(collocations, "filter_bits", lambda words, least: 64)
    monkeypatch.setattr(collocations, "PACK_BYTES", 200)
    r = random.Random(9)
    docs = [(" ".join(r.choice([f"w{k}" for k in range(40)]) for _ in range(25)), "en") for _ in range(80)]
    df = spark.createDataFrame(docs, "text string, lang string").repartition(6)
    assert sorted(tuple(x) for x in collocations.collocations(df, least=4, top=500).collect()) == plain_collocations(docs, 4, 500)


def test_scores_beyond_64_bits(spark):
    counts = spark.createDataFrame([("en", "a b", 2, 10**12), ("en", "a", 1, 2 * 10**12), ("en", "b", 1, 3 * 10**12)], "lang string, phrase string, size int, c bigint")
    totals = spark.createDataFrame([("en", 7 * 10**15 + 3)], "lang string, n bigint")
    row = collocations.scored(counts, totals).first()
    assert row["score"] == 1000 * 10**12 * (7 * 10**15 + 3) // (6 * 10**24)


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string"), least=1).count() == 0


# --- whitening -------------------------------------------------------------------------------------------------------------

def test_cross_products_are_exact():
    r = np.random.default_rng(0)
    for rows, dims, low, high in ((1, 3, -5, 5), (64, 4, 0, 2), (65, 5, -(10**6), 10**6), (200, 3, 99_000, 101_000), (7, 2, 2**50, 2**50 + 3), (9, 1, 4, 5)):
        x = r.integers(low, high, (rows, dims))
        want = [[sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j])) for j in range(dims)] for i in range(dims)]
        assert whitening.cross_products(x) == want


def plain_integers(rows):
    """x of the vectors that remain, by vec_id."""
    out = []
    for i, v in rows:
        if v and all(c is not None and np.isfinite(c) for c in v):
            out.append((i, [int(Fraction(float(c)) * 1024 // 1) + 100_000 for c in v]))
    return out


def test_whitening_equals_the_plain_version(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(whitening, "SLICE", 70)
    r = np.random.default_rng(3)
    base = r.normal(size=(400, 10)) @ r.normal(size=(10, 10)) * 0.1
    vectors = [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(base)]
    odd = [(900, None), (901, [None] * 10), (902, [float("nan")] + [0.0] * 9), (903, [float("inf")] * 10), (904, []), (905, [1.0, 2.0]), (None, vectors[0][1]), (0, vectors[5][1])]
    df = spark.createDataFrame([(*v, "x") for v in vectors + odd], "vec_id bigint, embedding array<float>, component string").repartition(4)
    got = queries.QUERIES["op13_whitening"](spark, stored(tmp_path, embeddings=df)).collect()
    kept = [v for v in plain_integers(vectors + odd) if len(v[1]) == 10]
    n, x = len(kept), [v for _, v in kept]
    sums = [sum(col) for col in zip(*x)]
    assert {g["n"] for g in got} == {n} and len(got) == 8 * n
    want = Counter((i, sum((n * c - s) ** 2 for c, s in zip(v, sums))) for i, v in kept)
    assert Counter((g["vec_id"], g["deviation"]) for g in got if g["component"] == 3) == want
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums)] for v in x])
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:8], u[:, ::-1][:, :8]
    plain = centred @ u / np.sqrt(e)
    for k in range(8):
        own = sorted((g["deviation"], g["whitened"]) for g in got if g["component"] == k + 1)
        ref = sorted((sum((n * c - s) ** 2 for c, s in zip(v, sums)), w) for v, w in zip(x, plain[:, k]))
        a, b = np.array([w for _, w in own]), np.array([w for _, w in ref])
        assert np.allclose(a, b, atol=1e-6) or np.allclose(a, -b, atol=1e-6)
        assert [g["explained"] for g in got if g["component"] == k + 1] == pytest.approx([e[k] / np.trace(cov)] * n, rel=1e-9)
    assert {g["identity_error"] for g in got}.pop() < 1e-9


def test_whitening_of_edge_tables(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    same = whitening.whiten(spark.createDataFrame([(1, [0.5, -0.5]), (2, [0.5, -0.5])], schema)).collect()
    assert len(same) == 4 and all(r["whitened"] == 0 and r["explained"] == 0 and r["deviation"] == 0 for r in same)
    line = whitening.whiten(spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.5, 0.5]), (3, [1.0, 1.0])], schema)).collect()
    assert sorted(round(abs(r["whitened"]), 6) for r in line if r["component"] == 1) == [0, 1.224745, 1.224745]
    assert {r["whitened"] for r in line if r["component"] == 2} == {0.0}


def test_deviations_beyond_64_bits():
    model = whitening.Whitening(10**9, (3 * 10**14, 0), np.ones(2), np.ones(2), np.eye(2))
    x = np.array([[99_000, 10**6], [10**6, 0]])
    assert model.deviations(x) == [(10**9 * 99_000 - 3 * 10**14) ** 2 + 10**30, (10**15 - 3 * 10**14) ** 2]
