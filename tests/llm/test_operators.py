from __future__ import annotations

import os
import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402

from stratalog.llm import (  # noqa: E402
    bpe, decontaminate, exchange, fingerprints, language, line_dedup, lm, near_dup, queries, sharding, substring_dedup, token_counts,
)

SF = "/root/testdata/sf0.001"
#: Columns that the operators use inside; they must not mind them.
CLASHING = dict(pack="p", payload="q", bucket=1, words="w", range=7, guest=2, fp=3, fold=4, hashes="h", root=5, node=6, slot_number=8)


@pytest.fixture(autouse=True)
def small_packs(monkeypatch):
    """Few rows in a pack, so that even small tables have many."""
    monkeypatch.setattr(exchange.pack, "__defaults__", (600,))


def table(spark, rows, parts=3):
    """Documents with clashing extra columns, in a few partitions."""
    extra = [F.lit(v).alias(k) for k, v in CLASHING.items()]
    df = spark.createDataFrame([(d[0], d[1]) for d in rows], "doc_id bigint, text string")
    return df.repartitionByRange(parts, "doc_id").select("*", *extra)


ODD = [(7, None), (3, ""), (None, "one two three"), (5, " \n\t "), (9, "word"), (1, "é中🙂 x" * 3), (4, "a b c d e f g h " * 40), (2, "a b c d e f g h " * 40)]


def lines_corpus(seed, docs=40):
    r = random.Random(seed)
    return [(i, "\n".join(r.choice(["a", "b", "c d", "", "  ", f"u{r.randrange(50)}"]) for _ in range(r.randrange(12)))) for i in range(docs)] + [(100, None), (None, "a\nb"), (101, "p\nq\n\nr\ns\nt\nu\nv"), (102, "z\np\nq\nr\n \ns\nt\nu")]


@pytest.mark.parametrize("min_lines", [1, 2, 3, 5])
def test_line_dedup(spark, min_lines):
    docs = lines_corpus(min_lines)
    got = line_dedup.dedup_lines(table(spark, docs), min_lines=min_lines)
    assert got.columns == ["doc_id", "text", *CLASHING, "n_lines_removed"]
    want = brute.dedup_lines(docs, min_lines)
    rows = {r["doc_id"]: (r["text"], r["n_lines_removed"]) for r in got.collect()}
    assert rows == {i: (t, n) for i, t, n in want}
    assert any(n for _, _, n in want)
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(got)


def test_line_dedup_of_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "x\ny\nz")] * 3, "doc_id bigint, text string").coalesce(1)
    assert sorted(r["text"] for r in line_dedup.dedup_lines(df).collect()) == ["", "", "x\ny\nz"]
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_ranks_are_places_in_the_sorted_order():
    first, second = np.array([5, 5, 5, 9, 9], np.int64), np.array([3, 1, 3, 2, 2], np.int64)
    (rank,) = line_dedup.rank_pairs([(first, second, np.array([1, 2, 1, 1, 1]))], [0])[0]
    assert rank.tolist() == [7, 5, 7, 9, 9]
    assert [line_dedup.doublings(n) for n in (1, 2, 3, 4, 7)] == [[], [1], [1, 1], [1, 2], [1, 2, 3]]


@pytest.mark.parametrize("window,rounds,letters", [(20, 3, 2), (6, 2, 3), (6, 3, 8), (4, 1, 2), (1, 0, 30)])
def test_substring_dedup(spark, window, rounds, letters):
    r = random.Random(window * 100 + letters)
    phrase = [f"w{r.randrange(40)}" for _ in range(60)]

    def text():
        own = [f"w{r.randrange(letters)}" for _ in range(r.randrange(30))]
        at = r.randrange(40)
        return " ".join(own + phrase[at : at + r.randrange(25)] + own[:3] + ["same"] * r.randrange(12))

    docs = [(i, text()) for i in range(40)] + ODD[2:]
    docs = list({d[0]: d for d in docs}.values())
    got = substring_dedup.dedup_words(table(spark, docs), window=window, rounds=rounds).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute.dedup_words(docs, window), key=str)
    assert substring_dedup.dedup_words(table(spark, docs).limit(0)).count() == 0


def test_symbols_are_consistent_within_their_reach():
    r = random.Random(3)
    body = np.array([r.randrange(6) for _ in range(60)], np.uint64)
    names = []
    for seed in (1, 2):
        edge = np.array([random.Random(seed).randrange(6) for _ in range(30)], np.uint64)
        codes = np.concatenate([edge, body, edge[::-1]])
        s = substring_dedup.recompress(codes, np.zeros(len(codes), np.int64))
        inside = (s.low >= 30) & (s.high <= 90)
        names.append(set(zip(s.name[inside].tolist(), (s.start[inside] - 30).tolist())))
    assert names[0] == names[1] and len(names[0]) > 5


def test_near_duplicates(spark):
    r = random.Random(5)
    base = " ".join(f"w{r.randrange(500)}" for _ in range(120))
    docs = [(i, base if i % 3 else base.replace("w1", "W1", 1)) for i in range(20)]
    docs += [(20 + i, base + " tail" * (i % 3)) for i in range(15)] + [(50 + i, " ".join(f"v{r.randrange(99)}" for _ in range(30))) for i in range(15)]
    docs += [(90, None), (91, ""), (92, " "), (None, "alone here now"), (93, "two words"), (94, "Two  Words")]
    got = near_dup.near_duplicates(table(spark, docs))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute.near_duplicates(docs), key=str)
    kept = {r["doc_id"] for r in near_dup.without_near_duplicates(table(spark, docs)).collect()}
    assert kept == {d for d, _, c in brute.near_duplicates(docs) if c is None or d == c}
    assert near_dup.near_duplicates(table(spark, docs).limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [2, 500])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, crowd):
    monkeypatch.setattr(near_dup, "CROWD", crowd)
    r = random.Random(crowd)
    fps = {0, (1 << 64) - 1}
    for _ in range(25):
        x = r.getrandbits(64)
        for _ in range(12):
            fps.add(x)
            for _ in range(r.randrange(4)):
                x ^= 1 << r.randrange(64)
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    found = {r["node"]: r["root"] for r in near_dup.components(near_dup.links(df)).collect()}
    root = brute.linked([f % (1 << 64) for f in fps])
    assert [found.get(f, f) for f in fps] == [fps[k] for k in root]


def test_pivot_distances_bound_hamming_distances():
    r = np.random.default_rng(1)
    x = r.integers(0, 2**63, 50, np.uint64)
    y = x ^ (np.uint64(1) << r.integers(0, 64, 50).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 50).astype(np.uint64))
    a, b = near_dup.distance_table(x), near_dup.distance_table(y)
    assert (np.abs(a.astype(int) - b).max(1) <= np.bitwise_count(x ^ y)).all()
    assert (near_dup.meeting_keys(a) == near_dup.meeting_keys(b)).any(1).all()


def test_fingerprints(spark):
    docs = [(i, " ".join(f"w{(i // 2) * 7 + k % 50}" for k in range(20 * (i % 5 + 1)))) for i in range(30)] + ODD[2:3] + [(40, None), (41, "é中🙂" * 5)]
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_report(table(spark, docs), fraction=1.0).collect()}
    want = brute.fingerprint_inputs(docs)
    assert len(got) == len(want)

    def shingles(text):
        w = text.encode().split()
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    for doc_id, n, text, edited, following in want:
        r = got[doc_id]
        assert (r["n_chars"], r["edited_sha256"]) == (n, brute.sha(edited.encode()))
        a, b, c = shingles(text), shingles(edited), shingles(following)
        assert r["near_edited"] == pytest.approx(len(a & b) / len(a | b) if a | b else 0)
        assert r["near_next"] == pytest.approx(len(a & c) / len(a | c) if a | c else 0)
        assert r["contained_next"] == pytest.approx(len(a & c) / len(a) if a else 0)
    assert fingerprints.fingerprint_report(table(spark, docs).limit(0)).count() == 0


def test_sketches_merge_and_keep_the_fraction(spark):
    text = " ".join(f"w{k}" for k in range(4000))
    df = spark.createDataFrame([(text, text[: len(text) // 2], text[len(text) // 2 - 40 :])], "whole string, a string, b string")
    for c in ("whole", "a", "b"):
        df = fingerprints.with_sketch(df, c, f"{c}_s")
    row = df.select(F.size("whole_s"), fingerprints.containment(F.col("a_s"), F.col("whole_s")), F.size(fingerprints.merged(F.col("a_s"), F.col("b_s")))).first()
    assert 850 < row[0] < 1150 and row[1] > 0.99 and abs(row[2] - row[0]) <= 12


def test_short_texts_are_like_themselves(spark):
    docs = [(i, " ".join(f"s{i // 2}_{k}" for k in range(i // 2 % 7))) for i in range(80)]
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_report(table(spark, docs)).collect()}
    for i, text in docs:
        assert (got[i]["fingerprint"] == "") == (text == "")
        if i % 2:
            assert got[i]["near_next"] == got[i]["contained_next"] == (1 if text else 0) and got[i]["fingerprint"] == got[i - 1]["fingerprint"]
    # The least hash of one part goes where the other has hashes below the fraction.
    parts = spark.createDataFrame([(f"p{k} a b c d", f"q{k} a b c d") for k in range(40)], "a string, b string")
    for c in ("a", "b"):
        parts = fingerprints.with_sketch(parts, c, f"{c}_s")
    limit = int(fingerprints.FRACTION * 2**fingerprints.BITS)
    for a, b, both in parts.select("a_s", "b_s", fingerprints.merged(F.col("a_s"), F.col("b_s"))).collect():
        union = sorted({*a, *b})
        assert len(a) == len(b) == 1 and both == ([h for h in union if h < limit] or union[:1])


def test_permutation_is_a_bijection_and_its_column_agrees(spark):
    for n in (1, 2, 3, 5, 64, 97, 1000):
        p = sharding.Permutation(n, seed=n)
        places = [p.place(i) for i in range(n)]
        assert sorted(places) == list(range(n))
        assert all(p.row_number_at(x) == i for i, x in enumerate(places))
        assert [r[0] for r in spark.range(0, n, 1, 1).select(p.column(F.col("id"))).collect()] == places
    huge = sharding.Permutation(10**13, seed=1)
    ids = [0, 1, 10**12, 10**13 - 1]
    assert [huge.row_number_at(huge.place(i)) for i in ids] == ids
    assert [r[0] for r in spark.createDataFrame([(i,) for i in ids], "id bigint").coalesce(1).select(huge.column(F.col("id"))).collect()] == [huge.place(i) for i in ids]


def test_sharding(spark):
    docs = ODD + [(20 + i, f"t{i % 3}") for i in range(50)] + [(None, None)]
    df = table(spark, docs).select("doc_id", "text")
    got = sharding.assign_shards(df, 4, ["doc_id", "text"], seed=3)
    rows = got.collect()
    assert sorted((r["doc_id"], r["text"]) for r in rows if r["doc_id"]) == sorted((d for d in docs if d[0]), key=lambda d: (d[0], d[1]))
    for s in range(4):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots))) and len(slots) in (len(docs) // 4, -(-len(docs) // 4))
    again = sharding.assign_shards(df.repartition(5), 4, ["doc_id", "text"], seed=3)
    assert sorted(map(str, again.collect())) == sorted(map(str, rows))
    assert sharding.assign_shards(df.limit(0), 4, ["doc_id", "text"]).count() == 0
    with pytest.raises(ValueError):
        sharding.assign_shards(got, 4, ["doc_id"])


needs_tokenizers = pytest.mark.skipif(not os.path.isdir(queries.TOKENIZERS), reason="no public tokenizers here")
ALPHABET = ["a", "b", "'s", " ", "  ", "\n", "\t", "é", "ß", "中", "the", "ing", "1", "23", "!", "...", "<|endoftext|>", " ", "́", "🙂", "aaaa", "\x1c", "\x85"]


def random_texts(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randrange(14))) for _ in range(n)] + ["a" * 5000, "ab" * 3000]


@needs_tokenizers
def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), bpe.codec_for(Path(path).read_text(encoding="utf-8"))
    for text in random_texts(1, 4000) + [f"a{chr(i)}{chr(i)} b" for i in range(0, 0x3000)]:
        ids = library.encode(text, add_special_tokens=False).ids
        raw, back = own.encode(text)
        assert np.frombuffer(raw, np.uint32).tolist() == ids and back.decode() == text
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert own.decode([50000 + k for k in range(3)] + [94]) == library.decode([50000 + k for k in range(3)] + [94], skip_special_tokens=False)
    docs = ODD + [(30, "x<|endoftext|>y  z\n\n q")] * 2
    rows = bpe.encode_documents(table(spark, docs), path)
    assert rows.columns == ["doc_id", "text", *CLASHING, "token_ids", "decoded"]
    for r in rows.collect():
        assert r["token_ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids and r["decoded"] == (r["text"] or "")
    digests = {(r["doc_id"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(table(spark, docs), path).collect()}
    assert digests == {(i, brute.sha(np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()), brute.sha((t or "").encode())) for i, t in docs}
    assert bpe.digests(table(spark, docs).limit(0), path).count() == 0


@needs_tokenizers
@pytest.mark.parametrize("byte_fallback", [True, False])
def test_token_counts_equal_the_library(spark, byte_fallback):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = token_counts.read_vocabulary(queries.tokenizer_path("piece_bpe_32k.model"))
    library = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=byte_fallback))
    library.pre_tokenizer = pre_tokenizers.Metaspace()
    own = token_counts.Counter(vocabulary, byte_fallback)
    for text in random_texts(2, 3000) + ["", " ", " a", "a  b", "▁x", "<s> hi"]:
        assert own.count(text) == len(library.encode(text).ids), repr(text)
    rows = token_counts.count_tokens(table(spark, ODD), vocabulary, byte_fallback=byte_fallback).collect()
    assert {(r["doc_id"], r["n_tokens"]) for r in rows} == {(i, len(library.encode(t).ids) if t else 0) for i, t in ODD}


def test_unigram_ties_keep_the_longest_last_piece():
    own = token_counts.Counter([("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0)], False)
    assert own.search("▁ab") == (-3.0, 2)


def test_language_model_counts_and_scores(spark):
    r = random.Random(2)
    docs = [(i, " ".join(["The", f"w{r.randrange(9)}", f"x{r.randrange(9)}"] * r.randrange(1, 30))) for i in range(120)] + ODD
    docs = list({d[0]: d for d in docs}.values())
    got = {row["doc_id"]: row for row in lm.score_documents(table(spark, docs)).collect()}
    want = brute.base_scores(docs)
    assert got.keys() == want.keys()
    for i, (held_out, n, known, total, base) in want.items():
        row = got[i]
        assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"]) == (held_out, n, known, total)
        assert row["base_score"] == pytest.approx(base) and np.isfinite(row["score"])
    held = [i for i in range(120) if want[i][0]]
    assert sum(got[i]["score"] for i in held) > sum(got[i]["base_score"] for i in held)
    assert lm.score_documents(table(spark, docs).limit(0)).count() == 0


def test_interpolation_weights():
    rare, often = (1, 1 + 3 * lm.STEPS, 1 + 9 * lm.STEPS, 10), (9, 1 + lm.STEPS, 1 + 9 * lm.STEPS, 1000)
    w = lm.learn([rare, (1, 0, 1 + 6 * lm.STEPS, 1000), often], 1e-4)
    assert np.allclose(w.sum(1), 1) and w[9, 0] > 0.99 > 0.1 > w[1, 0] and (w[:, 2] > 0).all()
    assert lm.context_bucket(np.array([0, 1, 2, 3, 4])).tolist() == [0, 1, 2, 2, 3]


def test_language_identification(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.QUERIES["op6_language"](spark, SF).join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 20 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)
    model = language.fit(df, "text", "lang", "doc_id")
    told = {r["doc_id"]: r for r in language.predict(table(spark, [(1, None), (2, ""), (3, "12 !?"), (4, "the and of this that")]), model).collect()}
    assert [told[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and told[4]["lang_pred"] != "und" and told[1]["score"] == 0
    nothing = language.fit(df.withColumn("lang", F.lit(None).cast("string")), "text", "lang", "doc_id")
    assert {r["lang_pred"] for r in language.predict(df.limit(3), nothing).collect()} == {"und"}
    one = language.fit(df.where("lang = 'en'"), "text", "lang", "doc_id")
    assert {(r["lang_pred"], r["score"]) for r in language.predict(df.where("lang = 'en'").limit(3), one).collect()} == {("en", 1.0)}


def test_language_sample_is_the_least_hashes_of_each_label(spark):
    rows = [(k, f"l{k % 3}" if k % 3 else "rare" if k % 90 == 0 else None) for k in range(6000)] + [(1, "l1")] * 3000 + [(None, "l1")] * 50
    df = spark.createDataFrame(rows, "key bigint, label string").repartition(5)
    hashed = df.distinct().where("key is not null and label is not null").withColumn("hash", F.xxhash64(F.lit(42), "key")).collect()
    order = sorted((r["hash"], r["key"], r["label"]) for r in hashed)
    got = {(r["label"], r["key"]) for r in language.sample(df, "label", "key", per_label=40).collect()}
    assert got == {(l, k) for name in ("l1", "l2", "rare") for _, k, l in [x for x in order if x[2] == name][:40]}
    few = {(r["label"], r["key"]) for r in language.sample(df, "label", "key", in_all=2).collect()}
    firsts = sorted(next(x for x in order if x[2] == name) for name in ("l1", "l2", "rare"))
    assert few == {(l, k) for _, k, l in firsts[:2]}


def test_repeated_rows_teach_once(spark):
    docs = [(k, ("the and of this " if k % 2 else "der und von das ") + f"w{k}", "en" if k % 2 else "de") for k in range(40)]
    once = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    often = spark.createDataFrame(docs + docs[:1] * 500, once.schema).repartition(4)
    a, b = (language.fit(df, "text", "lang", "doc_id") for df in (once, often))
    assert a.languages == b.languages == ["de", "en"] and (a.weights == b.weights).all()


def test_codewords_lie_apart():
    for n in (2, 3, 5, 9, 40):
        code = language.codewords(n)
        apart = [(a != b).sum() for k, a in enumerate(code) for b in code[:k]]
        assert code.shape[0] == n and min(apart) >= (1 if n == 2 else 2 if n == 3 else 5)


def test_decontamination(spark):
    r = random.Random(8)
    words = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(r.choice(words) for _ in range(n))) for k, n in enumerate([12, 40, 40, 25, 3, 1, 70])] + [(90, None), (91, ""), (92, "x y " * 12)]
    docs = []
    for i in range(60):
        own = [r.choice(words) for _ in range(r.randrange(80))]
        if i % 3 == 0:
            item = (items[i // 3 % 7][1]).upper().split()
            if i % 2 and len(item) > 20:
                item[r.randrange(len(item))] = "changed"
            own[r.randrange(len(own) + 1) : 0] = item
        docs.append((i, " ".join(own)))
    docs += [(70, items[1][1]), (71, " ".join(items[1][1].split()[:36])), (72, "x y " * 40), (73, None), (74, "")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.leaks(table(spark, docs + docs[:3]), bench)
    found = {(x["doc_id"], x["item_id"]): (pytest.approx(x["similarity"]), x["start"]) for x in got.collect()}
    want = brute.leaks(docs, items)
    assert {k: (v[0], v[1]) for k, v in want.items()} == found and len(want) > 20
    kept = {x["doc_id"] for x in decontaminate.without_leaks(table(spark, docs), bench).collect()}
    assert kept == {d[0] for d in docs} - {d for d, _ in want}
    assert decontaminate.leaks(table(spark, docs).limit(0), bench).count() == 0
    assert decontaminate.without_leaks(table(spark, docs), bench.limit(0)).count() == len(docs)


def test_simhash_column(spark):
    r = np.random.default_rng(4)
    hashes = [int(x) for x in r.integers(-(2**63), 2**63, 33)]
    got = decontaminate.with_simhash(spark.createDataFrame([(hashes,)], "h array<bigint>"), "h", "fp").first()["fp"]
    assert got % 2**64 == sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in hashes) > len(hashes))
