"""Tests of what the second review found missing."""

from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402

from stratalog.llm import decontaminate, exchange, line_dedup, queries  # noqa: E402


def stored(spark, folder, **tables):
    """A data folder with the given tables."""
    for name, df in tables.items():
        df.write.parquet(str(folder / f"{name}.parquet"))
    return str(folder)


def plain_dedup(docs, min_words):
    """Lines removed of each doc_id: by runs of two lines, by one line of ``min_words`` words, and by a line that is all of its document."""
    docs = brute.by_id(docs)
    split = [[x for x in (d[1] or "").split("\n") if x.strip()] for d in docs]
    seen, out = set(), {}
    for d, s, pair in zip(docs, split, brute.covered(split, 2)):
        gone = 0
        for x, p in zip(s, pair):
            gone += p or x in seen and (len(x.split()) >= min_words or len(s) == 1)
            seen.add(x)
        out[d[0]] = gone
    return out


def test_long_lines_and_one_line_documents_are_runs(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(exchange.pack, "__defaults__", (600,))
    passage, short = " ".join(f"w{k}" for k in range(line_dedup.MIN_WORDS)), " ".join(f"w{k}" for k in range(line_dedup.MIN_WORDS - 1))
    docs = [(1, f"a\n{passage}\nb"), (2, f"c\n{passage}\nd"), (3, f"e\n{short}\nf"), (4, f"g\n{short}\nh"), (5, "one line"), (6, "\none line\n"), (None, passage),
            (7, f"x\n{passage}\ny\n{passage}"), (8, "a"), (9, "i\na\nj")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: (r["text"], r["n_lines_removed"]) for r in queries.op2_line_dedup(spark, stored(spark, tmp_path, documents=df)).collect()}
    text = dict(docs)
    want = {i: (t, 0) for i, t in text.items()} | {2: ("c\nd", 1), 6: ("", 1), None: ("", 1), 7: ("x\ny", 2), 8: ("", 1)}
    assert got == want
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.cut_repeated_lines(spark, df, "").collect()}
    assert kept == {i: t for i, (t, n) in want.items() if t}
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(df, min_lines=3, min_words=5)


def test_runs_by_words_equal_the_plain_version(spark, monkeypatch):
    monkeypatch.setattr(exchange.pack, "__defaults__", (600,))
    r = random.Random(4)
    pool = ["a", "b", "", " ", "c d", "e f g", "h i j k", "l m n o p"] + [f"u{k} v w x" for k in range(60)]
    docs = [(i, "\n".join(r.choice(pool) for _ in range(r.randrange(7)))) for i in range(80)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    for words in (1, 3, 4, 9):
        got = {x["doc_id"]: x["n_lines_removed"] for x in line_dedup.dedup_lines(df, min_words=words).collect()}
        assert got == plain_dedup(docs, words)


def test_long_items_are_found(spark, tmp_path):
    n = 70_000
    item = " ".join(f"w{k % 40_000}" for k in range(n))
    docs = spark.createDataFrame([(1, f"before {item} after"), (2, item[: len(item) // 2]), (3, "w1 w2 w3 w4 w5 w6"), (4, None)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, item), (2, "one two three four five six")], "item_id bigint, text string")
    got = queries.QUERIES["op7_decontaminate"](spark, stored(spark, tmp_path, documents=docs, benchmark=items)).collect()
    assert [tuple(r) for r in got] == [(1, 1, 1.0, 1, 0)]
    assert {r["doc_id"] for r in corpus_pipeline.drop_leaks(spark, docs, str(tmp_path)).collect()} == {2, 3, 4}


def test_a_long_item_within_a_longer_document(spark):
    words = [f"w{k}" for k in range(150_000)]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, " ".join(words[50_000:100_000]))], "item_id bigint, text string")
    got = decontaminate.leaks(docs, items).drop("text_hash").collect()
    assert [tuple(r) for r in got] == [(1, 1, 1.0, 50_000, 0)]


def test_texts_of_one_item_id_give_one_row(spark):
    docs = spark.createDataFrame([(1, "a b c x1 x2 x3 x4 x5 x6 x7")], "doc_id bigint, text string")
    items = spark.createDataFrame([(None, "a b c"), (None, "x1 x2 x3 x4 x5 x6 x7 x8"), (None, "a b c")], "item_id bigint, text string")
    assert [tuple(r) for r in decontaminate.leaks(docs, items).drop("text_hash").collect()] == [(1, None, 1.0, 0, 0)]


@pytest.mark.parametrize("seed", [0, 30])
def test_windows_equal_brute_force(spark, seed):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(r.choice(words) for _ in range(n))) for k, n in enumerate([12, 40, 25, 70, 31])] + [(90, None), (92, "x y " * 12), (93, "x y z " * 15)]
    docs = []
    for i in range(60):
        own = [r.choice(words) for _ in range(r.randrange(80))]
        item = items[i % 5][1].upper().split()
        for _ in range(i % 3):
            item[r.randrange(len(item))] = "changed"
        own[r.randrange(len(own) + 1) : 0] = item * (1 + i % 2)
        docs.append((i, " ".join(own)))
    docs += [(70, items[3][1]), (71, " ".join(items[3][1].split()[:60])), (72, "x y " * 40), (73, None), (74, "x y z " * 13), (None, items[1][1])]
    df = spark.createDataFrame(docs + docs[:3], "doc_id bigint, text string").repartition(3)
    bench = spark.createDataFrame(items + items[3:4], "item_id bigint, text string")
    found = {(x["doc_id"], x["item_id"]): (pytest.approx(x["similarity"]), x["start"]) for x in decontaminate.leaks(df, bench).collect()}
    want = brute.leaks(docs, items)
    assert want == found and len(want) > 40


def test_documents_without_labels_stay_in_the_pipeline(spark):
    texts = [(1, "the and of"), (2, "é"), (3, "12 !?"), (4, ""), (5, None), (None, "word")]
    unlabelled = spark.createDataFrame([(i, t, None) for i, t in texts], "doc_id bigint, text string, lang string")
    kept = corpus_pipeline.identify_language(spark, unlabelled, "")
    assert kept.columns == unlabelled.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, None}
    # Labels that no row can be chosen by.
    nameless = spark.createDataFrame([(None, t, "en") for _, t in texts], "doc_id bigint, text string, lang string")
    assert {r["text"] for r in corpus_pipeline.identify_language(spark, nameless, "").collect()} == {"the and of", "é", "word"}
