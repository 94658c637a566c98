from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402

from stratalog.llm import line_dedup, queries  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(queries.TOKENIZERS), reason="no public tokenizers here")
def test_pipeline_equals_the_plain_versions_in_turn(spark, tmp_path):
    from tokenizers import Tokenizer

    read = spark.read.parquet(f"{SF}/documents.parquet")
    docs = [(r["doc_id"], r["text"]) for r in read.collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    docs = [d for d in docs if d[1] and any(c.isalpha() for c in d[1])]
    docs = [(i, t) for i, t, lost in brute.dedup_lines(docs, 2, line_dedup.MIN_WORDS) if not (lost and t == "")]
    docs = [d for d, (i, _, c) in zip(docs, brute.near_duplicates(docs)) if i == c]
    leaked = {i for i, _ in brute.leaks(docs, items)}
    docs = [d for d in docs if d[0] not in leaked]
    library = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in docs}

    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"]: r["token_ids"] for r in got} == want
    assert all(r["round_trip"] and r["n_tokens"] == len(r["token_ids"]) for r in got) and leaked

    # Written and read again between the stages, columns kept until the last.
    table = read
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, table, SF)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == read.columns
        out.write.parquet(str(tmp_path / str(k)))
        table = spark.read.parquet(str(tmp_path / str(k)))
    assert {r["doc_id"]: r["token_ids"] for r in table.collect()} == want


def test_stages_take_clashing_names(spark, tmp_path):
    docs = [(k, f"the and of this that w{k} x{k}", "en", k, "a", True, 1, [1], "d", 2.5) for k in range(12)] + [(12, None, None, None, None, None, None, None, None, None)]
    names = "doc_id bigint, text string, lang string, lang_pred int, `a b` string, lang_ambiguous boolean, lines_removed int, token_ids array<int>, decoded string, `o d` double"
    first = spark.createDataFrame(docs, names)
    spark.createDataFrame([(1, "the and of this that w3 x3")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    table = first
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, table, str(tmp_path))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == first.columns
        out.write.parquet(str(tmp_path / f"stage{k}"))
        table = spark.read.parquet(str(tmp_path / f"stage{k}"))
    got = table.collect()
    assert {r["doc_id"] for r in got} == set(range(12)) - {3} and all(r["round_trip"] and r["lang"] == "en" for r in got) and "source" not in table.columns


def test_stages_take_empty_tables(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, SF)
    assert table.count() == 0
