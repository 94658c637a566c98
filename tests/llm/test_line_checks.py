"""Lines that share the hash that names them stay apart."""

import numpy as np
import pytest

from stratalog.llm import line_dedup


@pytest.mark.parametrize("lines", [1, 2])
def test_single_lines_go_where_both_hashes_agree(spark, lines):
    one, other = "first line of five words", "another line of five words"
    docs = [(1, f"{one}\n{other}\n{one}"), (2, other), (3, one), (4, f"x\n{other}")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    want = {1: f"{one}\n{other}", 2: "", 3: "", 4: "x"}
    done = line_dedup.dedup_lines(df, min_lines=lines, min_words=5)
    assert {r["doc_id"]: r["text"] for r in done.collect()} == want


def test_owners_need_the_same_check():
    key, doc = np.array([5, 5], np.uint64), np.array([1, 2])
    (bits,), = line_dedup.owners_of([(key, np.array([2, 4], np.uint64), np.array([1, 1], np.uint8), doc)], [0])
    assert np.unpackbits(bits, count=2).tolist() == [1, 1]
    (bits,), = line_dedup.owners_of([(key, np.array([2, 2], np.uint64), np.array([1, 1], np.uint8), doc)], [0])
    assert np.unpackbits(bits, count=2).tolist() == [1, 0]
    # A run of lines and a line are not mistaken for each other.
    (bits,), = line_dedup.owners_of([(key, np.array([2, 2], np.uint64), np.array([0, 1], np.uint8), doc)], [0])
    assert np.unpackbits(bits, count=2).tolist() == [1, 1]
    first, number = line_dedup.distinct_lines(np.array([3, 3, 3, 4]), np.array([1, 2, 1, 1], np.uint64))
    assert first.tolist() == [0, 1, 3] and number.tolist() == [0, 1, 0, 2]
