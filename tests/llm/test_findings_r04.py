"""What the findings of round 4 asked for."""

import random

import pyarrow.parquet as pq
import pytest

from stratalog.llm import exchange, line_dedup


def test_packs_are_written_in_small_row_groups(spark):
    """Parquet looks at sizes after 100 rows by default, so some hundred packs were one page, in direct memory."""
    r = random.Random(4)
    df = spark.createDataFrame([(i, r.randbytes(300_000).hex()) for i in range(90)], "doc_id bigint, text string").coalesce(1)
    packs = exchange.pack(df, 1 << 20)
    rows = packs.collect()
    assert len(rows) > 20 and sum(exchange.rows_in(x["payload"]).num_rows for x in rows) == 90
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in packs.inputFiles()]
    sizes = [m.row_group(i).total_byte_size for m in files for i in range(m.num_row_groups)]
    assert sum(sizes) > 20 << 20 and max(sizes) < 20 << 20


@pytest.mark.parametrize("min_lines", [1, 2, 3])
def test_places_are_those_of_the_whole_suffix_array(spark, monkeypatch, min_lines):
    """Sorted to the end, not to the depth of a run: texts here share up to 40 lines before they differ."""
    monkeypatch.setattr(exchange.pack, "__defaults__", (600,))
    r = random.Random(min_lines)
    long = [f"l{k % 7} {k // 9}" for k in range(40)]
    docs = [(i, "\n".join(long[r.randrange(3) : r.randrange(4, 41)] + [r.choice(["a", "b", " "]) for _ in range(r.randrange(4))])) for i in range(30)]
    docs += [(30, None), (31, ""), (32, " \n"), (33, "\n".join(long)), (34, "\n".join(["", *long])), (None, "a"), (35, "alone here")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    lines = {i: [x for x in (t or "").split("\n") if x.strip()] for i, t in docs}
    codes = {i: tuple(line_dedup.hashed([x.encode() for x in own])[0].tolist()) if own else () for i, own in lines.items()}
    suffixes = [c[k:] for c in codes.values() for k in range(len(c))]
    want = {i: sum(s < c for s in suffixes) if c else None for i, c in codes.items()}
    got = line_dedup.dedup_lines(df, min_lines=min_lines, place="place")
    assert {x["doc_id"]: x["place"] for x in got.collect()} == want and want[33] == want[34]
    plain = line_dedup.dedup_lines(df, min_lines=min_lines)
    assert sorted(map(str, plain.collect())) == sorted(map(str, got.drop("place").collect()))
    assert line_dedup.dedup_lines(df.limit(0), place="place").count() == 0
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(df, place="TEXT")
