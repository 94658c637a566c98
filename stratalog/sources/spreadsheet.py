"""Spreadsheet exports: CSV with quoted multi-line cells, read in byte ranges.

A line break ends a record only outside of quotes, and whether a place is quoted depends on all of the file before it. A file is still read
by many tasks: each reads the lines of its byte range and follows both cases, range begun outside and inside of quotes, to its end. What a range
does to the case is one of four maps (same, other, always out, always in); a prefix scan over the ranges, one row each, settles
where every range truly begins, and with it which lines begin records and how many records come before.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalog import fixed

#: Per line and case (0: its range began outside of quotes, 1: inside): whether it is quoted before and after it, and record starts up to it.
_LINES = ("file string, block bigint, line bigint, value string, "
          "before_0 boolean, after_0 boolean, starts_0 bigint, before_1 boolean, after_1 boolean, starts_1 bigint")


def ends_quoted(line: str, quoted: bool) -> bool:
    """Whether a line ends inside of a quoted cell. A quote opens a cell only as its first character; a doubled one stays in it."""
    at = 0
    while True:
        if not quoted:
            if line[at : at + 1] == '"':
                quoted, at = True, at + 1
            else:
                at = line.find(",", at) + 1
                if at == 0:
                    return False
                continue
        at = line.find('"', at)
        if at < 0:
            return True
        if line[at + 1 : at + 2] == '"':
            at += 2
            continue
        at = line.find(",", at + 1) + 1
        if at == 0:
            return False
        quoted = False


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in the order of their range, both cases followed."""
    place = None
    for batch in batches:
        columns = [[] for _ in range(10)]
        for file, block, value in zip(*[batch.column(k).to_pylist() for k in range(3)]):
            if (file, block) != place:
                place, number, quoted, starts = (file, block), 0, [False, True], [0, 0]
            blank, row = value in ("", "\r"), [file, block, number, value]
            for case in (0, 1):
                before = quoted[case]
                starts[case] += not before and not blank
                quoted[case] = ends_quoted(value, before) if '"' in value else before
                row += [before, quoted[case], starts[case]]
            number += 1
            for column, v in zip(columns, row):
                column.append(v)
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()] + [pa.bool_(), pa.bool_(), pa.int64()] * 2
        names = [f.split(" ")[0] for f in _LINES.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def settled(lines: DataFrame, count: str = "starts", line: str = "line") -> DataFrame:
    """(file, block, inside, offset): whether a range begins inside of quotes, and what is counted before it: the records that begin."""
    last = F.max_by(F.struct("after_0", "after_1", f"{count}_0", f"{count}_1"), line).alias("last")
    ranges = lines.groupBy("file", "block").agg(last).select("file", "block", "last.*")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block")
    # The map's effect: a constant sets the case, "other" flips it. Flips are counted; a constant is kept relative to the flips before it.
    flips = F.sum((F.col("after_0") & ~F.col("after_1")).cast("int"))
    constant = F.when(F.col("after_0") == F.col("after_1"), F.col("after_0").cast("int"))
    known = ranges.withColumn("flips", flips.over(upto)).withColumn("set", (constant + F.col("flips")) % 2)
    set_before, flips_before = F.last("set", ignorenulls=True).over(earlier), F.coalesce(F.lag("flips").over(upto), F.lit(0))
    told = known.withColumn("inside", (F.coalesce(set_before, F.lit(0)) + flips_before) % 2 == 1)
    own = F.when(F.col("inside"), F.col(f"{count}_1")).otherwise(F.col(f"{count}_0"))
    return told.withColumn("own", own).select("file", "block", "inside", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("offset"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, text): the records of CSV files, numbered from 1 in each file; blank lines between them are none.

    One shuffle brings the lines of a record together; no task holds more than its own ranges, however large a file is.
    """
    read = spark.read.text(path, lineSep="\n").select("_metadata.file_path", "_metadata.file_block_start", "value")
    lines = read.mapInArrow(_followed, _LINES)
    placed = lines.join(settled(lines), ["file", "block"])

    def case(name: str) -> F.Column:
        return F.when(F.col("inside"), F.col(f"{name}_1")).otherwise(F.col(f"{name}_0"))

    kept = placed.where(case("before") | ~F.col("value").isin("", "\r"))
    whole = kept.groupBy("file", (F.col("offset") + case("starts")).alias("record")).agg(F.sort_array(F.collect_list(F.struct("block", "line", "value"))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x.value), "\n")
    return whole.select("file", "record", F.regexp_replace(text, r"\r\z", "").alias("text"))


def read_csv(spark: SparkSession, path: str, columns: Mapping[str, str]) -> DataFrame:
    """The named columns of a CSV, trimmed, blank as null, with the row order in ``ord``.

    A quoted cell may hold line breaks. Every file begins with a header, all alike. ``ord`` is (file, record in it).
    """
    options = {"quote": '"', "escape": '"', "multiLine": "true"}
    headers = spark.read.csv(path, header=True, **options).columns  # looks at the first record only
    number = {c.strip(): k for k, c in enumerate(headers)}
    parsed = records(spark, path).where("record > 1").select(
        F.from_csv("text", ", ".join(f"c{k} string" for k in range(len(headers))), options).alias("cells"), F.struct("file", F.col("record").alias("row")).alias("ord"))

    def cell(header: str, name: str) -> F.Column:
        if header not in number:
            return F.lit(None).cast("string").alias(name)
        text = F.regexp_replace(F.col(f"cells.c{number[header]}"), r"^\s+|\s+$", "")
        return F.nullif(text, F.lit("")).alias(name)

    return parsed.select(*[cell(h, n) for h, n in columns.items()], "ord")


def read_spreadsheet(spark: SparkSession, path: str) -> DataFrame:
    """The sample spreadsheet; rows without a name are dropped."""
    return read_csv(spark, path, fixed.SPREADSHEET_COLUMNS).filter("name is not null")
