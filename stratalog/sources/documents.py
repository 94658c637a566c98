"""JSON documents that hold tables: an object with an array of rows per table, read in byte ranges.

A file is cut after every closing brace, so by many tasks, whether it has one line or many. What a piece means depends on all of the file before it: whether
it begins inside of a string, and how deep. A task follows its range for both cases of the first and counts depth from its own beginning;
`spreadsheet.settled` scans one row per range and settles both. A brace that comes back to the depth of the arrays ends a row.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalog.session import durable
from stratalog.sources.spreadsheet import settled

#: Rows lie in an array of the document's object.
ROW_DEPTH = 2
#: Per piece and case (0: its range began outside of strings, 1: inside): whether it ends inside of a string, and the depth after it.
_PIECES = "file string, block bigint, piece bigint, value string, after_0 boolean, depth_0 bigint, after_1 boolean, depth_1 bigint"
_ESCAPE = re.compile(r"\\.", re.DOTALL)
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|\{', re.DOTALL)
_OPENS_TABLE = re.compile(r"\s*:\s*\[\s*")


def follow(piece: str, inside: bool) -> tuple[bool, int]:
    """Whether a piece, with its closing brace, ends inside of a string, and by how much it changes the depth."""
    parts = _ESCAPE.sub("", piece).split('"')
    outside = parts[1::2] if inside else parts[0::2]
    ends_inside = inside != (len(parts) % 2 == 0)
    depth = sum(p.count("{") + p.count("[") - p.count("]") for p in outside)
    return ends_inside, depth - (not ends_inside)


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place = None
    for batch in batches:
        columns = [[] for _ in range(8)]
        for file, block, value in zip(*[batch.column(k).to_pylist() for k in range(3)]):
            if (file, block) != place:
                place, number, inside, depth = (file, block), 0, [False, True], [0, 0]
            for case in (0, 1):
                inside[case], change = follow(value, inside[case])
                depth[case] += change
            for column, v in zip(columns, (file, block, number, value, inside[0], depth[0], inside[1], depth[1])):
                column.append(v)
            number += 1
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()] + [pa.bool_(), pa.int64()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split(" ")[0] for f in _PIECES.split(", ")])


def row_of(text: str, first: bool) -> tuple[str | None, str | None]:
    """(table, row) of a text that ends with a row: the table's name where its array begins in it. No row, no text: (None, None)."""
    start = text.find("{") + 1 if first else 0
    key = None
    for token in _TOKEN.finditer(text, start):
        if token[0] != "{":
            key = token
            continue
        before = text[start : token.start()].rstrip()
        if not before.endswith(("[", ",")):
            return None, None  # the value of a key
        opens = key is not None and _OPENS_TABLE.fullmatch(text, key.end(), token.start())
        return json.loads(key[0], strict=False) if opens else None, text[token.start() :]
    return None, None


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        file, block, number, text = [batch.column(k) for k in range(4)]
        rows = [row_of(t, n == 0) for t, n in zip(text.to_pylist(), number.to_pylist())]
        out = [file, block, number, pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())]
        yield pa.RecordBatch.from_arrays(out, ["file", "block", "number", "name", "row"])


def document_rows(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, table, row): the rows, as JSON text, of all tables of JSON documents; numbers rise within a file.

    Values of the documents that are no arrays of objects give no rows. One shuffle brings the pieces of a row together; no task holds more
    than its ranges and rows, however large a document is.
    """
    read = spark.read.text(path, lineSep="}", recursiveFileLookup=True).select("_metadata.file_path", "_metadata.file_block_start", "value")
    pieces = read.mapInArrow(_followed, _PIECES)

    def case(name: str) -> F.Column:
        return F.when(F.col("inside"), F.col(f"{name}_1")).otherwise(F.col(f"{name}_0"))

    placed = pieces.join(settled(pieces, "depth", "piece"), ["file", "block"]).select(
        "file", "block", "piece", "value", case("after").alias("after"), (F.col("offset") + case("depth")).alias("depth"))
    told = durable(placed.withColumn("ends", (~F.col("after") & (F.col("depth") <= ROW_DEPTH)).cast("int")).drop("after"))
    in_range = Window.partitionBy("file", "block").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = told.groupBy("file", "block").agg(F.sum("ends").alias("n")).select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    own = told.withColumn("own", F.coalesce(F.sum("ends").over(in_range), F.lit(0)))
    numbered = own.join(counts, ["file", "block"]).withColumn("number", F.col("offset") + F.col("own"))
    last = F.max_by(F.struct("block", "depth", "ends"), F.struct("block", "piece")).alias("last")
    whole = numbered.groupBy("file", "number").agg(F.sort_array(F.collect_list(F.struct("block", "piece", "value"))).alias("parts"), last)
    text = F.concat(F.array_join(F.transform("parts", lambda x: x.value), "}"), F.lit("}"))
    ended = whole.where((F.col("last.ends") == 1) & (F.col("last.depth") == ROW_DEPTH)).select("file", F.col("last.block").alias("block"), "number", text.alias("text"))
    rows = durable(ended.mapInArrow(_cut, "file string, block bigint, number bigint, name string, row string").where("row is not null"))
    # A row belongs to the array that was last opened: in its range, or in an earlier one.
    upto = Window.partitionBy("file", "block").orderBy("number")
    opened = rows.where("name is not null").groupBy("file", "block").agg(F.max_by("name", "number").alias("name"))
    ranges = rows.select("file", "block").distinct().join(opened, ["file", "block"], "left")
    carried = ranges.select("file", "block", F.last("name", ignorenulls=True).over(earlier).alias("carried"))
    named = rows.join(carried, ["file", "block"]).withColumn("table", F.coalesce(F.last("name", ignorenulls=True).over(upto), "carried"))
    return named.select("file", "number", "table", "row")


def as_documents(df: DataFrame, table: str) -> DataFrame:
    """(value): the lines of one JSON document per partition that has rows; it holds them in their order, under the table's name."""
    opening = "{" + json.dumps(table) + ": ["

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            lines = [] if held is None else [held + ","]
            rows = batch.column(0).to_pylist()
            if held is None and rows:
                lines = [opening]
            if rows:
                held = rows[-1]
                yield pa.RecordBatch.from_arrays([pa.array(lines + [r + "," for r in rows[:-1]], pa.string())], ["value"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held, "]}"], pa.string())], ["value"])

    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row")).mapInArrow(run, "value string")
