"""Asking the whole corpus about keys: packs of documents send keys to buckets, buckets answer, packs use the answers.

Several operators need to know something of very many keys (window, line or n-gram hashes) that depends on all
documents: how often a key occurs, or who has it first. One row per key would cost more than the texts. Here Spark deals
arrays instead: a *pack* is a row that holds a few megabytes of documents; for each *bucket* of key values it sends one
row with the sorted-out keys as packed numbers; a bucket's task sees all rows of its bucket, works on them with
numpy and answers each pack with an array of equal length. Keys are made distinct within a pack first, so a key that a third of all documents
have arrives once per pack. Everything between is groupBy and cogroup.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stratalog.llm.columns import shuffle_partitions
from stratalog.session import durable

#: Bytes of rows in a pack; a longer row is a pack by itself.
PACK_BYTES = 4 << 20
#: Buckets per shuffle partition.
BUCKETS = 2
#: How tables with payloads are written. A row may have megabytes, but Parquet's writer looks at sizes only after 100 rows: its pages, held whole
#: by writer and reader in direct memory, and the batches of Spark's reader would take hundreds of packs' megabytes each.
WRITTEN = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "8",
           "parquet.enable.dictionary": "false", "compression": "none"}
#: The order key of a null doc_id: after all others.
LAST = np.iinfo(np.int64).max

#: The pack of rows that answer no pack but tally a bucket.
TALLY = -1

#: The columns of questions and answers.
ROWS = "bucket int, pack bigint, payload binary"

Arrays = tuple[np.ndarray, ...]


def squeeze(arrays: Arrays) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, 5))


def unsqueeze(raw: bytes) -> Arrays:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(raw))


def to_bytes(rows: pa.Table) -> bytes:
    """A pack's payload."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_table(rows)
    return sink.getvalue().to_pybytes()


def rows_in(raw: bytes) -> pa.Table:
    """The rows of a pack."""
    return pa.ipc.open_stream(raw).read_all()


def kept(payloads: DataFrame) -> DataFrame:
    """`durable` for tables with a payload, in row groups of a few packs."""
    return durable(payloads, **WRITTEN)


def pack(df: DataFrame, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """The rows of ``df`` as a written table of packs (pack bigint, payload binary), all columns kept, nothing shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        held, size, number = [], 0, 0

        def out() -> pa.RecordBatch:
            payload = to_bytes(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([first + number], pa.int64()), pa.array([payload], pa.binary())], ["pack", "payload"])

        for batch in batches:
            sizes = np.full(batch.num_rows, 64, np.int64)
            for column in batch.columns:
                if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                    sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
            at, ends = 0, np.cumsum(sizes)
            while at < batch.num_rows:
                room = pack_bytes - size + (ends[at - 1] if at else 0)
                to = max(at + 1, int(np.searchsorted(ends, room, "right")))
                held.append(batch.slice(at, to - at))
                size += int(ends[to - 1] - (ends[at - 1] if at else 0))
                at = to
                if size >= pack_bytes or at < batch.num_rows:
                    yield out()
                    held, size, number = [], 0, number + 1
        if held:
            yield out()

    return kept(df.mapInArrow(run, "pack bigint, payload binary"))


def bucket_count(df: DataFrame) -> int:
    return BUCKETS * shuffle_partitions(df)


def deal(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """How uniform 64-bit keys go to buckets by value: the order by bucket, and where each bucket begins and ends in it."""
    # The upper half times the number of buckets, without 128-bit numbers.
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def ask(packs: DataFrame, make: Callable[[pa.Table], tuple[np.ndarray, Arrays]], buckets: int) -> DataFrame:
    """Rows (bucket, pack, payload) of what each pack asks. ``make`` gives, for the rows of a pack, uniform 64-bit keys by which
    to deal and the arrays to send, all of one length. It must give the same whenever it is called."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, raw in zip(batch.column("pack").to_pylist(), batch.column("payload")):
                yield from question(number, *make(rows_in(raw.as_py())), buckets).to_batches()

    return packs.mapInArrow(run, ROWS)


def question(pack: int, keys: np.ndarray, arrays: Arrays, buckets: int) -> pa.Table:
    """The rows of one pack's question, one for each bucket that gets any of its keys."""
    order, ends = deal(keys, buckets)
    arrays = [a[order] for a in arrays]
    full = np.flatnonzero(np.diff(ends))
    payload = [squeeze(tuple(a[ends[b] : ends[b + 1]] for a in arrays)) for b in full]
    return pa.table([pa.array(full, pa.int32()), pa.array([pack] * len(full), pa.int64()), pa.array(payload, pa.binary())], ["bucket", "pack", "payload"])


def answer(asked: DataFrame, work: Callable[[list[Arrays], list[int]], list[Arrays]], tally: Callable[[list[Arrays]], np.ndarray] | None = None) -> DataFrame:
    """Rows (bucket, pack, payload) of the answers. ``work`` gets what a bucket was asked, by ascending pack, with the
    packs' numbers, and gives one tuple of arrays for each. ``tally``: what it makes of all that a bucket was asked goes into one more row, of the pack TALLY."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pack")
        packs = rows.column("pack").to_pylist()
        asked = [unsqueeze(x.as_py()) for x in rows.column("payload")]
        given = work(asked, packs)
        if tally is not None:
            packs, given = [*packs, TALLY], [*given, tally(asked)]
        bucket = pa.repeat(rows.column("bucket")[0], len(packs))
        return pa.table([bucket, pa.array(packs, pa.int64()), pa.array([squeeze(g) for g in given], pa.binary())], ["bucket", "pack", "payload"])

    return asked.groupBy("bucket").applyInArrow(run, ROWS)


def use(packs: DataFrame, answers: DataFrame, work: Callable[[int, pa.Table, Callable], pa.Table], schema: StructType | str) -> DataFrame:
    """What ``work`` makes of each pack: it gets the pack's number, its rows, and a function from the keys it asked for
    (as ``make`` gave them) and a question's number to the answered arrays in the order of the keys. Packs without answers come too.

    Answers to several questions come in one table, told apart by `numbered`."""
    buckets = bucket_count(packs)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = dict(zip(right.column("bucket").to_pylist(), right.column("payload")))

        def answered(keys: np.ndarray, question: int = 0) -> tuple[np.ndarray, list[Arrays], np.ndarray]:
            """The order of the keys by bucket, and the answers of the buckets in that order."""
            order, ends = deal(keys, buckets)
            return order, [unsqueeze(parts[b + question * buckets].as_py()) for b in np.flatnonzero(np.diff(ends))], np.diff(ends)[np.diff(ends) > 0]

        return work(left.column("pack")[0].as_py(), rows_in(left.column("payload")[0].as_py()), answered)

    return packs.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(run, schema)


def numbered(answers: DataFrame, question: int) -> DataFrame:
    """Answers marked as those to the given question."""
    return answers.withColumn("bucket", (F.col("bucket") + question * bucket_count(answers)).cast("int"))


def flags(found: tuple) -> np.ndarray:
    """Answered bits in the order of the keys."""
    order, parts, sizes = found
    out = np.zeros(len(order), bool)
    if parts:
        out[order] = np.concatenate([np.unpackbits(p[0], count=n) for p, n in zip(parts, sizes)]).astype(bool)
    return out


def numbers(found: tuple) -> np.ndarray:
    """Answered numbers in the order of the keys."""
    order, parts, _ = found
    out = np.zeros(len(order), np.int64)
    if parts:
        out[order] = np.concatenate([p[0] for p in parts])
    return out


def by_doc_id(rows: pa.Table, doc_id: str = "doc_id") -> pa.Table:
    """The rows of a pack by ascending doc_id, nulls last, ties as they stand."""
    order = np.argsort(order_keys(rows, doc_id), kind="stable")
    return rows.take(pa.array(order))


def order_keys(rows: pa.Table, doc_id: str = "doc_id") -> np.ndarray:
    return pc.fill_null(rows.column(doc_id).cast(pa.int64()), int(LAST)).to_numpy()


def firsts(asked: list[Arrays], _packs: list[int]) -> list[Arrays]:
    """For keys (first array, 64 bits; second, more bits) and the doc_id of each (third): which is the first of its key in the corpus.

    Smaller doc_id first; of equal ones the earlier pack. Keys are distinct within a pack."""
    sizes = [len(a[0]) for a in asked]
    high, low, doc = (np.concatenate([a[k] for a in asked]) for k in range(3))
    order = np.lexsort((doc, low, high))  # stable: equal ones stay by pack
    high, low = high[order], low[order]
    new = np.ones(len(order), bool)
    new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    first = np.empty(len(order), bool)
    first[order] = new
    return [(np.packbits(f),) for f in np.split(first, np.cumsum(sizes)[:-1])]


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of distinct keys, ascending, and for each place the number of its key among them."""
    _, first, number = np.unique(keys, return_index=True, return_inverse=True)
    order = np.argsort(first, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return first[order], place[number]


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters all bits."""
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
