"""SimHash near-duplicates: fingerprints within a Hamming radius of 2, found by tables of distances to pivots.

For each distinct fingerprint x the distances d(x, p) to 33 reference fingerprints are computed once: p0 has no bit set, p1 to p32
have the two bits of one block. By the triangle inequality |d(x, p) - d(y, p)| <= d(x, y) for every pivot, so a pair with a
larger difference in any coordinate is discarded; what survives is verified on the fingerprints.

To meet at all, candidates must agree in some coordinates. The 32 block pivots form 5 groups. Two bits touch 2 groups at
most, and where no bit differs, d(x, p) - d(x, p0) is equal; so near pairs agree in all these relative coordinates of at
least 3 groups. Fingerprints are grouped by each of the 10 choices of 3 groups; every near pair meets in one of them.

A crowd (a key that very many distinct fingerprints share) is not compared pair by pair: two fingerprints are within 2
exactly if some point is within 1 of both, and a point has at most 65 such neighbours. So each member is sent to its 65 points, and who
meets there is linked. This is exact, and linear in the crowd.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.columns import require, shuffle_partitions
from stratalog.session import durable

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Two-bit blocks of the pivots, and their groups.
BLOCKS = 32
GROUPS = (range(0, 7), range(7, 14), range(14, 20), range(20, 26), range(26, 32))
KEYS = list(combinations(range(len(GROUPS)), len(GROUPS) - RADIUS))
#: Keys with more distinct fingerprints are crowds.
CROWD = 500


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text: bit set where over half of its shingle hashes have it; no words: 0."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], np.uint64)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(np.uint64)[0])


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, fp): the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, fp bigint")


def pivots() -> np.ndarray:
    """The reference fingerprints: none, then each block's two bits."""
    return np.array([0, *(3 << 2 * b for b in range(BLOCKS))], np.uint64)


def distance_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints (rows) to the pivots (columns)."""
    return np.bitwise_count(fps[:, None] ^ pivots()[None, :]).astype(np.int8)


def meeting_keys(table: np.ndarray) -> np.ndarray:
    """For each fingerprint (row) and choice of pivot groups (column) the number of its relative coordinates there."""
    relative = (table[:, :1].astype(np.int64) + 2 - table[:, 1:]) // 2  # 0 to 2
    of_group = [sum(relative[:, b] * 3**i for i, b in enumerate(g)) for g in GROUPS]
    out = np.empty((len(table), len(KEYS)), np.int64)
    for k, chosen in enumerate(KEYS):
        number = np.zeros(len(table), np.int64)
        for g in chosen:
            number = number * 3 ** len(GROUPS[g]) + of_group[g]
        out[:, k] = number * len(KEYS) + k
    return out


def near_pairs(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs that share a key and are within the radius. ``keys`` ascend."""
    table = distance_table(fps)
    left, right, at, gap = [], [], np.arange(len(keys)), 1
    while len(at):
        at = at[at + gap < len(keys)]
        at = at[keys[at] == keys[at + gap]]
        i, j = at, at + gap
        for p in range(table.shape[1]):  # the largest coordinate difference decides; most pairs fall at the first few
            ok = np.abs(table[i, p] - table[j, p]) <= RADIUS
            i, j = i[ok], j[ok]
        ok = np.bitwise_count(fps[i] ^ fps[j]) <= RADIUS
        left.append(i[ok])
        right.append(j[ok])
        gap += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (at, at)


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least place in each place's component, from links between places."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def links(fps: DataFrame) -> DataFrame:
    """Rows (a, b), a > b: links between distinct fingerprints (column fp) whose components are those of all pairs within the radius."""
    buckets = 2 * shuffle_partitions(fps)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            keys = meeting_keys(distance_table(own.view(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(own, keys.shape[1]))], ["key", "fp"])

    def close(rows: pa.Table) -> pa.Table:
        keys, own = rows.column("key").to_numpy(), rows.column("fp").to_numpy()
        order = np.lexsort((own, keys))
        keys, own = keys[order], own[order]
        i, j = near_pairs(keys, own.view(np.uint64))
        names, place = np.unique(own, return_inverse=True)
        root = roots(len(names), place[i], place[j])
        far = np.flatnonzero(root != np.arange(len(names)))
        return pa.table([pa.array(names[far]), pa.array(names[root[far]])], ["a", "b"])

    all_keys = fps.select("fp").mapInArrow(keyed, "key bigint, fp bigint")
    shared = all_keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = durable(all_keys.join(shared, "key"))
    few = met.where(F.col("n") <= CROWD).select("key", "fp", F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"))
    near = few.groupBy("bucket").applyInArrow(close, "a bigint, b bigint")

    flips = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.call_function("shiftleft", F.lit(1).cast("bigint"), k)))
    crowd = met.where(F.col("n") > CROWD).select("fp").distinct()
    points = crowd.select("fp", F.explode(F.transform(flips, lambda b: F.col("fp").bitwiseXOR(b))).alias("point"))
    meet = points.groupBy("point").agg(F.min("fp").alias("b"), F.collect_set("fp").alias("who")).where(F.size("who") > 1)
    crowded = meet.select(F.explode("who").alias("a"), "b").where("a != b")
    return near.union(crowded).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of the links (a, b), a > b: the least node of its component.

    Large-star and small-star steps by turns until nothing changes; each round is a written table, of about as many rows as nodes.
    """
    edges = durable(edges)
    state = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(below, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(below.select("a", F.col("m").alias("b")))
        edges = durable(small.distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, fingerprint (16 hexadecimal digits), component_id: the smallest doc_id it is linked with, directly or
    over others.

    Null and empty texts, and those of white space only, have fingerprint zero and are linked like any other. A null doc_id is never
    a component_id; a component of such alone has a null one. Repeated rows each come back. Other columns are not read.
    """
    require(df, doc_id, text)
    docs = durable(fingerprints(df, doc_id, text))
    fps = docs.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(links(fps))
    members = found.select(F.col("node").alias("fp"), "root").union(found.select(F.col("root").alias("fp"), "root").distinct())
    of_root = fps.join(members, "fp").groupBy("root").agg(F.min("first").alias("linked"))
    of_fp = members.join(of_root, "root").select("fp", "linked")
    named = fps.join(of_fp, "fp", "left").select("fp", F.coalesce("linked", "first").alias("component_id"))
    return docs.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def without_near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` without those linked with a smaller doc_id, all columns as they were.

    doc_id must tell rows apart: rows that share one go together if any of them is linked with a smaller one, and rows without
    a doc_id go together if any of them is linked with a row that has one.
    """
    found = near_duplicates(df, doc_id, text)
    later = found.where(F.col("component_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = durable(later.select(F.col("doc_id").alias("_gone_doc_id")).distinct())
    return df.join(gone, df[doc_id].cast("bigint").eqNullSafe(gone["_gone_doc_id"]), "left_anti")
