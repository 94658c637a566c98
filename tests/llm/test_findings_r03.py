"""Findings of round 3."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from stratalog.llm import collocations, lm
from stratalog.llm.exchange import deal, squeeze, unsqueeze


def test_lm_asks_the_corpus_once(spark, monkeypatch):
    """Tokens and distinct words come with the counts: a question of their own took as long as half of the counting."""
    asked = []
    ask = lm.ask
    monkeypatch.setattr(lm, "ask", lambda *args: asked.append(1) or ask(*args))
    docs = [(i, t) for i in range(40) for t in ("Red red\tfox", "fox of %d" % (i % 3), None)]
    got = lm.score_documents(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)).collect()
    assert len(got) == len(docs) and len(asked) == 1
    train = [r for r in got if not r["held_out"]]
    assert {r["train_tokens"] for r in got} == {sum(r["n_tokens"] for r in train)}
    assert all(r["n_known"] == r["n_tokens"] for r in train)


def test_lm_numbers_of_grams():
    """Equal pairs and words have one key, the start is the context of every first token."""
    t = lm.Tokens.of(pa.table({"doc_id": [1, 2, None], "text": ["a B a b", "", "b"]}))
    keys, pair, word, context = t.grams()
    assert t.sizes.tolist() == [5, 1, 2] and len(keys) == len(np.unique(keys)) == 3 + 6
    assert word.tolist() == [1, 2, 1, 2, 0, 0, 2, 0] and context.tolist() == [0, 1, 2, 1, 2, 0, 0, 2]
    assert pair[1] == pair[3] != pair[2] and pair[4] == pair[7] and len(set(pair.tolist())) == 6


def test_collocations_send_keys_and_not_words():
    """A pack sends each phrase it counts as some ten bytes, however long its words are."""
    texts = [" ".join(f"{'long' * 9}{(i * i + k) % 997}" for k in range(40)).encode() for i in range(900)]
    pack = collocations.Pack.of_texts(texts, "en")
    everything = collocations.Filter(64, np.full(8, 255, np.uint8))
    rows = collocations.sent(7, pack, everything, None, True, 5, 3)
    n = sum(len(unsqueeze(x.as_py())[1]) for x in rows.column("payload"))
    assert n > 1500 and set(rows.column("bucket").to_pylist()) == {0, 1, 2}
    assert sum(len(x.as_py()) for x in rows.column("payload")) < 11 * n


def test_collocations_with_equal_keys_stay_apart():
    """Phrases that share the 64-bit hash differ in the second one; counts of one phrase add up over packs and steps."""
    keys = np.array([5, 5, 9], np.uint64)

    def row(pack, check, count):
        payload = squeeze((collocations._planes(keys), np.array(check, np.uint16), np.full(3, 2, np.uint8), np.array(count, np.uint8)))
        return pa.table([pa.array([0], pa.int32()), pa.array([pack], pa.int64()), pa.array([payload], pa.binary())], ["bucket", "pack", "payload"])

    first = collocations.adder(0, 3, 5, 2)(pa.concat_tables([row(4, [1, 2, 1], [1, 2, 3]), row(3, [2, 1, 1], [2, 1, 200])]))
    then = collocations.adder(1, 3, 5, 2)(pa.concat_tables([first.drop(["frequent"]), row(9, [1, 2, 1], [1, 1, 100])]))
    planes, check, size, c, since, pack = unsqueeze(then.column("payload")[0].as_py())
    assert collocations._keys(planes).tolist() == [5, 5, 9] and check.tolist() == [1, 2, 1]
    assert c.tolist() == [3, 5, 303] and since.tolist() == [0, 0, 0] and pack.tolist() == [3, 3, 3]
    # A full cycle after its first shard a rare phrase goes.
    assert collocations.adder(5, 300, 5, 2)(then.drop(["frequent"])).column("payload")[0].as_py() != then.column("payload")[0].as_py()
    assert unsqueeze(collocations.adder(5, 300, 5, 2)(then.drop(["frequent"])).column("payload")[0].as_py())[3].tolist() == [303]


def peak(work):
    """The most bytes that Python and numpy held while ``work`` ran, over what they held before."""
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_collocations_hold_few_bytes_per_word():
    """A worker's memory stays a small multiple of the pack: words are no Python objects, places are 32-bit numbers, hashes are held per distinct phrase."""
    rng = np.random.default_rng(3)
    texts = [b" ".join(b"w%d" % x for x in rng.zipf(1.3, 200) % 5000) + b". A\n" for _ in range(2000)]
    made = peak(lambda: collocations.Pack.of_texts(texts, "en"))
    pack = collocations.Pack.of_texts(texts, "en")
    everything = collocations.Filter(64, np.full(8, 255, np.uint8))
    sent = peak(lambda: collocations.sent(7, pack, everything, None, True, 5, 3))
    assert made < 6 * sum(map(len, texts))
    assert sent < 150 * len(pack.codes)


def test_collocations_lower_arrow_batches_for_a_while(spark, monkeypatch):
    """Packs go to Python a few megabytes at a time; afterwards the session is as before, and a caller's own limit stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    seen, packed, before = [], collocations.packed, spark.conf.get(name)
    monkeypatch.setattr(collocations, "packed", lambda *args: seen.append(spark.conf.get(name)) or packed(*args))
    docs = spark.createDataFrame([("a b a b", "en")] * 3, "text string, lang string")
    assert {r["phrase"] for r in collocations.collocations(docs, least=3).collect()} >= {"a b"}
    assert seen == [str(collocations.BATCH_BYTES)] and spark.conf.get(name) == before
    spark.conf.set(name, "1000000")
    try:
        collocations.collocations(docs, least=3)
        assert seen[1].rstrip("b") == "1000000" == spark.conf.get(name).rstrip("b")
    finally:
        spark.conf.set(name, before)


def test_collocations_ends_of_buckets():
    """Ascending keys are dealt to buckets as `deal` does it, at the limits of buckets too."""
    limits = np.array([(b << 32) // n << 32 for n in (1, 3, 7, 102) for b in range(n)], np.uint64)
    keys = np.sort(np.concatenate([limits, limits + np.uint64(1 << 32), limits - np.uint64(1), np.array([0, 2**64 - 1], np.uint64)]))
    for buckets in (1, 3, 7, 102):
        assert collocations._ends(keys, buckets).tolist() == deal(keys, buckets)[1].tolist()
