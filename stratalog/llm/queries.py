"""The registered query of each operator: it takes the whole table through the operator and returns the whole result."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SHARDS = 8
#: Folder of the public tokenizers; `tokenizer_path` names files in it.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")


def tokenizer_path(name: str) -> str:
    return os.path.join(TOKENIZERS, name)


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalog.llm.fingerprints import fingerprint_report

    return fingerprint_report(documents(spark, sf_dir))


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalog.llm.line_dedup import MIN_WORDS, dedup_lines

    return dedup_lines(documents(spark, sf_dir).select("doc_id", "text"), min_words=MIN_WORDS, place="place")


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalog.llm.substring_dedup import dedup_words

    done = dedup_words(documents(spark, sf_dir))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


@query
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalog.llm.bpe import digests

    return digests(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


@query
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalog.llm.lm import score_documents

    return score_documents(documents(spark, sf_dir))


@query
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalog.llm.language import fit, fold, predict

    rows = documents(spark, sf_dir).select("doc_id", "text", "lang", (fold(F.col("doc_id"), 4) == 2).alias("held_out"))
    model = fit(rows.where(~F.col("held_out")), "text", "lang", "doc_id")
    return predict(rows.drop("lang"), model).drop("text")


@query
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalog.llm.decontaminate import leaks

    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text_hash")


@query
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalog.llm.sharding import assign_shards

    # Only numbers are dealt out, never the texts; the hash orders rows that share a doc_id.
    text = F.coalesce("text", F.lit(""))
    rows = documents(spark, sf_dir).select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_hash"))
    placed = assign_shards(rows, SHARDS, ["doc_id", "size", "text_crc32", "text_hash"], seed=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalog.llm.near_dup import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalog.llm.token_counts import count_tokens, read_vocabulary

    return count_tokens(documents(spark, sf_dir), read_vocabulary(tokenizer_path("piece_bpe_32k.model")))


@query
def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalog.llm.pii import report

    return report(documents(spark, sf_dir))


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalog.llm.collocations import collocations

    return collocations(documents(spark, sf_dir))


SQL["op12_collocations"] = r"""
with pieces as (
    select coalesce(lang, 'und') as lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents),
tokens as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') as ws from pieces),
totals as (select lang, sum(len(ws)) as n from tokens group by lang),
spans as (select lang, ws, size, unnest(range(1, len(ws) - size + 2)) as i from tokens, (values (1), (2), (3), (4), (5)) as sizes(size) where len(ws) >= size),
counts as (
    select lang, array_to_string(ws[i:i + size - 1], ' ') as phrase, size, count(*) as c
    from spans group by 1, 2, 3 having count(*) >= 100),
cuts as (
    select p.lang, p.phrase, p.size, p.c as a, k, array_to_string(string_split(p.phrase, ' ')[1:k], ' ') as head, array_to_string(string_split(p.phrase, ' ')[k + 1:], ' ') as rest
    from counts p, (values (1), (2), (3), (4)) as ks(k) where p.size > k),
scores as (
    select c.lang, c.phrase, c.size, c.a, c.k, h.c as l, t.c as r, n::bigint as n, (1000::hugeint * c.a * n::hugeint) // (h.c::hugeint * t.c) as score
    from cuts c join counts h on h.lang = c.lang and h.phrase = c.head join counts t on t.lang = c.lang and t.phrase = c.rest join totals on totals.lang = c.lang),
candidates as (
    select * from scores qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inside as (
    select q.lang, array_to_string(string_split(q.phrase, ' ')[s:s + len - 1], ' ') as phrase, q.a
    from candidates q, (values (2), (3), (4)) as lens(len), (values (1), (2), (3), (4)) as starts(s) where len < q.size and s + len - 1 <= q.size),
kept as (
    select c.* from candidates c where not exists (select 1 from inside i where i.lang = c.lang and i.phrase = c.phrase and 100 * i.a >= 100 * c.a)),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase collate "binary") as rank from kept)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score from ranked where rank <= 2000
"""


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalog.llm.whitening import whiten

    done = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    # Exact up to 38 digits in the operator; beyond a long there is no value here.
    return done.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))
