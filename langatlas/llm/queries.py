"""Registered queries of this folder: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from langatlas.llm import (bpe, cws, dialogue, lexical, linededup, packing, personal, search,
                           sharding, simhash, tokenbin, toxicity, warc)
from langatlas.llm.common import table
from langatlas.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
MULTI_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_texts(spark, sf_dir)).select(
        "doc_id", "fingerprint", "component_id")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_texts(spark, sf_dir), BYTE_BPE).select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"),
        "sequence_id", "offset")


def op3_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_texts(spark, sf_dir))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(_texts(spark, sf_dir), dropped_col="dropped_lines")


def op5_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    return warc.read_warc(spark, path)


def op6_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 50 is a query against all."""
    docs = _texts(spark, sf_dir)
    return search.search(docs, docs.where(F.col("doc_id") % 50 == 0))


def op7_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    tokenbin.write_token_files(_texts(spark, sf_dir), path, BYTE_BPE)
    return tokenbin.read_token_files(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe.encode(_texts(spark, sf_dir), MULTI_BPE, public_tokenizers.PATTERN)
    return bpe.decode(ids, MULTI_BPE).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    model = toxicity.train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.score_documents(docs, model)


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cws.edit_likeness(_texts(spark, sf_dir))
    return found.select("doc_id", "n_chars", "edited_sha256",
                        F.lower(F.hex("fp")).alias("fingerprint"),
                        F.lower(F.hex("edited_fp")).alias("edited_fingerprint"),
                        "near_edited", "near_next")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    repaired = dialogue.repair(dialogue.damage(rows), present_col="present")
    found, hashed = repaired.conversations, dialogue.digests(repaired)
    return found.join(hashed, found["conv_id"].eqNullSafe(hashed["conv_id"])).select(
        found["conv_id"], "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.col("sha256").alias("repaired_sha256"))


def op12_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(_texts(spark, sf_dir),
                                  table(spark, sf_dir, "benchmark", "item_id", "text"))


def _span_text(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"], s["end"])), ",")


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    found = personal.find_personal_data(docs, personal.train(docs))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("bigint")
              .alias(f"n_{kind}") for kind in personal.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(_span_text(F.col("base")), 256).alias("base_sha256"),
        _span_text(F.array_sort(F.concat("base", "added"))).alias("spans"))


QUERIES: list[Query] = [
    op1_simhash_near_dedup,
    op2_best_fit_packing,
    op3_lpt_sharding,
    op4_line_dedup,
    op5_warc_chunks,
    op6_exact_topk_search,
    op7_token_binary,
    op8_byte_level_bpe,
    op9_toxicity,
    op10_document_fingerprints,
    op11_conversation_repair,
    op12_ranked_lexical_search,
    op13_personal_data,
]


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in QUERIES}


TERMS = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP12_SQL = f"""
WITH doc AS (
  SELECT doc_id, unnest(regexp_extract_all({FOLDED}, {TERMS})) AS term FROM documents
),
tf AS (SELECT doc_id, term, count(*) AS tf FROM doc GROUP BY doc_id, term),
size AS (SELECT doc_id, sum(tf) AS n FROM tf GROUP BY doc_id),
total AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM size),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
item AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all({FOLDED}, {TERMS})) AS term FROM benchmark) i
  GROUP BY item_id, term
),
part AS (
  SELECT item_id, tf.doc_id,
         times * CAST(floor(1000 * ln((2 * n_docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT)
         * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * CAST(n AS BIGINT) * n_docs) // n_terms)))
         AS part
  FROM item JOIN tf ON tf.term = item.term JOIN df ON df.term = item.term
       JOIN size ON size.doc_id = tf.doc_id CROSS JOIN total
),
scored AS (
  SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM part
  GROUP BY item_id, doc_id HAVING sum(part) > 0
),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)
                       AS INTEGER) AS rank, doc_id, score
  FROM scored
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    """Of these operators DuckDB SQL can express the lexical search only (it lacks
    the hashes, merges, digests and models of the others); tests/llm checks the
    others against brute force."""
    return {"op12_ranked_lexical_search": OP12_SQL}
