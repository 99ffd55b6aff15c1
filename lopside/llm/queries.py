"""One query per operator over its whole table, the pipeline, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lopside.llm import fim, jaccard, lines, minhash, mixing, packing, privacy, quality, simhash, tokens, toxicity, vectors, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_minhash_near_dedup")
def op2(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


@query("op8_mix_to_weights")
def op8(spark, sf_dir):
    return mixing.taken(table(spark, sf_dir, "documents"))


@query("op10_best_fit_packing")
def op10(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op6_line_first_quality")
def op6(spark, sf_dir):
    return quality.rated(table(spark, sf_dir, "documents"))


@query("op9_simhash_fingerprints")
def op9(spark, sf_dir):
    return simhash.fingerprinted(table(spark, sf_dir, "documents"))


@query(
    "op5_warc_round_trip",
    """WITH told AS (
  SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages),
hashed AS (SELECT *, sha1(html) AS hex FROM told),
bits AS (
  SELECT page_id, strlen(html)::bigint AS payload_bytes, CASE WHEN page_id < last THEN last END AS refers_to,
    list_transform(range(4), lambda i: ('0x' || hex[10 * i + 1 : 10 * i + 10])::bigint) AS fifths
  FROM hashed)
SELECT page_id, payload_bytes, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to,
  list_aggregate(list_transform(range(32), lambda k:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((fifths[k // 8 + 1] >> (35 - 5 * (k % 8))) & 31) + 1]), 'string_agg', '') AS payload_digest
FROM bits""",
)
def op5(spark, sf_dir):
    read = warc.round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op7_compression_toxicity")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query("op3_information_theoretic_pii")
def op3(spark, sf_dir):
    return privacy.sanitised(table(spark, sf_dir, "documents"))


@query("op4_trie_token_counts")
def op4(spark, sf_dir):
    return tokens.counted(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query("op1_segment_edit_line_dedup")
def op1(spark, sf_dir):
    return lines.duplicates(table(spark, sf_dir, "documents"))


@query(
    "op11_fill_in_middle",
    """WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens, sha256('1:' || doc_id) AS hex
  FROM documents),
drawn AS (
  SELECT *, len(tokens) AS n, list_transform([1, 9, 17, 25], lambda k: ('0x' || hex[k : k + 7])::bigint) AS h FROM cut),
placed AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS low, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS high,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
      WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT *, array_to_string(tokens[1:low], '') AS prefix, array_to_string(tokens[low + 1:high], '') AS middle, array_to_string(tokens[high + 1:], '') AS suffix
  FROM placed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts""",
)
def op11(spark, sf_dir):
    return fim.digests(table(spark, sf_dir, "documents"))


@query("op12_ngram_jaccard_join")
def op12(spark, sf_dir):
    return jaccard.similar(table(spark, sf_dir, "documents"))


@query("op13_vector_codes")
def op13(spark, sf_dir):
    return vectors.quantised(table(spark, sf_dir, "embeddings"))


@query("pipeline")
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
