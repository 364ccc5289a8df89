"""The registered queries of the operators: thin calls with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmart.llm import audit, complement, decontamination, lines, neighbours, packing, quality, repeats, shards, simhash, surrogates, token_files, whitening
from quillmart.llm.common import scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    token_files.write(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.digest_rows(spark, path)


def op3_size_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = shards.sharded(_table(spark, sf_dir, "documents"), scratch(spark, "shards"), arrivals=8, target_bytes=64 << 20, least_bytes=256 << 10)
    rows = store.read()
    return rows.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), F.col("_run").alias("run"), F.col("_shard").alias("shard"), F.col("_in_version").alias("version"))


def op4_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(_table(spark, sf_dir, "documents"), simhash.NARROW)
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def op5_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def op6_edit_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_keyed_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = surrogates.replace(_table(spark, sf_dir, "documents"), key="documents-v1")
    return out.select("doc_id", F.col("_found").alias("n_found"), "text")


def op9_radix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove(_table(spark, sf_dir, "documents"), with_text=False)


def op10_block_matrix_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), first AS (
  SELECT text, min(doc_id) AS first FROM texts GROUP BY text
), known AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), split AS (
  SELECT doc_id, part, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM texts
), failing AS (
  SELECT s.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (CASE WHEN len(words) < 100 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(s.text, '[^A-Z]', '', 'g')) > 10 * length(s.text) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(s.text, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN coalesce(s.doc_id > first, false) THEN 16 ELSE 0 END) AS mask
  FROM split s JOIN first f ON s.text = f.text LEFT JOIN known k ON s.doc_id = k.doc_id
), letters AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) t(letter, bit)
), orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, a.bit AS s1, b.bit AS s2, c.bit AS s3, d.bit AS s4, e.bit AS s5
  FROM letters a JOIN letters b ON b.bit <> a.bit JOIN letters c ON c.bit NOT IN (a.bit, b.bit)
  JOIN letters d ON d.bit NOT IN (a.bit, b.bit, c.bit) JOIN letters e ON e.bit NOT IN (a.bit, b.bit, c.bit, d.bit)
), steps AS (
  SELECT filter_order, 1 AS step, s1 AS own, 0 AS before FROM orders
  UNION ALL SELECT filter_order, 2, s2, s1 FROM orders
  UNION ALL SELECT filter_order, 3, s3, s1 + s2 FROM orders
  UNION ALL SELECT filter_order, 4, s4, s1 + s2 + s3 FROM orders
  UNION ALL SELECT filter_order, 5, s5, s1 + s2 + s3 + s4 FROM orders
), masks AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failing GROUP BY part, mask
), counted AS (
  SELECT part, filter_order, step, own,
    CAST(sum(CASE WHEN mask & (own | before) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN mask & own <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN mask = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM masks CROSS JOIN steps GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counted
"""


def op12_exact_complements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complement.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op13_residue_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_factorisation_machine, op2_token_files, op3_size_tiered_shards, op4_simhash_pigeonring, op5_cost_balanced_packing, op6_edit_decontamination, op7_fuzzy_lines, op8_keyed_surrogates, op9_radix_repeats, op10_block_matrix_neighbours, op11_filter_audit, op12_exact_complements, op13_residue_whitening, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op10_block_matrix_neighbours": OP10_SQL, "op11_filter_audit": OP11_SQL}
