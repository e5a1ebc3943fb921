"""The operators of this subpackage over the test tables: one query each, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import (
    chat_repair,
    collocations,
    dart_minhash,
    decision_list,
    fixity,
    hyperlang,
    line_dedup,
    manifest,
    packing,
    pu_learning,
    raking,
    token_counts,
    topk,
)
from .common import tokenizer_file, written


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_merkle_audit(spark: SparkSession, d: str) -> DataFrame:
    """The pages against a replica of them in which some are altered, lost or added."""
    digits = F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 7)
    number = F.conv(digits, 16, 10).cast("bigint")
    url, html = F.col("url"), F.col("html")
    whole, damaged = fixity.content(url, html), fixity.content(url, F.concat(html, F.lit(" ")))
    rows = _table(spark, d, "pages").select(
        "page_id",
        F.octet_length(whole).cast("bigint").alias("length"),
        F.sha2(whole.cast("binary"), 256).alias("digest"),
        F.when(number % 101 == 5, "altered")
        .when(number % 103 == 7, "missing")
        .when(number % 107 == 11, "extra")
        .alias("fate"),
        F.when(number % 101 == 5, F.sha2(damaged.cast("binary"), 256)).alias("damaged"),
    )
    placed = written(fixity.with_offsets(rows.distinct(), ["page_id", "digest"]))
    originals = placed.withColumn("archive", F.lit("pages"))
    copies = originals.withColumn("replica", F.lit(1)).where(
        F.coalesce(F.col("fate") != "missing", F.lit(True))
    )
    altered = F.col("fate") == "altered"
    copies = copies.withColumns(
        {
            "digest": F.when(altered, F.col("damaged")).otherwise(F.col("digest")),
            "length": F.col("length") + F.when(altered, 1).otherwise(0),
        }
    )
    extra = copies.where("fate = 'extra'").withColumn("offset", F.col("offset") + 1)
    pairs = spark.range(1).select(F.lit("pages").alias("archive"), F.lit(1).alias("replica"))
    found = fixity.audit(originals, copies.unionByName(extra), pairs)
    return found.select("offset", "kind", "length_expected", "length_found", "expected", "found")


_AUDIT = """
WITH records AS (
  SELECT *, sha256(whole) AS digest, CAST(strlen(whole) AS bigint) AS length,
         CASE WHEN fate = 'altered' THEN sha256(whole || ' ') END AS damaged
  FROM (
    SELECT DISTINCT page_id, whole,
           CASE WHEN number % 101 = 5 THEN 'altered' WHEN number % 103 = 7 THEN 'missing'
                WHEN number % 107 = 11 THEN 'extra' END AS fate
    FROM (
      SELECT page_id, coalesce('1' || url, '0') || chr(10) || coalesce('1' || html, '0') AS whole,
             CAST('0x' || substr(md5(CAST(page_id AS varchar)), 1, 7) AS bigint) AS number
      FROM pages
    )
  )
), placed AS (
  SELECT *, CAST(sum(length) OVER (ORDER BY page_id, digest) AS bigint) - length AS "offset"
  FROM records
)
SELECT "offset", fate AS kind, length AS length_expected,
       CASE WHEN fate = 'altered' THEN length + 1 END AS length_found,
       digest AS expected, damaged AS found
FROM placed WHERE fate IN ('altered', 'missing')
UNION ALL
SELECT "offset" + 1, fate, NULL, length, NULL, digest FROM placed WHERE fate = 'extra'
"""


def op2_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Every document with the lines that are left, however alike lines spread over documents; see `dedup_lines`."""
    docs = _table(spark, d, "documents")
    done = line_dedup.dedup_lines(docs, form=line_dedup.normal, shortest=1)
    return done.select("doc_id", "text", "n_lines", "n_removed")


def op3_block_top_k(spark: SparkSession, d: str) -> DataFrame:
    """The 20 best of every query of the contract; see `top_k`."""
    vectors = _table(spark, d, "embeddings").select(
        F.col("vec_id").cast("bigint").alias("vec_id"), topk.scaled("embedding").alias("values")
    )
    return topk.top_k(vectors)


_TOP_K = """
WITH vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, e
  FROM (
    SELECT DISTINCT vec_id, [CAST(floor(64 * CAST(x AS double)) AS bigint) FOR x IN embedding] AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
  )
), scores AS (
  SELECT q.r, q.vec_id AS query_id, v.vec_id,
         CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.e, v.e)]) AS bigint) AS score
  FROM vectors q JOIN vectors v ON len(q.e) = len(v.e)
  WHERE q.vec_id % 20 = 0 AND q.r <> v.r
)
SELECT query_id, CAST(row_number() OVER best AS integer) AS rank, vec_id, score
FROM scores
WINDOW best AS (PARTITION BY r ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER best <= 20
"""


def op4_decision_list(spark: SparkSession, d: str) -> DataFrame:
    """Counts, base filter and the learned rules' verdict of every document; see `judge_quality`."""
    return decision_list.judge_quality(_table(spark, d, "documents"), _table(spark, d, "labels"))


def op5_best_fit_packing(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every document and its sequence, empty texts included; see `pack`."""
    return packing.pack(_table(spark, d, "documents"), tokenizer_file())


def op6_positive_unlabelled(spark: SparkSession, d: str) -> DataFrame:
    """A quality score for every document, learned from labelled ones outside the held-out fold; see `score_quality`."""
    return pu_learning.score_quality(_table(spark, d, "documents"), _table(spark, d, "labels"))


def op7_role_repair(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of every turn, and its piece of the rendered conversation; see `repair`."""
    return chat_repair.repair(_table(spark, d, "conversations"))


def op8_hyperdimensional_language(spark: SparkSession, d: str) -> DataFrame:
    """The language of every document; see `predict_language`."""
    return hyperlang.predict_language(_table(spark, d, "documents"))


def op9_dart_minhash(spark: SparkSession, d: str) -> DataFrame:
    """The class of near-duplicates of every document; see `near_duplicates`."""
    classes = dart_minhash.near_duplicates(_table(spark, d, "documents"))
    return classes.drop("text_hash")


def op10_raking(spark: SparkSession, d: str) -> DataFrame:
    """Every document with the probability its cell was fitted to; see `mix_sources`."""
    mixed = raking.mix_sources(_table(spark, d, "documents"))
    return mixed.select(
        "doc_id",
        F.col("_topic").alias("topic"),
        F.col("_tokens").alias("tokens"),
        F.round("_probability", 6).alias("probability"),
        F.col("_sampled").alias("sampled"),
    )


def op11_collocations(spark: SparkSession, d: str) -> DataFrame:
    """The best 2,000 phrases of every language; see `mine_phrases`."""
    return collocations.mine_phrases(_table(spark, d, "documents"))


def op12_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Bytes and tokens of every document, whatever its columns hold; see `count_tokens`."""
    return token_counts.count_tokens(_table(spark, d, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op13_merkle_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The documents' manifest and a copy with altered texts; see `audit_documents`."""
    return manifest.audit_documents(_table(spark, d, "documents"))


def pipeline(spark: SparkSession, d: str) -> DataFrame:
    """The packed corpus: all stages of `corpus_pipeline`, from the documents as they are."""
    return corpus_pipeline.run(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_merkle_audit": op1_merkle_audit,
        "op2_line_dedup": op2_line_dedup,
        "op3_block_top_k": op3_block_top_k,
        "op4_decision_list": op4_decision_list,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_positive_unlabelled": op6_positive_unlabelled,
        "op7_role_repair": op7_role_repair,
        "op8_hyperdimensional_language": op8_hyperdimensional_language,
        "op9_dart_minhash": op9_dart_minhash,
        "op10_raking": op10_raking,
        "op11_collocations": op11_collocations,
        "op12_token_counts": op12_token_counts,
        "op13_merkle_manifest": op13_merkle_manifest,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_merkle_audit": _AUDIT,
        "op3_block_top_k": _TOP_K,
        "op10_raking": raking.mix_sql(),
        "op11_collocations": collocations.mine_sql(),
        "op13_merkle_manifest": manifest.audit_sql(),
    }
