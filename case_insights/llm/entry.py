"""Queries of the operators, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from case_insights.llm.ann import nearest_by_inner_product
from case_insights.llm.decontaminate import find_leaks
from case_insights.llm.extract import main_text
from case_insights.llm.jaccard import jaccard_components
from case_insights.llm.mixing import mix_sources
from case_insights.llm.negatives import mine_hard_negatives
from case_insights.llm.packing import pack_by_retrieval, special_tokens
from case_insights.llm.ring import shard_by_ring
from case_insights.llm.sized import scaled, usable
from case_insights.llm.store import documents
from case_insights.llm.substring import remove_repeats
from case_insights.llm.toxicity import judge_toxicity
from case_insights.llm.urlrules import judge_urls
from case_insights.llm.whitening import whiten
from case_insights.llm.wordpiece import byte_vocabulary, token_counts


def vocabulary_path() -> str:
    """The public byte-level vocabulary that the queries use; operators take any as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _neighbours(spark: SparkSession, sf: str) -> DataFrame:
    vectors = documents(spark, sf, "embeddings")
    return nearest_by_inner_product(vectors, vectors.filter("vec_id % 20 = 0"))


def _without_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return remove_repeats(documents(spark, sf)).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


def _hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = documents(spark, sf, "embeddings").filter(usable("embedding") & F.col("label").isNotNull())
    vectors = vectors.select("vec_id", label.alias("label"), scaled("embedding").alias("x"))
    return mine_hard_negatives(vectors, vectors.filter("vec_id % 100 = 0"))


def _whitened(spark: SparkSession, sf: str) -> DataFrame:
    vectors = documents(spark, sf, "embeddings").filter(usable("embedding"))
    return whiten(vectors.select("vec_id", scaled("embedding").alias("x")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_posting_lists": _neighbours,
        "op2_toxicity": lambda spark, sf: judge_toxicity(documents(spark, sf), documents(spark, sf, "labels")),
        "op3_substring_dedup": _without_repeats,
        "op4_ring_shards": lambda spark, sf: shard_by_ring(documents(spark, sf)),
        "op5_decontaminate": lambda spark, sf: find_leaks(documents(spark, sf), documents(spark, sf, "benchmark")),
        "op6_main_text": lambda spark, sf: main_text(documents(spark, sf, "pages")),
        "op7_url_rules": lambda spark, sf: judge_urls(documents(spark, sf, "pages")),
        "op8_retrieval_packing": lambda spark, sf: pack_by_retrieval(
            documents(spark, sf), byte_vocabulary(vocabulary_path()), special=special_tokens(vocabulary_path())
        ),
        "op9_token_counts": lambda spark, sf: token_counts(documents(spark, sf), byte_vocabulary(vocabulary_path())),
        "op10_ngram_jaccard": lambda spark, sf: jaccard_components(documents(spark, sf)),
        "op11_whitening": _whitened,
        "op12_hard_negatives": _hard_negatives,
        "op13_source_mix": lambda spark, sf: mix_sources(documents(spark, sf)),
    }


_HARD_NEGATIVES = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scores AS (
  SELECT a.id AS anchor_id, v.id AS id, a.label = v.label AS same,
         CAST(list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * v.x[i])) AS BIGINT) AS score
  FROM v AS a JOIN v ON v.id <> a.id WHERE a.id % 100 = 0
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5"""


def oracle_sql() -> dict[str, str]:
    """The other operators learn, search approximately, walk automata or follow links, which SQL on whole tables can't
    express or not in reasonable time; tests/llm compares them with brute force, round trips and held-out rows."""
    return {"op12_hard_negatives": _HARD_NEGATIVES}
