"""Corpus preparation: stages over ``documents``, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir) and judges the documents it is given; all but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from case_insights.llm.decontaminate import find_leaks
from case_insights.llm.entry import vocabulary_path
from case_insights.llm.jaccard import jaccard_components
from case_insights.llm.packing import pack_by_retrieval, special_tokens
from case_insights.llm.store import documents, saved
from case_insights.llm.substring import remove_repeats
from case_insights.llm.toxicity import fit_toxicity, toxicity_scores, training_rows
from case_insights.llm.wordpiece import byte_vocabulary


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7 stay. The model is fitted on labelled rows of ``docs``. Rows are judged one by
    one by their text: null ids and repeated rows keep their own, a null text scores as an empty one."""
    model = fit_toxicity(training_rows(docs, documents(spark, sf_dir, "labels")))
    return toxicity_scores(docs, model, keep=True).filter("score < 0.7").select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by four fifths of their five-word shingles, the one with the smallest doc_id stays;
    documents without words stay, as they are linked with nothing, and so do rows without doc_id. Rows of one doc_id
    are one document here: they stay or go together."""
    drop = jaccard_components(docs, k=5, percent=80).filter("doc_id <> component_id").select("doc_id")
    return docs.join(drop, "doc_id", "left_anti").select(docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose passages that stand in an earlier document; n_chars follows. Texts without one are unchanged.
    A null text stays null."""
    cut = remove_repeats(docs, keep=True)
    changed = F.col("n_removed") > 0
    return cut.withColumns({
        "text": F.when(changed, F.col("kept")).otherwise(F.col("text")),
        "n_chars": F.when(changed, F.length("kept").cast("long")).otherwise(F.col("n_chars")),
    }).select(docs.columns)


def reject_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item stay. Each row is judged by its own text, also with a null or repeated
    doc_id; a null or empty text holds nothing."""
    key = F.xxhash64("doc_id", "text")
    keyed = docs.select(key.alias("doc_id"), "text")
    leaks = find_leaks(keyed, documents(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("leak")).distinct()
    return docs.join(leaks, key == F.col("leak"), "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens, related documents together; a null text counts as empty."""
    path = vocabulary_path()
    return pack_by_retrieval(docs, byte_vocabulary(path), special=special_tokens(path))


STAGES = [
    ("toxicity", reject_toxic),
    ("n-gram Jaccard join", one_of_each_group),
    ("substring dedup", drop_repeated_passages),
    ("benchmark decontamination", reject_leaks),
    ("packing", pack),
]

# A fitted model, components and retrieval have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
