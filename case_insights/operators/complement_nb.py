"""Complement naive Bayes over word counts, as joins and aggregates.

For class c, token weight is ln(T_c + alpha V) - ln(t_c + alpha), where t_c counts the token in the
other classes, T_c is the sum of t_c over the V tokens, and a text's score for c adds the weights of
its known tokens. So per token only ln(t_c + alpha) has to meet the texts.

Tokens go by two 64-bit hashes with different seeds, or with ``buckets`` by one of that many buckets,
which tokens may share.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from case_insights.functions.tokens import bucket, tokens
from case_insights.sources.schema import NARRATIVE

KEY = ["h1", "h2"]
TEXT = ["t1", "t2"]


def _hashes(text: Column, seed: int = 0) -> Column:
    return F.struct(F.xxhash64(F.lit(seed), text).alias("h1"), F.xxhash64(F.lit(seed + 1), text).alias("h2"))


def _keys(text: Column, buckets: int | None) -> Column:
    """One key for each token of the text."""
    if buckets:
        return F.transform(tokens(text), lambda t: F.struct(bucket(t, buckets).alias("h1"), F.lit(0).cast("long").alias("h2")))
    return F.transform(tokens(text), lambda t: _hashes(t))


def token_counts(train: DataFrame, classes: Sequence[float], buckets: int | None = None) -> DataFrame:
    """(h1, h2, n0, n1, ...): occurrences of each token in each class. Counts are combined before the
    shuffle, so a token that is everywhere costs one row per task."""
    words = train.select("label", F.explode(_keys(F.col(NARRATIVE), buckets)).alias("key")).select("label", "key.*")
    return words.groupBy(*KEY).agg(
        *(F.count_if(F.col("label") == c).alias(f"n{i}") for i, c in enumerate(classes))
    )


@dataclass(frozen=True)
class TokenModel:
    """What is learnt: the counts of each token, and their totals ``v``, ``seen``, ``n0``, ``n1``, ... as one struct."""

    counts: DataFrame
    totals: Column
    classes: tuple[float, ...]
    smoothing: float
    buckets: int | None


def _totals(counts: DataFrame, classes: Sequence[float]) -> Column:
    index = range(len(classes))
    return F.struct(
        F.count(F.lit(1)).alias("v"),
        F.coalesce(F.sum(sum(F.col(f"n{i}") for i in index)), F.lit(0)).alias("seen"),
        *(F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"n{i}") for i in index),
    )


def learn(
    train: DataFrame, classes: Sequence[float] = (0.0, 1.0), smoothing: float = 1.0, buckets: int | None = None
) -> TokenModel:
    """A model of the texts and labels of ``train``. Lazy: it is worked out with each use, unless saved."""
    counts = token_counts(train, classes, buckets)
    return TokenModel(counts, counts.agg(_totals(counts, classes)).scalar(), tuple(classes), smoothing, buckets)


def save_model(model: TokenModel, path: str, parts: int = 200) -> None:
    """Write a model to a folder: the counts as a table in ``parts`` buckets by token, so that later scoring reads
    them without a shuffle, and a row with the rest. An existing model there is replaced."""
    spark = model.counts.sparkSession
    name = f"token_counts_{uuid.uuid4().hex}"
    writer = model.counts.repartition(parts, *KEY).write.mode("overwrite").format("parquet")
    writer.bucketBy(parts, *KEY).sortBy(*KEY).option("path", f"{path}/counts").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay, as they lie at a path of their own
    stored = spark.read.schema(model.counts.schema).parquet(f"{path}/counts")
    stored.agg(
        _totals(stored, model.classes).alias("totals"),
        F.lit(parts).alias("parts"), F.lit(float(model.smoothing)).alias("smoothing"),
        F.lit(model.buckets).cast("long").alias("buckets"), F.array(*(F.lit(float(c)) for c in model.classes)).alias("classes"),
    ).write.mode("overwrite").parquet(f"{path}/model")


def load_model(spark: SparkSession, path: str) -> TokenModel:
    """A model that ``save_model`` wrote, also in another session. Its table is registered for this session."""
    row = spark.read.parquet(f"{path}/model").first()
    columns = ", ".join(f"{c} BIGINT" for c in [*KEY, *(f"n{i}" for i in range(len(row.classes)))])
    name = f"token_counts_{uuid.uuid4().hex}"
    by = ", ".join(KEY)
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {row.parts} BUCKETS "
        f"LOCATION '{path}/counts'"
    )
    totals = F.struct(*(F.lit(v).alias(k) for k, v in row.totals.asDict().items()))
    return TokenModel(spark.table(name), totals, tuple(row.classes), row.smoothing, row.buckets)


def complement_nb(
    train: DataFrame,
    texts: DataFrame,
    classes: Sequence[float] = (0.0, 1.0),
    smoothing: float = 1.0,
    buckets: int | None = None,
    frequent_share: float = 1e-5,
) -> DataFrame:
    """``score_texts`` with a model learnt from ``train``. Lazy."""
    return score_texts(learn(train, classes, smoothing, buckets), texts, frequent_share)


def score_texts(model: TokenModel, texts: DataFrame, frequent_share: float = 1e-5) -> DataFrame:
    """(id, prediction, prob_max in percent) for every row of ``texts``. Lazy.

    Each distinct text is scored once and joined back to its rows, so ids need not be unique, and a
    null text scores like an empty one. Equal scores go to the earlier class.

    Tokens that make up ``frequent_share`` of all tokens seen or more are broadcast: there are at most
    1 / frequent_share of them, of fixed size. Texts add them up where they are read. Of what is left, each
    occurrence meets the other weights as a row of four numbers, and nothing is kept for each pair of a text
    and a token. A key that many texts have and training hardly has is left to adaptive skew splitting.
    Likewise the scores of texts that make up ``frequent_share`` of the rows or more are broadcast to them.
    """
    counts, totals, smoothing = model.counts, model.totals, F.lit(model.smoothing)
    index = range(len(model.classes))
    seen = sum(F.col(f"n{i}") for i in index)
    weights = counts.select(
        *KEY, seen.alias("seen"), F.lit(1).alias("hit"),
        *(F.log(seen - F.col(f"n{i}") + smoothing).alias(f"w{i}") for i in index),
    )
    frequent = F.lit(frequent_share) * totals["seen"]
    near, far = weights.filter(F.col("seen") >= frequent), weights.filter(F.col("seen") < frequent)

    text = F.coalesce(F.col(NARRATIVE), F.lit(""))
    named = texts.select("id", _hashes(text, 2).alias("text_key"), text.alias(NARRATIVE)).select("id", "text_key.*", NARRATIVE)
    named = named.withColumnsRenamed(dict(zip(KEY, TEXT)))
    distinct = named.groupBy(*TEXT).agg(F.first(NARRATIVE).alias(NARRATIVE), F.count(F.lit(1)).alias("copies"))
    keys = _keys(F.col(NARRATIVE), model.buckets)
    own = [*TEXT, "copies"]
    words = distinct.select(*own, F.explode_outer(keys).alias("key")).select(*own, "key.*")
    added = [F.count("hit").alias("known"), *(F.coalesce(F.sum(f"w{i}"), F.lit(0.0)).alias(f"w{i}") for i in index)]
    frequently = words.join(F.broadcast(near), KEY, "left").groupBy(*own).agg(*added)
    rare = distinct.select(*own, F.explode(keys).alias("key")).select(*own, "key.*")
    rare = rare.join(F.broadcast(near.select(*KEY)), KEY, "left_anti")
    rarely = rare.join(far, KEY).groupBy(*own).agg(*added)
    sums = frequently.unionByName(rarely).groupBy(*own).agg(*(F.sum(c).alias(c) for c in ("known", *(f"w{i}" for i in index))))
    scores = sums.select(
        *TEXT, "copies",
        *(
            F.when(totals["v"] == 0, 0.0)
            .otherwise(
                F.col("known") * F.log(totals["seen"] - totals[f"n{i}"] + smoothing * totals["v"])
                - F.col(f"w{i}")
            )
            .alias(f"s{i}")
            for i in index
        ),
    )
    many = F.lit(frequent_share) * texts.agg(F.count(F.lit(1))).scalar()
    return _to_rows(named.select("id", *TEXT), _decide(scores, model.classes), many)


def _to_rows(named: DataFrame, decided: DataFrame, many: Column) -> DataFrame:
    """The scores of each text for all of its rows. Those of texts with ``many`` rows are broadcast."""
    often = (F.col("copies") >= many) & (F.col("copies") > 1)
    near = decided.filter(often).select(*TEXT, F.col("prediction").alias("p"), F.col("prob_max").alias("m"))
    far = decided.filter(~often).select(F.struct(*TEXT).alias("rest"), "prediction", "prob_max")
    met = named.join(F.broadcast(near), TEXT, "left")
    # rows that are served have no partner left; their ids spread them
    other = _hashes(F.col("id").cast("string"), 4)
    met = met.withColumn("rest", F.when(F.col("p").isNull(), F.struct(*TEXT)).otherwise(F.struct(*(other[k].alias(t) for k, t in zip(KEY, TEXT)))))
    found = met.join(far, "rest", "left")
    return found.select("id", F.coalesce("p", "prediction").alias("prediction"), F.coalesce("m", "prob_max").alias("prob_max"))


def _decide(scores: DataFrame, classes: Sequence[float]) -> DataFrame:
    names = [f"s{i}" for i in range(len(classes))]
    best = F.greatest(*names)
    # Scores within rounding of each other count as equal.
    prediction = F.coalesce(
        *(F.when(F.col(s) >= best - 1e-9, F.lit(float(c))) for s, c in zip(names, classes))
    )
    odds = sum(F.exp(F.col(s) - best) for s in names)
    return scores.select(*TEXT, "copies", prediction.alias("prediction"), (100 / odds).alias("prob_max"))
