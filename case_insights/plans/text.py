"""Predicting the outcome from the narrative."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, NaiveBayes
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import (
    IDF,
    HashingTF,
    NGram,
    OneHotEncoder,
    RegexTokenizer,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from case_insights.functions.columns import two_decimals
from case_insights.functions.tokens import TOKEN_PATTERN
from case_insights.operators.complement_nb import complement_nb
from case_insights.plans.trends import MONETARY, NON_MONETARY
from case_insights.sources.schema import NARRATIVE, RESPONSE


def training_set(
    c: DataFrame, responses: tuple[str, str] = (MONETARY, NON_MONETARY), keep: Sequence[str] = ()
) -> DataFrame:
    """(id, narrative, label, *keep): cases with a narrative that were closed with one of the two
    responses; label 1 for the first."""
    chosen = F.col(RESPONSE).isin(list(responses)) & F.col(NARRATIVE).isNotNull()
    label = (F.col(RESPONSE) == responses[0]).cast("double").alias("label")
    return c.filter(chosen).select("id", NARRATIVE, label, *keep)


def _draw(seed: int) -> Column:
    """A fixed pseudo-random hex text per row and seed. Unlike rand(), it is the same when a task runs
    again on other partitions."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")))


def random_narrative(t: DataFrame, n: int = 1, seed: int = 0) -> DataFrame:
    """``n`` narratives drawn at random, the same ones for the same seed."""
    texts = t.filter(F.col(NARRATIVE).isNotNull()).select("id", NARRATIVE)
    # Only ids are ordered; texts are fetched for those drawn. An id that repeats may bring more rows.
    drawn = texts.select("id").orderBy(_draw(seed), "id").limit(n)
    return texts.join(F.broadcast(drawn.distinct()), "id", "left_semi").orderBy(_draw(seed), "id").limit(n)


def _bucket(seed: int) -> Column:
    return F.conv(F.substring(_draw(seed), 1, 8), 16, 10).cast("bigint")


def fold_of(folds: int, seed: int = 0) -> Column:
    """The fold of a row, by a hash of its id."""
    return (_bucket(seed) % folds).cast("int")


def held_out(t: DataFrame, percent: int = 20, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, test), split by a hash of the id."""
    part = _bucket(seed) % 100
    return t.filter(part >= percent), t.filter(part < percent)


def _stages(
    vectorizer: str, classifier: str, categories: Sequence[str], features: int, iterations: int
) -> list:
    words = RegexTokenizer(
        inputCol=NARRATIVE, outputCol="words", pattern=TOKEN_PATTERN, gaps=False, toLowercase=True
    )
    out = "text" if categories else "features"
    if vectorizer == "hashing":
        text = [HashingTF(inputCol="words", outputCol=out, numFeatures=features)]
    elif vectorizer == "tfidf":
        text = [
            HashingTF(inputCol="words", outputCol="tf", numFeatures=features),
            IDF(inputCol="tf", outputCol=out),
        ]
    elif vectorizer == "bigram":
        text = [
            NGram(inputCol="words", outputCol="grams", n=2),
            HashingTF(inputCol="grams", outputCol=out, numFeatures=features),
        ]
    else:
        raise ValueError(f"unknown vectorizer {vectorizer!r}")
    extra = []
    if categories:
        numbers = [f"{c}_index" for c in categories]
        flags = [f"{c}_flags" for c in categories]
        extra = [
            StringIndexer(inputCols=list(categories), outputCols=numbers, handleInvalid="keep"),
            OneHotEncoder(inputCols=numbers, outputCols=flags, handleInvalid="keep"),
            VectorAssembler(inputCols=["text", *flags], outputCol="features"),
        ]
    if classifier == "complement_nb":
        model = NaiveBayes(modelType="complement", smoothing=1.0)
    elif classifier == "linear_svm":
        model = LinearSVC(maxIter=iterations, regParam=0.01)
    else:
        raise ValueError(f"unknown classifier {classifier!r}")
    return [words, *text, *extra, model]


def fit_text(
    train: DataFrame,
    vectorizer: str = "hashing",
    classifier: str = "complement_nb",
    categories: Sequence[str] = (),
    features: int = 1 << 18,
    iterations: int = 20,
    max_rows: int | None = None,
) -> PipelineModel:
    """Fit vectorizer and classifier on (narrative, label) and the category columns named.

    Every token counts: they are hashed into ``features``, which bounds the model's size. Without such
    a bound ``complement_nb`` in the operators keeps all tokens apart. ``iterations`` and ``max_rows``
    are for the linear SVM, an iterative fit: it sees all rows, or the ``max_rows`` with the smallest
    hash of the id. Save the model with ``model.write().overwrite().save(path)`` and load it with
    ``PipelineModel.load(path)``.
    """
    stages = _stages(vectorizer, classifier, categories, features, iterations)
    if max_rows and classifier == "linear_svm":
        train = train.orderBy(_draw(0), "id").limit(max_rows)
    return Pipeline(stages=stages).fit(train)


def score(model: PipelineModel, t: DataFrame) -> DataFrame:
    """(id, prediction, prob_max in percent, its text with two decimals), plus label where ``t`` has
    one, for every row; a null text scores like an empty one. A classifier without probabilities gives
    only the prediction."""
    scored = model.transform(t.withColumn(NARRATIVE, F.coalesce(NARRATIVE, F.lit(""))))
    columns = ["id", *(["label"] if "label" in t.columns else []), "prediction"]
    if "probability" not in scored.columns:
        return scored.select(*columns)
    best = F.array_max(vector_to_array("probability")) * 100
    return scored.select(*columns, best.alias("prob_max")).withColumn(
        "prob_text", two_decimals(F.col("prob_max"))
    )


def score_narratives(train: DataFrame, t: DataFrame, buckets: int = 1 << 18) -> DataFrame:
    """(id, prediction, prob_max, prob_text) for every row of ``t``: complement naive Bayes over hashed
    tokens, as joins and aggregates."""
    scored = complement_nb(train, t, buckets=buckets)
    return scored.withColumn("prob_text", two_decimals(F.col("prob_max")))


def evaluate(scored: DataFrame) -> DataFrame:
    """One row: accuracy and the recall of each class, which tells more when classes are uneven."""
    right = F.col("prediction") == F.col("label")

    def recall(c):
        return F.avg(F.when(F.col("label") == c, right.cast("double")))

    return scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(right.cast("double")).alias("accuracy"),
        recall(0.0).alias("recall_0"),
        recall(1.0).alias("recall_1"),
    )


# (category columns used beside the text, vectorizer, classifier)
COMBINATIONS = tuple(
    ((), vectorizer, classifier)
    for vectorizer in ("hashing", "tfidf", "bigram")
    for classifier in ("complement_nb", "linear_svm")
)


def compare_models(
    train: DataFrame,
    combinations: Sequence[tuple[Sequence[str], str, str]] = COMBINATIONS,
    folds: int = 3,
    parallelism: int = 4,
    features: int = 1 << 18,
    iterations: int = 20,
) -> DataFrame:
    """(feature_set, vectorizer, classifier, accuracy): cross-validated accuracy of each combination,
    best first. Folds come from a hash of the id, so they stay the same when tasks run again."""
    pipeline = Pipeline(stages=[])
    grid = ParamGridBuilder().addGrid(
        pipeline.stages,
        [_stages(v, c, f, features, iterations) for f, v, c in combinations],
    )
    fitted = CrossValidator(
        estimator=pipeline,
        estimatorParamMaps=grid.build(),
        evaluator=MulticlassClassificationEvaluator(metricName="accuracy"),
        numFolds=folds,
        foldCol="fold",
        parallelism=parallelism,
    ).fit(train.withColumn("fold", fold_of(folds)))
    rows = [
        ("+".join(["text", *f]), v, c, float(a))
        for (f, v, c), a in zip(combinations, fitted.avgMetrics)
    ]
    return train.sparkSession.createDataFrame(
        rows, "feature_set string, vectorizer string, classifier string, accuracy double"
    ).orderBy(F.desc("accuracy"), "feature_set", "vectorizer", "classifier")
