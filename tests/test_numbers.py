"""Numbers against independent computations."""

import math
import random
import time
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.stat import ChiSquareTest
from pyspark.sql import functions as F

from case_insights.functions.chi2_tail import upper_gamma
from case_insights.operators.chi2 import chi2
from case_insights.operators.complement_nb import complement_nb, token_counts
from case_insights.operators.contingency import contingency, expected, pair_cells
from case_insights.operators.fisher import fisher_exact
from case_insights.plans import text, trends
from case_insights.plans.comparison import FEATURE_SETS, _keyed, compare_feature_sets, tune_smoothing
from case_insights.sources.schema import NARRATIVE, RESPONSE
from case_insights.sources.star import star_complaints, star_narratives

SF = "/root/testdata/sf0.001"


def test_category_trend_is_pandas_pivot_fill_rolling(spark):
    c = star_complaints(spark, SF, ["date_received", RESPONSE])
    ours = trends.category_trend(c, RESPONSE).toPandas()
    raw = c.dropna().groupBy("date_received", RESPONSE).count().toPandas()
    wide = raw.pivot(index="date_received", columns=RESPONSE, values="count").fillna(0)
    theirs = wide.sort_index().rolling(window=30).mean()
    got = ours.pivot(index="date_received", columns="category", values="mva").sort_index()
    pd.testing.assert_frame_equal(got.astype(float), theirs, check_names=False)


def test_chi2_is_the_ml_test_over_raw_rows(spark):
    c = star_complaints(spark, SF, ["submitted_via", RESPONSE]).dropna()
    ours = chi2(pair_cells(c, "submitted_via", RESPONSE)).first()
    indexed = StringIndexer(
        inputCols=["submitted_via", RESPONSE], outputCols=["x", "y"]
    ).fit(c).transform(c)
    vector = VectorAssembler(inputCols=["x"], outputCol="f").transform(indexed)
    theirs = ChiSquareTest.test(vector, "f", "y", flatten=True).first()
    assert ours.statistic == pytest.approx(theirs.statistic, rel=1e-10)
    assert ours.dof == theirs.degreesOfFreedom
    assert ours.p_value == pytest.approx(theirs.pValue, rel=1e-9)


def test_sparse_chi2_is_the_dense_one(spark):
    rng = random.Random(5)
    data = [(f"r{rng.randrange(9)}", f"c{rng.randrange(7)}") for _ in range(60)]
    cells = pair_cells(spark.createDataFrame(data, "a string, b string"), "a", "b")
    o = pd.crosstab(pd.Series([a for a, _ in data]), pd.Series([b for _, b in data]))
    m = o.to_numpy(dtype=float)
    e = m.sum(1, keepdims=True) * m.sum(0) / m.sum()
    assert (m == 0).any()
    assert chi2(cells).first().statistic == pytest.approx(((m - e) ** 2 / e).sum(), rel=1e-12)
    assert chi2(contingency(cells, dense=True)).first().statistic == pytest.approx(((m - e) ** 2 / e).sum(), rel=1e-12)
    assert [r.expected for r in expected(cells, dense=True).collect()] == pytest.approx(list(e.ravel()))


@pytest.mark.parametrize("m", [[[12, 5], [7, 9]], [[0, 5], [7, 9]], [[4, 4], [4, 4]]])
def test_yates(spark, m):
    cells = spark.createDataFrame(
        [(f"r{i}", f"c{j}", m[i][j]) for i in range(2) for j in range(2)], "row string, col string, n bigint"
    )
    o = np.array(m, dtype=float)
    e = o.sum(1, keepdims=True) * o.sum(0) / o.sum()
    dev = np.abs(o - e)
    corrected = ((dev - np.minimum(0.5, dev)) ** 2 / e).sum()
    got = chi2(cells).first()
    assert got.statistic == pytest.approx(corrected, abs=1e-12)
    assert got.p_value == pytest.approx(math.erfc(math.sqrt(corrected / 2)), rel=1e-10)
    assert chi2(cells, yates=False).first().statistic == pytest.approx(((o - e) ** 2 / e).sum(), abs=1e-12)


@pytest.mark.parametrize("a", [0.5, 1, 3, 24, 1188, 47_000])
@pytest.mark.parametrize("ratio", [0.2, 0.9, 1.0, 1.1, 3])
def test_gamma_tail(a, ratio):
    """Against the integral of the density, by Simpson's rule on a fine grid."""
    x = a * ratio
    if a == 0.5:
        assert upper_gamma(a, x) == pytest.approx(math.erfc(math.sqrt(x)), rel=1e-12)
        return
    sd = math.sqrt(a)
    top = max(x, a) + 40 * sd + 40
    t = np.linspace(x, top, 400_001)
    y = np.exp((a - 1) * np.log(t) - t - math.lgamma(a))
    h = t[1] - t[0]
    area = h / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())
    assert upper_gamma(a, x) == pytest.approx(area, rel=1e-6, abs=1e-12)


def _fisher_by_lgamma(a, b, c, d):
    f = lambda m: math.lgamma(m + 1)
    fixed = f(a + b) + f(c + d) + f(a + c) + f(b + d) - f(a + b + c + d)
    mass = lambda k: fixed - f(k) - f(a + b - k) - f(a + c - k) - f(d - a + k)
    seen = mass(a) + 1e-7
    points = map(mass, range(max(0, a - d), min(a + b, a + c) + 1))
    return sum(math.exp(p) for p in points if p <= seen)


@pytest.mark.parametrize(
    "t", [(3349, 3301, 9975, 9777), (3, 17, 40, 900), (50, 1, 300_000, 9_000), (1000, 900, 1000, 1100), (15, 16, 17, 14)]
)
def test_fisher_is_the_sum_over_all_tables(spark, t):
    df = spark.createDataFrame(
        [("Monetary", t[0], t[1]), ("Non-Monetary", t[2], t[3])], "relief string, false_n bigint, true_n bigint"
    )
    got = fisher_exact(df).first()
    assert got.p_value == pytest.approx(_fisher_by_lgamma(*t), rel=1e-7)
    assert got.odds_ratio == pytest.approx(t[0] * t[3] / t[1] / t[2])


def test_fisher_of_many_rows_is_near_the_normal_limit(spark):
    """Twenty billion cases: the support is far too large to list, and the test still answers."""
    n = 5_000_000_000
    df = spark.createDataFrame(
        [("Monetary", n + 70_000, n), ("Non-Monetary", n, n + 70_000)],
        "relief string, false_n bigint, true_n bigint",
    )
    got = fisher_exact(df).first()
    z = 35_000 / math.sqrt(4 * n / 16)
    assert got.p_value == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-3)


def _texts(spark):
    words = "refund fee loan card late paid bank error letter agent".split()
    rng = random.Random(7)
    data = []
    for i in range(60):
        label = float(i % 3 == 0)
        pool = words[:7] if label else words[3:]
        data.append((i, " ".join(rng.choice(pool) for _ in range(rng.randrange(1, 12))), label))
    return spark.createDataFrame(data, f"id bigint, {NARRATIVE} string, label double")


def test_complement_nb_is_the_formula_and_the_ml_model(spark):
    train = _texts(spark)
    extra = spark.createDataFrame(
        [(1000, "zzz unseen"), (1001, ""), (1002, None), (1003, "refund refund zzz loan")], f"id bigint, {NARRATIVE} string"
    )
    texts = train.select("id", NARRATIVE).union(extra)
    ours = {r.id: r for r in complement_nb(train, texts).collect()}
    counts = {0.0: Counter(), 1.0: Counter()}
    for r in train.collect():
        counts[r.label].update(r[NARRATIVE].split())
    v = set(counts[0.0]) | set(counts[1.0])
    for r in texts.collect():
        score = []
        for c in (0.0, 1.0):
            other = counts[1 - c]
            size = sum(other.values()) + len(v)
            score.append(sum(-math.log((other[w] + 1) / size) for w in (r[NARRATIVE] or "").split() if w in v))
        best = max(score)
        prob = 100 / sum(math.exp(s - best) for s in score)
        assert ours[r.id].prediction == float(score[1] > score[0])
        assert ours[r.id].prob_max == pytest.approx(prob)
    ml = {r.id: r for r in text.score(text.fit_text(train), texts).collect()}
    assert ml.keys() == ours.keys() and ml[1002].prob_max == ml[1001].prob_max


@pytest.mark.parametrize("share", [0.0, 0.02, 0.2, 2.0])
def test_the_split_of_the_vocabulary_changes_nothing(spark, share):
    t = star_narratives(spark, SF)
    train = text.training_set(t)
    whole = complement_nb(train, t).toPandas().set_index("id").sort_index()
    split = complement_nb(train, t, frequent_share=share).toPandas().set_index("id").sort_index()
    assert (whole.prediction == split.prediction).all()
    np.testing.assert_allclose(whole.prob_max, split.prob_max, rtol=1e-9)


def test_repeated_texts_and_ids_keep_their_scores(spark):
    train = _texts(spark)
    texts = spark.createDataFrame([(1, "refund fee"), (1, "refund fee"), (2, "refund fee"), (3, None), (3, None)], f"id bigint, {NARRATIVE} string")
    one = complement_nb(train, texts.limit(1)).first().prob_max
    got = complement_nb(train, texts).collect()
    assert sorted(r.id for r in got) == [1, 1, 2, 3, 3]
    assert all(r.prob_max == pytest.approx(one if r.id < 3 else 50.0) for r in got)


def test_few_buckets_share_tokens(spark):
    train = _texts(spark)
    got = complement_nb(train, train, buckets=1).collect()
    assert len({r.prediction for r in got}) == 1
    same = {r.id: r.prob_max for r in complement_nb(train, train, buckets=1 << 30).collect()}
    assert all(same[r.id] == pytest.approx(r.prob_max) for r in complement_nb(train, train).collect())


def test_no_training_rows(spark):
    train = _texts(spark)
    assert {(r.prediction, r.prob_max) for r in complement_nb(train.limit(0), train).collect()} == {(0.0, 50.0)}


def test_linear_svm_reaches_the_least_objective(spark):
    """Against subgradient descent on the same objective, with classes that overlap, and on separable data."""
    flipped = F.when(F.col("id") % 4 == 1, 1 - F.col("label")).otherwise(F.col("label"))
    train = _texts(spark).withColumn("label", flipped)
    model = text.fit_text(train, "hashing", "linear_svm", features=64, iterations=200)
    hashed = model.stages[1].transform(model.stages[0].transform(train)).select("features", "label").collect()
    x, y = np.array([r.features.toArray() for r in hashed]), np.array([2 * r.label - 1 for r in hashed])
    svm = model.stages[-1]
    scale = x.std(0, ddof=1)
    scale[scale == 0] = 1  # the penalty is on standardised features

    def objective(w, b):
        return np.maximum(0, 1 - y * (x @ w + b)).mean() + 0.005 * ((w * scale) ** 2).sum()

    z, w, b, best = x / scale, np.zeros(64), 0.0, 9.0
    for i in range(1, 60_001):
        bad = y * (z @ w + b) < 1
        w -= (0.01 * w - (y[bad] @ z[bad]) / len(y)) / (0.01 * i + 1)
        b += y[bad].sum() / len(y) / (0.01 * i + 1)
        if i % 100 == 0:
            best = min(best, objective(w / scale, b))
    assert objective(svm.coefficients.toArray(), svm.intercept) <= 1.01 * best
    apart = spark.createDataFrame([(i, "refund loan" if i % 2 else "agent letter", float(i % 2)) for i in range(40)], train.schema)
    scored = text.score(text.fit_text(apart, classifier="linear_svm"), apart).collect()
    assert all(r.prediction == r.label for r in scored)
    assert text.fit_text(apart, classifier="linear_svm", max_rows=10).stages[-1].numFeatures == 1 << 18


def test_held_out_is_a_partition(spark):
    t = _texts(spark)
    train, test = text.held_out(t, 30)
    ids = lambda df: {r.id for r in df.collect()}
    assert not ids(train) & ids(test) and ids(train) | ids(test) == ids(t)
    assert ids(text.held_out(t.repartition(7), 30)[1]) == ids(test)


def test_evaluate(spark):
    scored = spark.createDataFrame(
        [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 1.0)], "label double, prediction double"
    )
    assert tuple(text.evaluate(scored).first()) == (4, 0.75, 0.5, 1.0)


def test_training_set(spark):
    data = [(1, "x", trends.MONETARY), (2, "y", trends.NON_MONETARY), (3, "z", "Closed"), (4, None, trends.MONETARY), (5, "w", None)]
    c = spark.createDataFrame(data, f"id bigint, {NARRATIVE} string, {RESPONSE} string")
    assert sorted(tuple(r) for r in text.training_set(c).collect()) == [(1, "x", 1.0), (2, "y", 0.0)]


def test_compare_models_covers_every_combination(spark):
    combos = [((), "tfidf", "complement_nb"), ((), "hashing", "complement_nb"), ((), "bigram", "linear_svm")]
    got = text.compare_models(_texts(spark), combos, folds=2, features=256, iterations=3)
    assert {(r.vectorizer, r.classifier) for r in got.collect()} == {c[1:] for c in combos}
    assert all(0 <= r.accuracy <= 1 for r in got.collect())


def test_a_long_text_costs_in_proportion(spark):
    def seconds(words):
        train = spark.range(1).selectExpr(
            "id", "1.0D AS label", "'k' AS kind", f"concat_ws(' ', transform(sequence(1, {words}), i -> concat('w', i % 5000))) AS {NARRATIVE}"
        )
        best = []
        for _ in range(3):
            start = time.time()
            assert _keyed(train, "kind", 3, 1 << 18).selectExpr("sum(size(pairs))").first()[0] == words - 1
            best.append(time.time() - start)
        return min(best)

    seconds(100)
    short, long = seconds(8_000), seconds(80_000)  # with a step for each pair of words, 100 times as long
    assert long < 25 * short


def test_smoothing_values_are_scored_as_one_by_one(spark):
    train = _texts(spark).withColumn("kind", F.lit("k"))
    grid = tune_smoothing(train, "kind", (0.25, 1.0, 4.0)).collect()
    assert len(grid) == 12
    for a in (0.25, 1.0, 4.0):
        alone = {r.feature_set: r.accuracy for r in compare_feature_sets(train, "kind", smoothing=a).collect()}
        assert alone == {r.feature_set: r.accuracy for r in grid if r.smoothing == a}
    with pytest.raises(ValueError):
        tune_smoothing(train, "kind", buckets=1 << 20)


def test_texts_are_cut_once_for_all_counts_and_scores(spark, tmp_path, monkeypatch):
    from case_insights.sources import scratch

    monkeypatch.setattr(scratch, "scratch_dir", lambda spark, name: str(tmp_path / name))
    grid = tune_smoothing(_texts(spark).withColumn("kind", F.lit("k")), "kind", (0.5, 1.0))
    assert [p.name for p in tmp_path.iterdir()] == ["accuracies"]  # the rows' buckets and their counts are gone
    plan = grid._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and NARRATIVE not in plan
    assert grid.count() == 8


def test_scores_keep_no_row_for_each_text_and_token(spark):
    """Aggregates are by token, or by text; rare words that a text repeats count as often as they occur."""
    rows = [(i, f"common rare{i % 5} rare{i % 5} odd{i} odd{i} odd{i}", float(i % 2)) for i in range(60)]
    train = spark.createDataFrame(rows, f"id long, {NARRATIVE} string, label double")
    split = complement_nb(train, train, frequent_share=0.1)
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    by = [x.split("]")[0] for x in plan.split("Aggregate [")[1:]]
    assert by and not any("_groupingexpression" in x or ("h1#" in x and x.count("#") > 2) for x in by)
    whole = {r.id: (r.prediction, pytest.approx(r.prob_max)) for r in complement_nb(train, train, frequent_share=0.0).collect()}
    assert {r.id: (r.prediction, r.prob_max) for r in split.collect()} == whole


def test_counts_by_bucket_serve_joins_and_totals_alike(spark):
    """A key that may be null would get a filter below the counts in a join, so that totals count a second time."""
    train = _texts(spark)
    assert not any(f.nullable for f in token_counts(train, (0.0, 1.0), buckets=64).schema if f.name in ("h1", "h2"))


def test_feature_sets_count_repeated_rows(spark):
    train = _texts(spark).withColumn("kind", F.lit("k"))
    once = {r.feature_set: r.accuracy for r in compare_feature_sets(train, "kind").collect()}
    twice = {r.feature_set: r.accuracy for r in compare_feature_sets(train.union(train), "kind").collect()}
    assert once.keys() == set(FEATURE_SETS) == twice.keys()
    assert once["unigram"] > 0.6 and all(0 < a <= 1 for a in twice.values())


def test_chi2_of_a_sparse_table_with_large_counts(spark):
    """Two cells that don't occur; the exact statistic by whole numbers."""
    from fractions import Fraction

    n = [[50_000_000_000_000, 1, 0], [1, 50_000_000_000_000, 1], [0, 1, 50_000_000_000_000]]
    rows, cols = [sum(r) for r in n], [sum(c) for c in zip(*n)]
    total = sum(rows)
    exact = sum(Fraction((n[i][j] * total - rows[i] * cols[j]) ** 2, rows[i] * cols[j] * total) for i in range(3) for j in range(3))
    cells = spark.createDataFrame([(f"r{i}", f"c{j}", n[i][j]) for i in range(3) for j in range(3)], "row string, col string, n long")
    assert chi2(cells).first().statistic == pytest.approx(float(exact), rel=1e-9)
    # large expected counts for two empty cells beside a full table
    tiny = [(0, 0, 10**14), (0, 1, 10**7), (1, 0, 10**7), (1, 2, 1), (2, 1, 1), (0, 2, 10**7), (2, 0, 10**7)]
    grid = {(i, j): v for i, j, v in tiny}
    rows, cols = ([sum(v for k, v in grid.items() if k[a] == x) for x in range(3)] for a in (0, 1))
    total = sum(rows)
    missing = float(sum(Fraction(rows[i] * cols[j], total) for i in range(3) for j in range(3) if (i, j) not in grid))
    covered = sum(rows[i] * cols[j] for i, j in grid)
    assert (total * total - covered) / total == pytest.approx(missing, rel=1e-9)


def test_wide_trends_have_every_category_or_fail(spark):
    from case_insights.operators.reshape import to_wide

    long = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "c", 3.0)], "k int, x string, v double")
    assert to_wide(long, "k", "x", "v").columns == ["k", "a", "b", "c"]
    assert to_wide(long, "k", "x", "v", ["c", "b", "a"]).columns == ["k", "c", "b", "a"]
    with pytest.raises(Exception, match="category not listed"):
        to_wide(long, "k", "x", "v", ["a", "b"]).collect()


def test_random_narrative_is_repeatable(spark):
    t = _texts(spark)
    one = text.random_narrative(t, 3, seed=4).collect()
    assert one == text.random_narrative(t.repartition(5), 3, seed=4).collect()
    assert one != text.random_narrative(t, 3, seed=5).collect()
    assert text.random_narrative(t.withColumn(NARRATIVE, F.lit(None).cast("string"))).count() == 0
