"""Feature sets and smoothing values of complement naive Bayes, cross-validated in one pass.

Terms go by hashed buckets, words and word pairs apart, so there is at most a row of fixed width for each bucket. Counts
are kept by fold; what a fold learns from are the counts of all others. A row of weights, of a bucket and fold, holds every
feature set and smoothing value; these are broadcast, and each text adds up its weights where it is read. So texts are read
and cut into buckets once, to a table that serves the counts and the scores, nothing is fitted again for another
smoothing value, and no join has a key that many texts share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from case_insights.functions.tokens import bucket, tokens
from case_insights.plans.text import fold_of
from case_insights.sources.schema import NARRATIVE
from case_insights.sources.scratch import removed, stored

MAX_BUCKETS = 1 << 19  # their rows are broadcast
_ROW = ["label", "fold", "row"]


def _keyed(train: DataFrame, category: str, folds: int, buckets: int) -> DataFrame:
    """Each row with the buckets of its words, of its word pairs (numbered on after those) and of its category."""
    text = F.coalesce(F.col(NARRATIVE), F.lit(""))
    named = [F.col("id").cast("string"), F.col("label"), text, F.col(category).cast("string")]
    row = F.struct(*(F.xxhash64(F.lit(seed), *(x for c in named for x in (c.isNull(), c))) for seed in (1, 2)))
    flag = F.concat_ws("=", F.lit(category), F.coalesce(F.col(category).cast("string"), F.lit("")))
    rows = train.select("label", fold_of(folds).alias("fold"), row.alias("row"), flag.alias("flag"), tokens(text).alias("words"))
    # a column used more than once is worked out once; within a lambda it would be once for each element
    before_last = F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0)))
    after_first = F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0)))
    return rows.select(
        *_ROW,
        F.transform("words", lambda t: bucket(t, buckets)).alias("words"),
        F.zip_with(before_last, after_first, lambda a, b: bucket(F.concat_ws(" ", a, b), buckets) + buckets).alias("pairs"),
        F.array(bucket(F.col("flag"), buckets)).alias("flags"),
    )


def _occurrences(keyed: DataFrame, buckets: int, *more: str) -> DataFrame:
    """A row for each bucket of words, of pairs and of the category that a row holds, with a 1 at what it is (term or
    flag), and for those of ``more``, SQL arrays of numbers. Numbers of 4 * buckets on are buckets of distinct words
    (holds), negative ones are no bucket (rows)."""
    two = 2 * buckets
    arrays = ["words", "pairs", f"transform(flags, k -> k + {two})", *more]
    marks = {"term": f"x >= 0 and x < {two}", "flag": f"x >= {two} and x < {2 * two}", "holds": f"x >= {2 * two}", "rows": "x < 0"}
    return keyed.selectExpr(*_ROW, f"explode(concat({', '.join(arrays)})) AS x").selectExpr(
        *_ROW, f"x % {two} AS key", *(f"if({there}, 1, 0) AS {n}" for n, there in marks.items())
    )


# of a bucket and fold: occurrences in words and pairs, and as a category, by label, and rows that hold the word
_MARKS = {"n0": "label = 0, term", "n1": "label = 1, term", "g0": "label = 0, flag", "g1": "label = 1, flag", "d": "true, holds"}


def _counts(keyed: DataFrame, folds: int, buckets: int) -> DataFrame:
    """(key, n0_0, n1_0, ..., n0_1, ...): the marks of each bucket in each fold."""
    seen = _occurrences(keyed, buckets, f"transform(array_distinct(words), k -> k + {4 * buckets})")
    return seen.groupBy("key").agg(
        *(F.expr(f"sum(if(fold = {f} and {what}, 0)) AS {n}_{f}") for f in range(folds) for n, what in _MARKS.items())
    )


def _learnt(counts: DataFrame, keyed: DataFrame, folds: int, buckets: int) -> DataFrame:
    """(key, fold) for each bucket that the rows outside the fold hold, and for each feature set how often an
    occurrence counts (k) and how much the bucket's occurrences in the other class, and in this one, add up to (t0,
    t1). A bucket is one of words or of pairs, so the sets of single words and of pairs share their columns."""
    others = (
        ", ".join([f"'fold', {f}", *(f"'{n}', 0L" + "".join(f" + {n}_{g}" for g in range(folds) if g != f) for n in _MARKS)])
        for f in range(folds)
    )
    by_fold = counts.selectExpr("key", "inline(array(" + ", ".join(f"named_struct({o})" for o in others) + "))")
    sizes = keyed.groupBy("fold").agg(F.count(F.lit(1)).alias("own"))
    rest = F.sum("own").over(Window.partitionBy()) - F.col("own")  # a row for each fold
    by_fold = by_fold.join(F.broadcast(sizes.select("fold", rest.alias("rows"))), "fold")
    word, known = f"key < {buckets}", "n0 + n1 > 0"
    sets = {
        "term": (known, "1.0D", ("n0", "n1")),
        "tfidf": (f"{word} and {known}", "ln((rows + 1.0D) / (d + 1.0D))", ("n0", "n1")),
        "category": (f"{word} and n0 + n1 + g0 + g1 > 0", "1.0D", ("n0 + g0", "n1 + g1")),
    }
    return by_fold.selectExpr(
        "key", "fold", *(f"if({there}, {k}, null) AS k_{s}" for s, (there, k, _) in sets.items()),
        *(f"if({there}, {k} * ({n[1 - c]}), null) AS t{c}_{s}" for s, (there, k, n) in sets.items() for c in (0, 1)),
    ).filter("k_term is not null or k_category is not null")


# of a feature set: its columns, which buckets it adds up, and what counts as an occurrence
_SETS = {
    "unigram": ("term", "<", "term"),
    "bigram": ("term", ">=", "term"),
    "tfidf": ("tfidf", "<", "term"),
    "unigram+category": ("category", "<", "term + flag"),
}
FEATURE_SETS = tuple(_SETS)


def tune_smoothing(
    train: DataFrame, category: str, smoothings: Sequence[float] = (0.1, 0.5, 1.0, 2.0), folds: int = 3, buckets: int = 1 << 18
) -> DataFrame:
    """(feature_set, smoothing, accuracy): complement naive Bayes, cross-validated, for each set of hashed features
    and each smoothing value, best first. ``train`` is (id, narrative, label 0 or 1, category). Worked out at once,
    with scratch tables of the buckets of each row and their counts, which are deleted, and of the accuracies.

    Folds come from a hash of the id. A null text is an empty one, a null category an empty one. Equal rows count as
    often as they occur. ``buckets`` is at most 2^19: weights are broadcast, a row for each fold and each bucket of
    words and pairs."""
    if buckets > MAX_BUCKETS:
        raise ValueError(f"at most {MAX_BUCKETS} buckets")
    keyed = stored(_keyed(train, category, folds, buckets), "keyed")
    counts = stored(_counts(keyed, folds, buckets), "bucket-counts")
    learnt = _learnt(counts, keyed, folds, buckets)
    sets, grid = list(enumerate(_SETS.values())), [(s, i) for s in range(len(_SETS)) for i in range(len(smoothings))]

    def of_set(s: int, column: str) -> str:
        columns, side, _ = sets[s][1]
        return f"if(key {side} {buckets}, {column}_{columns}, null)"

    totals = learnt.groupBy("fold").agg(
        *(F.expr(f"count({of_set(s, 'k')}) AS v{s}") for s, _ in sets),
        *(F.expr(f"sum({of_set(s, f't{c}')}) AS t{c}_{s}") for s, _ in sets for c in (0, 1)),
    )
    logs = totals.selectExpr(
        "fold", *(f"ln(t{c}_{s} + {float(smoothings[i])!r}D * v{s}) AS b{c}_{s}_{i}" for s, i in grid for c in (0, 1))
    )
    weights = learnt.selectExpr(
        "key", "fold", "k_term", "k_tfidf", "k_category",
        *(
            f"k_{s} * ln(t{c}_{s} + {float(a)!r}D) AS w{c}{i}_{s}"
            for s in ("term", "tfidf", "category") for c in (0, 1) for i, a in enumerate(smoothings)
        ),
    )
    # the mark of a row itself: it has no weights, and counts how many rows are equal in all
    terms = _occurrences(keyed, buckets, "array(-1L)")
    met = terms.join(F.broadcast(weights), ["key", "fold"], "left")
    sums = met.groupBy(*_ROW).agg(
        F.sum("rows").alias("m"),
        *(F.expr(f"coalesce(sum(({times}) * {of_set(s, 'k')}), 0D) AS k{s}") for s, (_, _, times) in sets),
        *(
            F.expr(f"coalesce(sum(({sets[s][1][2]}) * {of_set(s, f'w{c}{i}')}), 0D) AS s{c}_{s}_{i}")
            for s, i in grid for c in (0, 1)
        ),
    )
    scored = sums.join(F.broadcast(logs), "fold", "left")  # a row for each fold
    score = "coalesce((k{s} * b{c}_{s}_{i} - s{c}_{s}_{i}) / m, 0D)"
    by_fold = scored.groupBy("fold").agg(*(
        F.expr(
            f"sum(if(({score.format(s=s, i=i, c=1)} > {score.format(s=s, i=i, c=0)} + 1e-9D) = (label = 1), m, 0L)) / sum(m) AS a{s}_{i}"
        )
        for s, i in grid
    ))
    mean = stored(by_fold.agg(*(F.expr(f"avg(a{s}_{i}) AS a{s}_{i}") for s, i in grid)), "accuracies")
    removed(keyed, counts)
    names = list(_SETS)
    rows = ", ".join(
        f"named_struct('feature_set', '{names[s]}', 'smoothing', {float(smoothings[i])!r}D, 'accuracy', a{s}_{i})" for s, i in grid
    )
    best = mean.selectExpr(f"inline(array({rows}))").filter("accuracy is not null")
    return best.orderBy(F.desc("accuracy"), "feature_set", "smoothing")


def compare_feature_sets(
    train: DataFrame, category: str, folds: int = 3, buckets: int = 1 << 18, smoothing: float = 1.0
) -> DataFrame:
    """(feature_set, accuracy) of ``tune_smoothing`` for one smoothing value, best first."""
    return tune_smoothing(train, category, (smoothing,), folds, buckets).drop("smoothing")
