"""Registered queries and their SQL twins.

Each query binds the columns it needs from the tables in ``sf_dir`` and calls the library. The twin is
written independently for DuckDB over the same tables. Statistics are rounded on both sides, because
the two engines add floating-point numbers in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from case_insights.operators.chi2 import chi2
from case_insights.operators.complement_nb import complement_nb, learn, load_model, save_model, score_texts
from case_insights.operators.contingency import contingency, expected, pair_cells
from case_insights.operators.fisher import fisher_exact
from case_insights.operators.heavy_hitters import top_values
from case_insights.plans import comparison, distribution, marts, outcomes, profile, sketches, text, trends
from case_insights.plans.sql_functions import register_functions
from case_insights.sources.lookups import DISPUTE_RESPONSES, PROFILE_COLUMNS, lookup_frame
from case_insights.sources.schema import COMPLAINT_SCHEMA, NARRATIVE, RESPONSE, read_narratives_csv
from case_insights.sources.scratch import scratch_dir
from case_insights.sources.star import star_complaints, star_narratives

try:  # the training-data operators and their pipeline may be absent
    import corpus_pipeline
    from case_insights.llm import entry as llm
except ModuleNotFoundError:
    corpus_pipeline = llm = None

# Lookups over the bound data. They leave some keys out on purpose: those must come back as null.
PRODUCT_LOOKUP = {f"Brand#{i}": f"B{i}" for i in range(1, 21)}
ISSUE_LOOKUP = {
    f"{adjective} {noun}": f"{adjective[0].upper()}. {noun}"
    for adjective in ("blue", "cold", "hot", "large", "red")
    for noun in ("anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget")
}
RESPONSES = ("Closed", *(f"Closed with {how}" for how in ("explanation", "monetary relief", "non-monetary relief")), "In progress")
BUCKETS = 1 << 18  # of hashed tokens

# Slices shown by the registered queries.
PRODUCT, SUBPRODUCT, ISSUE, YEAR, SINCE = "Brand#2", "PROMO", "red widget", 1998, 1996


def entry(spark: SparkSession) -> DataFrame:
    return queries()["response_trend"](spark, "/root/testdata/sf0.001")


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _joined(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.array_join(F.col(column).cast("array<string>"), "|"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = _case_queries()
    if llm:
        found |= llm.queries() | {"pipeline": corpus_pipeline.run}
    return found


def _case_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def on(*columns: str, then: Callable[[DataFrame], DataFrame]):
        """A query over the fact table's ``columns``."""
        return lambda spark, sf: then(star_complaints(spark, sf, columns))

    def with_lookup(*columns: str, values: dict, names: tuple[str, str], then):
        return lambda spark, sf: then(
            star_complaints(spark, sf, columns), lookup_frame(spark, values, *names)
        )

    def on_texts(then: Callable[[DataFrame], DataFrame]):
        return lambda spark, sf: then(star_narratives(spark, sf))

    channel = ("submitted_via", RESPONSE)
    disputes = (RESPONSE, "consumer_disputed")
    states = ("product", "subproduct", "state")
    issues = ("issue", "subissue")

    def known_pairs(c):
        return distribution.issue_subissue_counts(c, known_only=True)

    def trend(c):
        return trends.daily_trend(c, since_year=SINCE)

    def relief(c):
        return outcomes.relief_dispute_table(outcomes.dispute_by_response(c))

    def response_trend(c):
        return trends.category_trend(c, RESPONSE)

    def product_trend(c):
        return trends.category_trend(c, "product")

    def tested(cells):
        return _rounded(chi2(cells), "statistic", "p_value")

    def relief_cells(c):
        d = outcomes.dispute_by_response(c).withColumn(
            "relief", F.when(F.col("response") == trends.MONETARY, "Monetary").otherwise("Non-Monetary")
        )
        return pair_cells(d, "relief", "dispute", weight="count_response")

    def in_sql(call: str, **args):
        """A call of an SQL table function over a view of the cases."""

        def run(c):
            spark = c.sparkSession
            c.createOrReplaceTempView("cases_for_sql")
            register_functions(spark, "cases_for_sql", only=[call.split("(")[0]])
            return spark.sql(f"SELECT * FROM {call}", args=args)

        return run

    def sketched_companies(c):
        exact = c.groupBy(F.year("date_received").alias("year")).agg(F.countDistinct("company_name").alias("companies"))
        about = sketches.companies_by_year(sketches.company_sketches(c)).withColumnRenamed("companies", "about")
        off = F.abs(F.col("about") - F.col("companies")) / F.col("companies")
        return exact.join(about, "year").select("year", "companies", "cases", (off <= 4 * sketches.STANDARD_ERROR).alias("close"))

    def nb_scores(t):
        return _rounded(complement_nb(text.training_set(t), t), "prob_max")

    def duplicate_scores(t):
        # ids and texts that repeat, and rows without a text
        shown = F.when(F.col("id") % 10 != 0, F.col(NARRATIVE)).alias(NARRATIVE)
        again = t.select(F.col("product").alias("id"), shown)
        return _rounded(complement_nb(text.training_set(t), again), "prob_max")

    def hashed_scores(t):
        return _rounded(text.score_narratives(text.training_set(t), t, BUCKETS), "prob_max")

    def stored_scores(t):
        path = scratch_dir(t.sparkSession, "model")
        save_model(learn(text.training_set(t), buckets=BUCKETS), path)
        return _rounded(score_texts(load_model(t.sparkSession, path), t), "prob_max")

    def csv_narratives(t):
        path = scratch_dir(t.sparkSession, "csv")
        t.select(NARRATIVE, "product").write.csv(path, header=True, quoteAll=True, escape='"')
        return read_narratives_csv(t.sparkSession, path)

    def svm_scores(t):
        return text.score(text.fit_text(text.training_set(t), classifier="linear_svm"), t)

    def accuracy(t):
        train, test = text.held_out(text.training_set(t))
        scored = complement_nb(train, test, buckets=BUCKETS).join(test.select("id", "label"), "id")
        return _rounded(text.evaluate(scored), "accuracy", "recall_0", "recall_1")

    def model_comparison(t):
        compared = comparison.compare_feature_sets(text.training_set(t, keep=["product"]), "product")
        return _rounded(compared, "accuracy")

    def smoothing_grid(t):
        return _rounded(comparison.tune_smoothing(text.training_set(t, keep=["product"]), "product"), "accuracy")

    return {
        "missing_profile": on(*PROFILE_COLUMNS, then=profile.missing_profile),
        "sample_rows": on(*COMPLAINT_SCHEMA.fieldNames(), then=profile.sample_rows),
        "product_top10": with_lookup(
            "product", "subproduct",
            values=PRODUCT_LOOKUP, names=("product", "product_abbr"), then=distribution.product_top10,
        ),
        "product_subproduct_state": on(*states, then=distribution.product_subproduct_state),
        "product_children": on(
            *states,
            then=lambda c: _joined(
                distribution.product_children(distribution.product_subproduct_state(c)), "children"
            ),
        ),
        "state_counts_slice": on(
            *states,
            then=lambda c: distribution.state_counts_slice(
                distribution.product_subproduct_state(c), PRODUCT, SUBPRODUCT
            ),
        ),
        "issue_counts": on("issue", then=distribution.issue_counts),
        "issue_counts_known": on(
            "issue", then=lambda c: distribution.issue_counts(c, known_only=True)
        ),
        "issue_subissue_counts": on(*issues, then=distribution.issue_subissue_counts),
        "issue_subissue_counts_min100": on(
            *issues, then=lambda c: distribution.issue_subissue_counts(c, min_count=100)
        ),
        "issue_subissue_known": on(*issues, then=known_pairs),
        "issue_totals": on(*issues, then=lambda c: distribution.issue_totals(known_pairs(c))),
        "top_issues": on(
            *issues, then=lambda c: distribution.top_issues(distribution.issue_totals(known_pairs(c)))
        ),
        "issue_children": on(
            *issues, then=lambda c: _joined(distribution.issue_children(c), "children")
        ),
        "subissue_slice": on(
            *issues, then=lambda c: distribution.subissue_slice(known_pairs(c), ISSUE)
        ),
        "top_issue_subissue": with_lookup(
            *issues,
            values=ISSUE_LOOKUP, names=("issue", "issue_abbrev"), then=distribution.top_issue_subissue,
        ),
        "submission_response": on(*channel, then=distribution.submission_response),
        "submission_share": on("submitted_via", then=distribution.submission_share),
        "submission_crosstab": on(
            *channel, then=lambda c: contingency(pair_cells(c, *channel, presence=True), dense=True)
        ),
        "chi2_presence": on(*channel, then=lambda c: tested(pair_cells(c, *channel, presence=True))),
        "chi2_presence_zip_issue": on(
            "zip_code", "issue",
            then=lambda c: tested(pair_cells(c, "zip_code", "issue", presence=True)),
        ),
        "chi2_weighted": on(*channel, then=lambda c: tested(pair_cells(c, *channel))),
        "chi2_relief": on(*disputes, then=lambda c: tested(relief_cells(c))),
        "chi2_expected": on(
            *channel, then=lambda c: _rounded(expected(pair_cells(c, *channel), dense=True), "expected")
        ),
        "daily_trend": on("date_received", then=trend),
        "trend_years": on(
            "date_received", then=lambda c: _joined(trends.trend_years(trend(c)), "years")
        ),
        "trend_year_slice": on(
            "date_received", then=lambda c: trends.trend_year_slice(trend(c), YEAR)
        ),
        "relief_proportion_by_year": on(
            "date_received", RESPONSE, then=trends.relief_proportion_by_year
        ),
        "relief_proportion_by_company": on(
            "date_received", "company_name", RESPONSE, then=trends.relief_proportion_by_company
        ),
        "response_trend": on("date_received", RESPONSE, then=response_trend),
        "response_trend_wide": on(
            "date_received", RESPONSE,
            then=lambda c: trends.category_trend_wide(response_trend(c)),
        ),
        "product_trend": on("date_received", "product", then=product_trend),
        "product_trend_wide": on(
            "date_received", "product",
            then=lambda c: trends.category_trend_wide(product_trend(c)),
        ),
        "product_trend_slice": on(
            "date_received", "product",
            then=lambda c: trends.one_category_trend(c, "product", PRODUCT),
        ),
        "top_issue_by_year": on("date_received", "issue", then=trends.top_issue_by_year),
        "response_share": on(RESPONSE, then=outcomes.response_share),
        "dispute_by_response": on(*disputes, then=outcomes.dispute_by_response),
        "dispute_rate": on(
            *disputes, then=lambda c: outcomes.dispute_rate(outcomes.dispute_by_response(c))
        ),
        "dispute_percentage": on(
            *disputes, then=lambda c: outcomes.dispute_percentage(outcomes.dispute_by_response(c))
        ),
        "relief_dispute_table": on(*disputes, then=relief),
        "fisher_exact": on(
            *disputes, then=lambda c: _rounded(fisher_exact(relief(c)), "odds_ratio", "p_value")
        ),
        "company_count": on("company_name", then=profile.company_count),
        "top_companies": on("company_name", then=profile.top_companies),
        "base_counts": on(*marts.COLUMNS, marts.DAY, then=marts.base_table),
        "daily_base_counts": on(*marts.COLUMNS, marts.DAY, then=lambda c: marts.base_table(c, by_day=True)),
        "frequent_companies": on("company_name", then=lambda c: top_values(c, "company_name")),
        "frequent_zip_codes": on("zip_code", then=lambda c: top_values(c, "zip_code", 25)),
        "sketched_companies": on("date_received", "company_name", then=sketched_companies),
        "sql_dispute_by_response": on(*disputes, then=in_sql("dispute_by_response(:r)", r=list(DISPUTE_RESPONSES))),
        "sql_product_totals": on("product", "subproduct", then=in_sql("product_totals(10)")),
        "sql_state_counts": on(*states, then=in_sql("state_counts(:p, :s)", p=PRODUCT, s=SUBPRODUCT)),
        "sql_issue_pairs": on(*issues, then=in_sql("issue_pairs(5)")),
        "sql_daily_trend": on("date_received", then=in_sql("daily_trend(:y)", y=SINCE)),
        "sql_top_companies": on("company_name", then=in_sql("top_companies(10)")),
        "training_set": on_texts(text.training_set),
        "random_narrative": on_texts(text.random_narrative),
        "complement_nb_sql": on_texts(nb_scores),
        "duplicate_narrative_scores": on_texts(duplicate_scores),
        "narrative_scores": on_texts(hashed_scores),
        "stored_model_scores": on_texts(stored_scores),
        "csv_narratives": on_texts(csv_narratives),
        "svm_scores": on_texts(svm_scores),
        "model_accuracy": on_texts(accuracy),
        "model_comparison": on_texts(model_comparison),
        "smoothing_grid": on_texts(smoothing_grid),
    }


# The fact table, all columns.
_COMPLAINTS = f"""
complaints AS (
  SELECT CAST(l_shipdate AS DATE) AS date_received,
         p_brand AS product,
         CASE WHEN p_size % 10 <> 0 THEN p_type END AS subproduct,
         CASE WHEN l_partkey % 13 <> 0 THEN p_name END AS issue,
         CASE WHEN l_orderkey % 7 <> 0 THEN c_mktsegment END AS subissue,
         CASE WHEN l_linenumber % 3 <> 0 THEN p_name END AS {NARRATIVE},
         CASE WHEN l_suppkey % 5 <> 0 THEN s_name END AS company_public_response,
         s_name AS company_name,
         CASE WHEN c_custkey % 11 <> 0 THEN n_name END AS state,
         CASE WHEN o_custkey % 23 <> 0
              THEN lpad(CAST(o_custkey % 100000 AS VARCHAR), 5, '0') END AS zip_code,
         CASE WHEN l_quantity > 40 THEN 'Older American' END AS tags,
         CASE WHEN l_linenumber % 4 <> 0 THEN l_linestatus END AS consumer_consent_provided,
         CASE WHEN l_suppkey % 17 <> 0 THEN o_orderpriority END AS submitted_via,
         CASE l_returnflag || l_linestatus
              WHEN 'RO' THEN 'Closed'
              WHEN 'RF' THEN 'Closed with explanation'
              WHEN 'AF' THEN 'Closed with monetary relief'
              WHEN 'AO' THEN 'Closed with non-monetary relief'
              WHEN 'NO' THEN 'In progress' END AS {RESPONSE},
         l_tax < 0.07 AS timely_response,
         CASE WHEN o_orderstatus <> 'P' THEN l_quantity > 25 END AS consumer_disputed
  FROM lineitem
  LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN part ON l_partkey = p_partkey
  LEFT JOIN supplier ON l_suppkey = s_suppkey
)"""

_TEXTS = f"""
texts AS (
  SELECT doc_id AS id, text AS {NARRATIVE},
         CASE quality WHEN 1 THEN 'Closed with monetary relief'
                      WHEN 0 THEN 'Closed with non-monetary relief'
                      ELSE 'Closed with explanation' END AS {RESPONSE}
  FROM documents LEFT JOIN labels USING (doc_id)
), training AS (
  SELECT id, {NARRATIVE}, CASE WHEN {RESPONSE} LIKE '%non-%' THEN 0.0 ELSE 1.0 END::DOUBLE AS label
  FROM texts
  WHERE {RESPONSE} IN ('Closed with monetary relief', 'Closed with non-monetary relief')
    AND {NARRATIVE} IS NOT NULL
)"""

_PAIRS = """
all_pairs AS (
  SELECT coalesce(issue, 'Unknown') AS i, coalesce(subissue, 'Unknown') AS s, count(issue) AS cnt
  FROM complaints GROUP BY 1, 2
), known_pairs AS (
  SELECT i AS issue, s AS subissue, cnt FROM all_pairs
  WHERE i <> 'Unknown' AND s <> 'Unknown' AND cnt >= 5
), totals AS (
  SELECT issue, CAST(sum(cnt) AS BIGINT) AS cnt FROM known_pairs GROUP BY issue
)"""

_DISPUTES = f"""
disputes AS (
  SELECT {RESPONSE} AS response, CASE WHEN consumer_disputed THEN 'True' ELSE 'False' END AS dispute,
         count(*) AS count_response
  FROM complaints
  WHERE {RESPONSE} LIKE 'Closed%' AND consumer_disputed IS NOT NULL
  GROUP BY 1, 2
), relief_table AS (
  SELECT CASE response WHEN 'Closed with monetary relief' THEN 'Monetary'
                       ELSE 'Non-Monetary' END AS relief,
         CAST(sum(count_response) FILTER (dispute = 'False') AS BIGINT) AS false_n,
         CAST(sum(count_response) FILTER (dispute = 'True') AS BIGINT) AS true_n
  FROM disputes GROUP BY 1
)"""

_TREND = f"""
days AS (
  SELECT date_received, count(*) AS cnt FROM complaints GROUP BY 1
), trend AS (
  SELECT * FROM (
    SELECT date_received, cnt,
           CASE WHEN row_number() OVER w >= 30
                THEN avg(cnt) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) END AS monthly_mva
    FROM days WINDOW w AS (ORDER BY date_received)
  ) WHERE year(date_received) >= {SINCE}
)"""

_VERDICT = """CASE WHEN p_value < 0.05 THEN 'reject the null hypothesis'
            ELSE 'fail to reject the null hypothesis' END"""


def _category_trend(category: str) -> str:
    return f"""
cells AS (
  SELECT date_received, {category} AS category, count(*) AS cnt
  FROM complaints WHERE {category} IS NOT NULL GROUP BY 1, 2
), grid AS (
  SELECT date_received, category, coalesce(cnt, 0) AS cnt
  FROM (SELECT DISTINCT date_received FROM cells)
  CROSS JOIN (SELECT DISTINCT category FROM cells)
  LEFT JOIN cells USING (date_received, category)
), category_trend AS (
  SELECT date_received, category, cnt,
         CASE WHEN row_number() OVER w >= 30
              THEN avg(cnt) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) END AS mva
  FROM grid WINDOW w AS (PARTITION BY category ORDER BY date_received)
)"""


def _wide(*categories: str) -> str:
    """Each listed category a column. The query takes the categories from the data, so one that is missing here, or
    in the data, shows as a difference."""
    listed = ", ".join(f"'{c}'" for c in categories)
    return f"SELECT * FROM (PIVOT category_trend ON category IN ({listed}) USING max(mva) GROUP BY date_received)"


def _base_counts(by_day: bool) -> str:
    parts = []
    for name, (columns, kept) in marts.FAMILIES.items():
        kept = "day" if by_day else kept
        date = {"day": "date_received", "year": "CAST(date_trunc('year', date_received) AS DATE)", None: "CAST(NULL AS DATE)"}[kept]
        shown = ", ".join(c if c in columns else f"NULL AS {c}" for c in marts.COLUMNS)
        parts.append(f"SELECT '{name}' AS family, {date} AS date_received, {shown}, count(*) AS _cases FROM complaints GROUP BY ALL")
    return " UNION ALL ".join(parts)


def _cells(row: str, col: str, n: str) -> str:
    return f"""
cells AS (
  SELECT {row} AS r, {col} AS c, {n} AS n FROM complaints
  WHERE {row} IS NOT NULL AND {col} IS NOT NULL GROUP BY 1, 2
)"""


# The dense grid, the textbook statistic over it, and the upper tail as 1 less the power series of
# the lower incomplete gamma function. Terms further from the largest one than 60 times the series'
# spread are below 1e-300 of it.
_GRID = """
grid AS (
  SELECT r, c, coalesce(n, 0) AS n,
         CAST(row_n AS DOUBLE) * col_n / (SELECT sum(n) FROM cells) AS e
  FROM (SELECT r, sum(n) AS row_n FROM cells GROUP BY r)
  CROSS JOIN (SELECT c, sum(n) AS col_n FROM cells GROUP BY c)
  LEFT JOIN cells USING (r, c)
)"""


def _chi2(cells: str) -> str:
    return f"""{cells}, {_GRID},
tested AS (
  SELECT CAST((count(DISTINCT r) - 1) * (count(DISTINCT c) - 1) AS BIGINT) AS dof,
         sum((n - e) * (n - e) / e) AS plain,
         sum(greatest(abs(n - e) - 0.5, 0) ** 2 / e) AS corrected
  FROM grid
), statistic AS (
  SELECT dof, CASE WHEN dof = 0 THEN 0 WHEN dof = 1 THEN corrected ELSE plain END AS statistic,
         dof / 2 AS a, statistic / 2 AS x
  FROM tested
), tail AS (
  SELECT statistic, dof,
         CASE WHEN dof = 0 OR statistic <= 0 THEN 1.0
              ELSE greatest(0, 1 - list_sum(list_transform(
                     range(CAST(greatest(0, x - a - 60 * sqrt(x) - 200) AS BIGINT),
                           CAST(greatest(0, x - a) + 60 * sqrt(x + a) + 200 AS BIGINT)),
                     lambda k: exp((a + k) * ln(x) - x - lgamma(a + k + 1))))) END AS p_value
  FROM statistic
)
SELECT round(statistic, 6) AS statistic, dof, round(p_value, 6) AS p_value,
       p_value < 0.05 AS reject, {_VERDICT} AS verdict
FROM tail"""


def _values(pairs: dict[str, str]) -> str:
    return "VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in pairs.items())


_HASHED = f"CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % {BUCKETS}"


def _nb(train: str, target: str, token: str = "token") -> str:
    """Complement naive Bayes: class scores of every text in ``target``; ``token`` may map tokens."""
    each = f"unnest(regexp_extract_all(lower({NARRATIVE}), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS token"
    return f"""
words AS (
  SELECT id, label, {token} AS token FROM (SELECT id, label, {each} FROM {train})
), vocabulary AS (
  SELECT token, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1
  FROM words GROUP BY token
), sizes AS (
  SELECT count(*) AS v, sum(n0) AS t0, sum(n1) AS t1 FROM vocabulary
), weights AS (
  SELECT token, -ln((n1 + 1.0) / (t1 + v)) AS w0, -ln((n0 + 1.0) / (t0 + v)) AS w1
  FROM vocabulary, sizes
), target_words AS (
  SELECT id, {token} AS token FROM (SELECT id, {each} FROM {target})
), class_scores AS (
  SELECT id, coalesce(s0, 0) AS s0, coalesce(s1, 0) AS s1
  FROM {target} LEFT JOIN (
    SELECT id, sum(w0) AS s0, sum(w1) AS s1 FROM target_words JOIN weights USING (token) GROUP BY id
  ) USING (id)
), decided AS (
  SELECT id, CASE WHEN s0 >= s1 - 1e-9 THEN 0.0 ELSE 1.0 END::DOUBLE AS prediction,
         100 / (1 + exp(-abs(s0 - s1))) AS prob
  FROM class_scores
)"""


_COMPARISON = f"""
fold_rows AS (
  SELECT id, label, CAST('0x' || substr(md5('0:' || id), 1, 8) AS BIGINT) % 3 AS fold, lang,
         regexp_extract_all(lower({NARRATIVE}), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w
  FROM training JOIN documents ON doc_id = id
), set_tokens AS (
  SELECT 'unigram' AS feature_set, id, label, fold, unnest(w) AS token FROM fold_rows
  UNION ALL SELECT 'tfidf', id, label, fold, unnest(w) FROM fold_rows
  UNION ALL SELECT 'unigram+category', id, label, fold, unnest(list_append(w, 'product=' || lang)) FROM fold_rows
  UNION ALL SELECT 'bigram', id, label, fold,
                   unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM fold_rows
), keyed AS (
  SELECT feature_set, id, label, fold, {_HASHED} AS key FROM set_tokens
), folds AS (
  SELECT unnest(range(3)) AS f
), counts AS (
  SELECT f, feature_set, key, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1,
         count(DISTINCT id) AS df
  FROM keyed JOIN folds ON fold <> f GROUP BY f, feature_set, key
), learnt AS (
  SELECT f, feature_set, key, CASE WHEN feature_set = 'tfidf' THEN ln((n + 1.0) / (df + 1.0)) ELSE 1.0 END AS idf,
         idf * n1 AS t0, idf * n0 AS t1
  FROM counts JOIN (SELECT f, count(*) AS n FROM fold_rows JOIN folds ON fold <> f GROUP BY f) USING (f)
), smoothings AS (
  SELECT unnest([0.1, 0.5, 1.0, 2.0]) AS a
), totals AS (
  SELECT a, f, feature_set, ln(sum(t0) + a * count(*)) AS b0, ln(sum(t1) + a * count(*)) AS b1
  FROM learnt, smoothings GROUP BY a, f, feature_set
), hits AS (
  SELECT a, keyed.feature_set, id, sum(idf) AS known, sum(idf * ln(t0 + a)) AS s0, sum(idf * ln(t1 + a)) AS s1
  FROM keyed JOIN learnt ON f = fold AND learnt.feature_set = keyed.feature_set AND learnt.key = keyed.key, smoothings
  GROUP BY a, keyed.feature_set, id
), judged AS (
  SELECT totals.a, totals.feature_set, fold,
         (coalesce(known * b1 - s1, 0) > coalesce(known * b0 - s0, 0) + 1e-9) = (label = 1) AS correct
  FROM fold_rows JOIN totals ON f = fold
  LEFT JOIN hits ON hits.id = fold_rows.id AND hits.feature_set = totals.feature_set AND hits.a = totals.a
), by_fold AS (
  SELECT a, feature_set, fold, avg(CAST(correct AS DOUBLE)) AS accuracy FROM judged GROUP BY a, feature_set, fold
)"""


def oracle_sql() -> dict[str, str]:
    found = _case_oracle()
    if llm:
        found |= llm.oracle_sql()
        if corpus_pipeline.ORACLE_SQL:
            found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found


def _case_oracle() -> dict[str, str]:
    def over(*parts: str, select: str) -> str:
        return "WITH " + ",".join([_COMPLAINTS, *parts]) + "\n" + select

    def over_texts(*parts: str, select: str) -> str:
        return "WITH " + ",".join([_TEXTS, *parts]) + "\n" + select

    columns = ", ".join(COMPLAINT_SCHEMA.fieldNames())
    missing = ", ".join(f"count(*) - count({c}) AS {c}_missing_count" for c in PROFILE_COLUMNS)
    pss = """
pss AS (
  SELECT product, subproduct, state, count(state) AS counts_complaints
  FROM complaints WHERE subproduct IS NOT NULL GROUP BY ALL
)"""
    response_trend = _category_trend(RESPONSE)
    product_trend = _category_trend("product")
    counted = _cells("submitted_via", RESPONSE, "count(*)")
    present = _cells("submitted_via", RESPONSE, "1")
    relief_cells = """
cells AS (
  SELECT relief AS r, 'False' AS c, false_n AS n FROM relief_table
  UNION ALL SELECT relief, 'True', true_n FROM relief_table
)"""
    scores = "SELECT id, prediction, round(prob, 6) AS prob_max FROM decided"
    bucket = "CAST('0x' || substr(md5('0:' || id), 1, 8) AS BIGINT) % 100"
    return {
        "missing_profile": over(select=f"SELECT {missing} FROM complaints"),
        "sample_rows": over(
            select=f"SELECT {columns} FROM complaints ORDER BY "
            + ", ".join(f"{c} NULLS FIRST" for c in COMPLAINT_SCHEMA.fieldNames())
            + " LIMIT 5"
        ),
        "product_top10": over(
            select=f"""
SELECT product, counts_complaints, product_abbr
FROM (
  SELECT product, count(product) AS counts_complaints FROM complaints
  WHERE subproduct IS NOT NULL GROUP BY product ORDER BY 2 DESC, 1 LIMIT 10
) LEFT JOIN ({_values(PRODUCT_LOOKUP)}) AS l(product, product_abbr) USING (product)"""
        ),
        "product_subproduct_state": over(pss, select="SELECT * FROM pss"),
        "product_children": over(
            pss,
            select="""
SELECT product AS parent, string_agg(subproduct, '|' ORDER BY top DESC, subproduct) AS children
FROM (SELECT product, subproduct, max(counts_complaints) AS top FROM pss GROUP BY 1, 2)
WHERE product IS NOT NULL GROUP BY 1""",
        ),
        "state_counts_slice": over(
            pss,
            select=f"""SELECT state, counts_complaints FROM pss
WHERE product = '{PRODUCT}' AND subproduct = '{SUBPRODUCT}'""",
        ),
        "issue_counts": over(
            select="""SELECT i AS issue, count(issue) AS cnt
FROM (SELECT issue, coalesce(issue, 'Unknown') AS i FROM complaints) GROUP BY i"""
        ),
        "issue_counts_known": over(
            select="""SELECT issue, count(*) AS cnt FROM complaints
WHERE issue IS NOT NULL AND issue <> 'Unknown' GROUP BY issue"""
        ),
        "issue_subissue_counts": over(
            _PAIRS, select="SELECT i AS issue, s AS subissue, cnt FROM all_pairs WHERE cnt >= 5"
        ),
        "issue_subissue_counts_min100": over(
            _PAIRS, select="SELECT i AS issue, s AS subissue, cnt FROM all_pairs WHERE cnt >= 100"
        ),
        "issue_subissue_known": over(_PAIRS, select="SELECT * FROM known_pairs"),
        "issue_totals": over(_PAIRS, select="SELECT * FROM totals"),
        "top_issues": over(_PAIRS, select="SELECT * FROM totals ORDER BY cnt DESC, issue LIMIT 10"),
        "issue_children": over(
            _PAIRS,
            select="""
SELECT issue AS parent,
       CAST(row_number() OVER (ORDER BY sum(cnt) DESC, issue) AS INTEGER) AS rank,
       string_agg(subissue, '|' ORDER BY cnt DESC, subissue) AS children
FROM known_pairs GROUP BY issue""",
        ),
        "subissue_slice": over(
            _PAIRS, select=f"SELECT subissue, cnt FROM known_pairs WHERE issue = '{ISSUE}'"
        ),
        "top_issue_subissue": over(
            _PAIRS,
            select=f"""
SELECT issue, subissue, cnt, issue_abbrev,
       cnt / (SELECT sum(cnt) FROM all_pairs WHERE i <> 'Unknown') * 100 AS percentage,
       CAST(sum(cnt) OVER (PARTITION BY issue) AS BIGINT) AS issue_total
FROM (
  SELECT * FROM known_pairs
  WHERE issue IN (SELECT issue FROM totals ORDER BY cnt DESC, issue LIMIT 10)
  ORDER BY cnt DESC, issue, subissue LIMIT 15
) LEFT JOIN ({_values(ISSUE_LOOKUP)}) AS l(issue, issue_abbrev) USING (issue)""",
        ),
        "submission_response": over(
            select=f"""SELECT submitted_via, {RESPONSE}, count(*) AS count_response
FROM complaints GROUP BY ALL"""
        ),
        "submission_share": over(
            select="""
SELECT *, printf('%.2f%%', percentage) AS label FROM (
  SELECT submitted_via, count(*) AS count_response,
         count(*) / sum(count(*)) OVER () * 100 AS percentage
  FROM complaints WHERE submitted_via IS NOT NULL GROUP BY 1)"""
        ),
        "submission_crosstab": over(
            present, _GRID, select='SELECT r AS "row", c AS col, CAST(n AS BIGINT) AS n FROM grid'
        ),
        "chi2_presence": over(_chi2(present), select=""),
        "chi2_presence_zip_issue": over(_chi2(_cells("zip_code", "issue", "1")), select=""),
        "chi2_weighted": over(_chi2(counted), select=""),
        "chi2_relief": over(_DISPUTES, _chi2(relief_cells), select=""),
        "chi2_expected": over(
            counted, _GRID, select='SELECT r AS "row", c AS col, round(e, 6) AS expected FROM grid'
        ),
        "daily_trend": over(_TREND, select="SELECT * FROM trend"),
        "trend_years": over(
            _TREND,
            select="""
SELECT CAST(min(y) AS INTEGER) AS min_year, CAST(max(y) AS INTEGER) AS max_year,
       string_agg(CAST(y AS VARCHAR), '|' ORDER BY y) AS years
FROM (SELECT DISTINCT year(date_received) AS y FROM trend)""",
        ),
        "trend_year_slice": over(
            _TREND, select=f"SELECT * FROM trend WHERE year(date_received) = {YEAR}"
        ),
        "relief_proportion_by_year": over(
            f"""
yearly AS (
  SELECT CAST(date_trunc('year', date_received) AS DATE) AS year, {RESPONSE} AS response, count(*) AS n
  FROM complaints GROUP BY 1, 2
), total AS (SELECT year, sum(n) AS n FROM yearly GROUP BY 1)""",
            select="""
SELECT total.year, m.n / total.n AS proportion_monetary, o.n / total.n AS proportion_non_monetary
FROM total
JOIN yearly AS m ON m.year = total.year AND m.response = 'Closed with monetary relief'
JOIN yearly AS o ON o.year = total.year AND o.response = 'Closed with non-monetary relief'""",
        ),
        "relief_proportion_by_company": over(
            f"""
yearly AS (
  SELECT CAST(date_trunc('year', date_received) AS DATE) AS year, company_name,
         {RESPONSE} AS response, count(*) AS n
  FROM complaints GROUP BY 1, 2, 3
), total AS (
  SELECT year, company_name, sum(n) AS n FROM yearly GROUP BY 1, 2
), ranked AS (
  SELECT company_name, rank() OVER (ORDER BY sum(n) DESC) AS place FROM total GROUP BY 1
)""",
            select="""
SELECT total.year, total.company_name, m.n / total.n AS proportion_monetary,
       o.n / total.n AS proportion_non_monetary
FROM total
JOIN yearly AS m ON m.year = total.year AND m.company_name = total.company_name
                AND m.response = 'Closed with monetary relief'
JOIN yearly AS o ON o.year = total.year AND o.company_name = total.company_name
                AND o.response = 'Closed with non-monetary relief'
JOIN ranked ON ranked.company_name = total.company_name AND place <= 5""",
        ),
        "response_trend": over(response_trend, select="SELECT * FROM category_trend"),
        "response_trend_wide": over(
            response_trend,
            select=_wide(*RESPONSES),
        ),
        "product_trend": over(product_trend, select="SELECT * FROM category_trend"),
        "product_trend_wide": over(product_trend, select=_wide(*(f"Brand#{i}" for i in range(1, 26)))),
        "product_trend_slice": over(
            product_trend,
            select=f"SELECT date_received, mva FROM category_trend WHERE category = '{PRODUCT}'",
        ),
        "top_issue_by_year": over(
            select="""
SELECT CAST(year AS INTEGER) AS year, coalesce(issue, 'Unknown') AS issue, cnt FROM (
  SELECT *, row_number() OVER (PARTITION BY year ORDER BY cnt DESC, issue NULLS LAST) AS place
  FROM (SELECT year(date_received) AS year, issue, count(*) AS cnt FROM complaints GROUP BY 1, 2)
) WHERE place = 1 AND year IS NOT NULL"""
        ),
        "response_share": over(
            select=f"""SELECT {RESPONSE}, count(*) AS cnt, count(*) / sum(count(*)) OVER () AS share
FROM complaints WHERE {RESPONSE} IS NOT NULL GROUP BY 1"""
        ),
        "dispute_by_response": over(_DISPUTES, select="SELECT * FROM disputes"),
        "dispute_rate": over(
            _DISPUTES,
            select="""SELECT response, dispute,
       count_response / sum(count_response) OVER (PARTITION BY response) AS share FROM disputes""",
        ),
        "dispute_percentage": over(
            _DISPUTES,
            select="""SELECT response,
       coalesce(sum(count_response) FILTER (dispute = 'True'), 0) / sum(count_response) * 100
         AS dispute_percentage
FROM disputes GROUP BY 1""",
        ),
        "relief_dispute_table": over(_DISPUTES, select="SELECT * FROM relief_table"),
        "fisher_exact": over(
            _DISPUTES,
            """
cells AS (
  SELECT CAST(m.false_n AS DOUBLE) AS a, CAST(m.true_n AS DOUBLE) AS b,
         CAST(o.false_n AS DOUBLE) AS c, CAST(o.true_n AS DOUBLE) AS d
  FROM relief_table AS m, relief_table AS o
  WHERE m.relief = 'Monetary' AND o.relief = 'Non-Monetary'
), points AS (
  SELECT *, unnest(range(CAST(greatest(0, a - d) AS BIGINT), CAST(least(a + b, a + c) AS BIGINT) + 1)) AS k
  FROM cells
), masses AS (
  SELECT a, b, c, d, k,
         lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1)
         - lgamma(a + b + c + d + 1) - lgamma(k + 1) - lgamma(a + b - k + 1)
         - lgamma(a + c - k + 1) - lgamma(d - a + k + 1) AS lp
  FROM points
), tail AS (
  SELECT a * d / (b * c) AS odds_ratio, sum(exp(lp)) AS p_value
  FROM masses WHERE lp <= (SELECT lp FROM masses WHERE k = a) + 1e-7 GROUP BY 1
)""",
            select=f"""SELECT round(odds_ratio, 6) AS odds_ratio, round(p_value, 6) AS p_value,
       p_value < 0.05 AS reject, {_VERDICT} AS verdict FROM tail""",
        ),
        "company_count": over(
            select="SELECT count(DISTINCT company_name) AS total_companies FROM complaints"
        ),
        "top_companies": over(
            select="""SELECT count(DISTINCT company_name) AS total_companies, company_name,
       count(*) AS total_complaints
FROM complaints GROUP BY company_name ORDER BY 3 DESC, 2 LIMIT 10"""
        ),
        "base_counts": over(select=_base_counts(False)),
        "daily_base_counts": over(select=_base_counts(True)),
        "frequent_companies": over(
            select="SELECT company_name, count(*) AS cnt FROM complaints GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"
        ),
        "frequent_zip_codes": over(
            select="SELECT zip_code, count(*) AS cnt FROM complaints GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25"
        ),
        "sketched_companies": over(
            select="""SELECT CAST(year(date_received) AS INTEGER) AS year, count(DISTINCT company_name) AS companies,
       count(*) AS cases, TRUE AS close FROM complaints WHERE date_received IS NOT NULL GROUP BY 1"""
        ),
        "sql_dispute_by_response": over(_DISPUTES, select="SELECT * FROM disputes"),
        "sql_product_totals": over(
            select="""SELECT product, count(product) AS counts_complaints FROM complaints
WHERE subproduct IS NOT NULL GROUP BY product ORDER BY 2 DESC, 1 LIMIT 10"""
        ),
        "sql_state_counts": over(
            pss,
            select=f"""SELECT state, counts_complaints FROM pss
WHERE product = '{PRODUCT}' AND subproduct = '{SUBPRODUCT}'""",
        ),
        "sql_issue_pairs": over(
            _PAIRS, select="SELECT i AS issue, s AS subissue, cnt FROM all_pairs WHERE cnt >= 5"
        ),
        "sql_daily_trend": over(_TREND, select="SELECT * FROM trend"),
        "sql_top_companies": over(
            select="""SELECT count(DISTINCT company_name) AS total_companies, company_name,
       count(*) AS total_complaints
FROM complaints GROUP BY company_name ORDER BY 3 DESC, 2 LIMIT 10"""
        ),
        "training_set": over_texts(select="SELECT * FROM training"),
        "random_narrative": over_texts(
            select=f"""SELECT id, {NARRATIVE} FROM texts
WHERE {NARRATIVE} IS NOT NULL ORDER BY md5('0:' || id), id LIMIT 1"""
        ),
        "complement_nb_sql": over_texts(_nb("training", "texts"), select=scores),
        "duplicate_narrative_scores": over_texts(
            f"""
shown AS (
  SELECT id, lang, CASE WHEN id % 10 <> 0 THEN {NARRATIVE} END AS {NARRATIVE}
  FROM texts JOIN documents ON doc_id = id
)""",
            _nb("training", "shown"),
            select="SELECT lang AS id, prediction, round(prob, 6) AS prob_max FROM decided JOIN shown USING (id)",
        ),
        "narrative_scores": over_texts(
            _nb("training", "texts", _HASHED),
            select="""SELECT id, prediction, round(prob, 6) AS prob_max, printf('%.2f', prob) AS prob_text
FROM decided""",
        ),
        "stored_model_scores": over_texts(_nb("training", "texts", _HASHED), select=scores),
        "csv_narratives": over_texts(
            select=f"SELECT md5({NARRATIVE}) AS id, {NARRATIVE} FROM (SELECT nullif({NARRATIVE}, '') AS {NARRATIVE} FROM texts)"
        ),
        "model_comparison": over_texts(
            _COMPARISON,
            select="SELECT feature_set, round(avg(accuracy), 6) AS accuracy FROM by_fold WHERE a = 1 GROUP BY feature_set",
        ),
        "smoothing_grid": over_texts(
            _COMPARISON,
            select="""SELECT feature_set, CAST(a AS DOUBLE) AS smoothing, round(avg(accuracy), 6) AS accuracy
FROM by_fold GROUP BY feature_set, a""",
        ),
        "model_accuracy": over_texts(
            f"""
fit_rows AS (SELECT * FROM training WHERE {bucket} >= 20),
test_rows AS (SELECT * FROM training WHERE {bucket} < 20)""",
            _nb("fit_rows", "test_rows", _HASHED),
            select="""
SELECT count(*) AS n,
       round(avg(CAST(prediction = label AS DOUBLE)), 6) AS accuracy,
       round(avg(CAST(prediction = label AS DOUBLE)) FILTER (label = 0), 6) AS recall_0,
       round(avg(CAST(prediction = label AS DOUBLE)) FILTER (label = 1), 6) AS recall_1
FROM decided JOIN test_rows USING (id)""",
        ),
    }
