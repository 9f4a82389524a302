"""The executed plans: what is read, how often, and how rows move."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e
from case_insights.functions.tokens import tokens
from case_insights.operators.chi2 import chi2
from case_insights.operators.complement_nb import complement_nb
from case_insights.operators.contingency import contingency, expected, pair_cells
from case_insights.plans import distribution, outcomes, text, trends
from case_insights.sources.lookups import ISSUE_ABBREVIATIONS, lookup_frame
from case_insights.sources.schema import RESPONSE, read_complaints
from case_insights.sources.sinks import write_complaints
from case_insights.sources.star import star_complaints, star_narratives

SF = "/root/testdata/sf0.001"
QUERIES = e._case_queries()
# Model fitting starts jobs of its own, and the model's transform is Spark ML's.
FITTED = {"svm_scores"}


def final_plan(df) -> str:
    """The plan as it ran, after run-time changes, with its subqueries."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]


def formatted(df, run: bool = True) -> str:
    if run:
        df.collect()
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


@pytest.fixture(scope="module")
def flat(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("flat"))
    write_complaints(star_complaints(spark, SF), path)
    return read_complaints(spark, path)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - FITTED))
def test_no_cross_join_and_no_python_on_data(spark, name):
    plan = formatted(QUERIES[name](spark, SF), run=False)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
    if not name.startswith("chi2"):
        assert "ArrowEvalPython" not in plan


def scans(df) -> int:
    """File scans that really ran: those below a reused exchange are not listed in a final plan."""
    text_ = formatted(df)
    ran = [p.split("== Initial Plan ==")[0] for p in text_.split("== Final Plan ==")[1:]]
    return sum(p.count("Scan parquet") for p in ran)


@pytest.mark.parametrize(
    "result",
    [
        lambda c: trends.category_trend(c, "product"),
        lambda c: trends.one_category_trend(c, "product", "Brand#2"),
        lambda c: trends.relief_proportion_by_company(c),
        lambda c: trends.relief_proportion_by_year(c),
    ],
)
def test_table_is_read_once(flat, result):
    assert scans(result(flat)) == 1


@pytest.mark.parametrize("name", ["top_issue_subissue", "chi2_weighted", "chi2_expected", "submission_crosstab"])
def test_report_tables_read_the_table_once(spark, flat, name):
    lookup = lookup_frame(spark, ISSUE_ABBREVIATIONS, "issue", "issue_abbrev")
    cells = pair_cells(flat, "submitted_via", RESPONSE)
    df = {
        "top_issue_subissue": lambda: distribution.top_issue_subissue(flat, lookup),
        "chi2_weighted": lambda: chi2(cells),
        "chi2_expected": lambda: expected(cells, dense=True),
        "submission_crosstab": lambda: contingency(cells, dense=True),
    }[name]()
    assert scans(df) == 1


def test_filters_and_columns_reach_the_scan(flat):
    plan = formatted(outcomes.dispute_by_response(flat))
    assert re.search(r"PushedFilters: \[.*In\(company_response_to_consumer", plan)
    assert "ReadSchema: struct<company_response_to_consumer:string,consumer_disputed:boolean>" in plan
    slice_ = distribution.state_counts_slice(distribution.product_subproduct_state(flat), "Brand#2", "PROMO")
    assert "EqualTo(product,Brand#2)" in formatted(slice_)


def test_ranking_is_cut_before_rows_meet(flat):
    for df in (trends.relief_proportion_by_company(flat), trends.top_issue_by_year(flat)):
        plan = final_plan(df)
        assert plan.count("WindowGroupLimit") >= 2


def test_star_reads_only_the_tables_it_needs(spark):
    plan = formatted(star_complaints(spark, SF, ["date_received", RESPONSE]))
    assert "orders.parquet" not in plan and "part.parquet" not in plan
    assert "nation.parquet" not in formatted(star_complaints(spark, SF, ["subissue"]))


def test_known_filters_reach_the_scan(flat):
    for df in (distribution.issue_children(flat), distribution.issue_counts(flat, known_only=True)):
        assert re.search(r"PushedFilters: \[.*Not\(EqualTo\(issue,Unknown\)\)", formatted(df))


def test_sparse_tables_have_no_all_pairs_step(flat):
    cells = pair_cells(flat, "zip_code", "issue")
    for df in (contingency(cells), expected(cells), chi2(cells)):
        plan = formatted(df)
        assert "Generate" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", sorted(set(QUERIES) - FITTED))
def test_plans_without_broadcasts_have_no_cross_join(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = formatted(QUERIES[name](spark, SF), run=False)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_drawing_a_narrative_orders_ids_only(spark):
    plan = formatted(text.random_narrative(star_narratives(spark, SF)), run=False)
    top = [x for x in re.split(r"\n\n+", plan) if "TakeOrderedAndProject" in x and "Arguments" in x]
    assert len(top) == 2 and any("consumer_complaint_narrative" not in x for x in top)


@pytest.mark.parametrize("share", [1e-5, 0.001])
def test_no_key_gathers_a_row_of_every_text(spark, share):
    """Every text has a frequent token and one of 300 bytes; the join's keys stay spread."""
    long = "x" * 300
    texts = spark.range(4000).selectExpr("id", f"concat('common {long} w', id % 700) AS consumer_complaint_narrative")
    train = texts.withColumn("label", (texts["id"] % 2).cast("double"))
    df = complement_nb(train, texts, frequent_share=share)
    assert df.count() == 4000
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") >= 2
    words = train.select(F.explode(tokens(F.col("consumer_complaint_narrative"))).alias("t"))
    # what is left for the join: a row for each text and rarer token, and the text's own row
    frequent = words.groupBy("t").count().filter(F.col("count") >= share * words.count())
    rest = words.join(frequent, "t", "left_anti").groupBy("t").count().agg(F.max("count")).first()[0] or 0
    assert rest <= max(1, share * 12_000)
    assert {r.t for r in frequent.collect()} >= {"common", long}
