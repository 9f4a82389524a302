"""Sketches beside exact counts, and the analyses as SQL functions."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from case_insights.operators import heavy_hitters
from case_insights.operators.heavy_hitters import count_of, sketch_error, top_values
from case_insights.operators.ranking import top_rows
from case_insights.plans import outcomes, sketches
from case_insights.plans.sketches import companies_between, companies_by_year, read_company_sketches, refresh_company_sketches
from case_insights.plans.sql_functions import FUNCTIONS, register_functions
from case_insights.sources.lookups import DISPUTE_RESPONSES
from case_insights.sources.star import star_complaints

SF = "/root/testdata/sf0.001"


def exact(df, column, n):
    return [tuple(r) for r in top_rows(df.groupBy(column).agg(F.count(F.lit(1)).alias("cnt")), "cnt", n, [column]).collect()]


def test_map_sizes():
    assert [sketch_error(t) for t in (10_000, 12_288, 12_289, 6)] == [3.5 / 16384, 3.5 / 16384, 3.5 / 32768, 3.5 / 8]


def test_frequent_values_among_very_many(spark, monkeypatch):
    # a third null, eleven heavy values, two of them equally often, and 40,000 values that occur once
    value = "CASE WHEN id % 3 = 0 THEN null WHEN id % 3 = 1 THEN concat('heavy', least(id % 66 div 6, 9)) ELSE concat('rare', id) END"
    df = spark.range(120_000).selectExpr(f"{value} AS v", "id AS cnt").repartition(6)
    full = []
    monkeypatch.setattr(heavy_hitters, "top_rows", lambda *a: full.append(1) or top_rows(*a))
    for n in (1, 5, 11):
        full.clear()
        assert [tuple(r) for r in top_values(df, "v", n).collect()] == exact(df, "v", n)
        assert len(full) == 1, "counted all values"
    # the twelfth is a rare one: no sketch can tell which, so all are counted
    full.clear()
    assert [tuple(r) for r in top_values(df, "v", 13).collect()] == exact(df, "v", 13)
    assert len(full) == 2
    assert [tuple(r) for r in top_values(df, "v", 3, tracked=4).collect()] == exact(df, "v", 3)


def test_only_candidates_are_shuffled(spark):
    df = spark.range(50_000).selectExpr("concat('rare', id) AS v")
    counts = count_of(df, "v", spark.createDataFrame([("rare7",), ("rare8",)], "v string"))
    assert {tuple(r) for r in counts.collect()} == {("rare7", 1), ("rare8", 1)}
    plan = counts._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    at = [i for i, line in enumerate(plan) if "Exchange hashpartitioning(v" in line]
    assert len(at) == 1 and any("BroadcastHashJoin" in line for line in plan[at[0] :])  # the join is below the shuffle


def test_odd_columns(spark):
    assert top_values(spark.createDataFrame([], "v string"), "v").collect() == []
    assert [tuple(r) for r in top_values(spark.createDataFrame([(None,)] * 3, "v string"), "v").collect()] == [(None, 3)]
    numbers = spark.createDataFrame([(i % 4, "x") for i in range(10)], "`a b` int, wanted string")
    assert [tuple(r) for r in top_values(numbers, "a b", 2).collect()] == [(0, 3), (1, 3)]


def test_companies_of_any_span_of_days(spark, tmp_path):
    start = date(1999, 11, 1)
    c = spark.range(60_000).selectExpr(
        "date_add(date'1999-11-01', int(id % 90)) AS date_received",
        "CASE WHEN id % 7 = 0 THEN null WHEN id % 7 < 3 THEN 'everywhere' ELSE concat('c', id * 7919 % 9000) END AS company_name",
    )
    undated = spark.createDataFrame([(None, "undated")] * 2, c.schema)
    whole, path = c.union(undated), str(tmp_path / "s")
    late = F.col("date_received") >= F.lit(start + timedelta(40))
    refresh_company_sketches(whole.withColumn("company_name", F.when(late, "wrong").otherwise(F.col("company_name"))), path)
    refresh_company_sketches(whole.filter(late), path)
    refresh_company_sketches(whole.filter(late), path)
    stored = read_company_sketches(spark, path)
    for first, last in ((None, None), (start, start), (start + timedelta(10), start + timedelta(70)), (start + timedelta(60), None)):
        span = whole
        if first:
            span = span.filter(F.col("date_received") >= F.lit(first))
        if last:
            span = span.filter(F.col("date_received") <= F.lit(last))
        cases, companies = span.agg(F.count(F.lit(1)), F.count_distinct("company_name")).first()
        got = companies_between(stored, first, last).first()
        assert got.cases == cases and got.companies == pytest.approx(companies, rel=4 * sketches.STANDARD_ERROR)
    assert tuple(companies_between(stored, date(2030, 1, 1)).first()) == (0, 0)
    years = {r.year: (r.cases, r.companies) for r in companies_by_year(stored).collect()}
    assert years.keys() == {1999, 2000, None} and years[None] == (2, 1)
    plan = companies_between(stored, start, start)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(date_received" in plan


def test_sql_functions(spark):
    c = star_complaints(spark, SF)
    c.createOrReplaceTempView("all_cases")
    names = register_functions(spark, "all_cases", "c_")
    assert names == [f"c_{n}" for n in FUNCTIONS]
    got = spark.sql("SELECT * FROM c_dispute_by_response(:r) WHERE dispute = 'True'", args={"r": list(DISPUTE_RESPONSES)})
    assert set(got.collect()) == set(outcomes.dispute_by_response(c).filter("dispute = 'True'").collect())
    one = spark.sql("SELECT max(count_response) FROM c_dispute_by_response(array('Closed'))").first()[0]
    assert one == outcomes.dispute_by_response(c, ["Closed"]).agg(F.max("count_response")).first()[0]
    assert spark.sql("SELECT * FROM c_product_totals(3)").count() == 3
    assert spark.sql("SELECT * FROM c_dispute_by_response(array())").count() == 0
    joined = spark.sql("SELECT p.product, s.state FROM c_product_totals(2) p, LATERAL c_state_counts(p.product, 'PROMO') s")
    assert joined.count() > 0
    for bad in ("x; DROP TABLE y", "a b"):
        with pytest.raises(ValueError):
            register_functions(spark, bad)
