"""The rules that are easy to get wrong, on frames small enough to check by hand."""

import datetime as dt
import math

import pytest

from case_insights.operators.chi2 import chi2
from case_insights.operators.contingency import contingency, pair_cells
from case_insights.operators.fisher import fisher_exact
from case_insights.operators.ranking import rank_at_most
from case_insights.plans import distribution, outcomes, profile, trends
from case_insights.sources.lookups import ISSUE_ABBREVIATIONS, PRODUCT_ABBREVIATIONS, lookup_frame
from case_insights.sources.schema import RESPONSE


def rows(df):
    return [tuple(r) for r in df.collect()]


def day(n):
    return dt.date(2011, 12, 1) + dt.timedelta(days=n)


def test_null_and_literal_unknown_are_one_issue_and_only_values_count(spark):
    c = spark.createDataFrame([(None,), (None,), ("Unknown",), ("a",), ("a",)], "issue string")
    assert rows(distribution.issue_counts(c)) == [("a", 2), ("Unknown", 1)]
    assert rows(distribution.issue_counts(c, known_only=True)) == [("a", 2)]


def test_all_null_issue_counts_zero(spark):
    c = spark.createDataFrame([(None,), ("a",)], "issue string")
    assert rows(distribution.issue_counts(c)) == [("a", 1), ("Unknown", 0)]


def test_pairs_below_the_minimum_go_and_still_count_in_the_percentage(spark):
    data = [("x", "s")] * 6 + [("x", "t")] * 5 + [("x", "u")] * 4 + [("x", None)] * 5 + [(None, "s")] * 9
    c = spark.createDataFrame(data, "issue string, subissue string")
    assert rows(distribution.issue_subissue_counts(c)) == [
        ("x", "s", 6), ("x", "Unknown", 5), ("x", "t", 5),
    ]
    assert rows(distribution.issue_subissue_counts(c, known_only=True)) == [("x", "s", 6), ("x", "t", 5)]
    lookup = lookup_frame(spark, {"y": "Y"}, "issue", "issue_abbrev")
    assert rows(distribution.top_issue_subissue(c, lookup)) == [
        ("x", "s", 6, None, 6 / 20 * 100, 11), ("x", "t", 5, None, 5 / 20 * 100, 11),
    ]


def test_largest_pairs_come_from_the_largest_issues_only(spark):
    data = [("a", "p")] * 7 + [("b", "p")] * 5 + [("b", "q")] * 5
    c = spark.createDataFrame(data, "issue string, subissue string")
    lookup = lookup_frame(spark, {"b": "B"}, "issue", "issue_abbrev")
    top = distribution.top_issue_subissue(c, lookup, issues=1, pairs=1)
    assert [r[:4] for r in rows(top)] == [("b", "p", 5, "B")]


def test_state_null_group_stays_with_zero(spark):
    c = spark.createDataFrame(
        [("p", "s", None), ("p", "s", "TX"), ("p", None, "TX")], "product string, subproduct string, state string"
    )
    pss = distribution.product_subproduct_state(c)
    assert rows(pss) == [("p", "s", "TX", 1), ("p", "s", None, 0)]
    assert rows(distribution.state_counts_slice(pss, "p", "s")) == [("TX", 1), (None, 0)]


def test_children_by_first_appearance(spark):
    data = [("p", "small", "TX")] * 2 + [("p", "big", "TX")] * 3 + [("p", "wide", s) for s in "abcdef"]
    c = spark.createDataFrame(data, "product string, subproduct string, state string")
    children = distribution.product_children(distribution.product_subproduct_state(c))
    assert rows(children) == [("p", ["big", "small", "wide"])]


def test_issue_children_follow_totals(spark):
    data = [("a", "x")] * 6 + [("b", "y")] * 5 + [("b", "x")] * 5
    c = spark.createDataFrame(data, "issue string, subissue string")
    assert sorted(rows(distribution.issue_children(c)), key=lambda r: r[1]) == [
        ("b", 1, ["x", "y"]), ("a", 2, ["x"]),
    ]


def test_unmapped_product_has_null_short_name(spark):
    c = spark.createDataFrame([("Mortgage", "x"), ("Tulips", "x")], "product string, subproduct string")
    lookup = lookup_frame(spark, PRODUCT_ABBREVIATIONS, "product", "product_abbr")
    assert rows(distribution.product_top10(c, lookup)) == [("Mortgage", 1, "Mortgage"), ("Tulips", 1, None)]


def test_lookup_sizes():
    assert (len(PRODUCT_ABBREVIATIONS), len(ISSUE_ABBREVIATIONS)) == (18, 11)


@pytest.mark.parametrize("days, first", [(29, None), (30, 15.5), (31, 15.5)])
def test_mean_starts_with_the_thirtieth_row(spark, days, first):
    data = [(day(i if i < 10 else i + 5),) for i in range(days) for _ in range(i + 1)]
    c = spark.createDataFrame(data, "date_received date")
    means = [r.monthly_mva for r in trends.daily_trend(c, since_year=2000).collect()]
    assert means[:29] == [None] * min(29, days)
    assert (means[29] if days > 29 else None) == first


def test_years_are_cut_after_the_mean(spark):
    c = spark.createDataFrame([(day(i),) for i in range(40)], "date_received date")
    trend = trends.daily_trend(c)
    assert trend.count() == 9 and all(r.monthly_mva == 1.0 for r in trend.collect())
    assert rows(trends.trend_years(trend)) == [(2012, 2012, [2012])]


def test_absent_category_counts_zero_on_days_present(spark):
    data = [(day(0), "a"), (day(2), "b"), (day(2), "b"), (day(5), "a"), (day(7), None), (day(9), "b")]
    c = spark.createDataFrame(data, "date_received date, k string")
    got = sorted((r.category, r.date_received, r.cnt, r.mva) for r in trends.category_trend(c, "k", 2).collect())
    assert got == [
        ("a", day(0), 1, None), ("a", day(2), 0, 0.5), ("a", day(5), 1, 0.5), ("a", day(9), 0, 0.5),
        ("b", day(0), 0, None), ("b", day(2), 2, 1.0), ("b", day(5), 0, 1.0), ("b", day(9), 1, 0.5),
    ]


def test_year_without_monetary_relief_disappears(spark):
    m, n = trends.MONETARY, trends.NON_MONETARY
    data = [(dt.date(2012, 5, 1), m), (dt.date(2012, 6, 1), n), (dt.date(2012, 7, 1), None),
            (dt.date(2012, 7, 2), "x"), (dt.date(2013, 1, 1), n), (None, m), (None, n)]
    c = spark.createDataFrame(data, f"date_received date, {RESPONSE} string")
    assert rows(trends.relief_proportion_by_year(c)) == [(dt.date(2012, 1, 1), 0.25, 0.25)]


def test_companies_tied_at_rank_five_all_stay(spark):
    m, n, d = trends.MONETARY, trends.NON_MONETARY, dt.date(2012, 5, 1)
    data = [(d, f"c{i}", r) for i in range(4) for r in [m, n, "x"] * 2]
    data += [(d, f"t{i}", r) for i in range(2) for r in (m, n)] + [(d, "last", m)]
    c = spark.createDataFrame(data, f"date_received date, company_name string, {RESPONSE} string")
    shown = {r.company_name for r in trends.relief_proportion_by_company(c).collect()}
    assert shown == {"c0", "c1", "c2", "c3", "t0", "t1"}


def test_rank_is_shared_by_equal_values(spark):
    df = spark.createDataFrame([("a", 3), ("b", 2), ("c", 2), ("d", 1)], "k string, n bigint")
    assert {r.k for r in rank_at_most(df, "n", 2).collect()} == {"a", "b", "c"}


def test_unnamed_companies_take_a_place_but_are_not_shown(spark):
    m, n, d = trends.MONETARY, trends.NON_MONETARY, dt.date(2012, 5, 1)
    data = [(d, None, m), (d, None, n), (d, None, n), (d, "a", m), (d, "a", n), (d, "b", m)]
    c = spark.createDataFrame(data, f"date_received date, company_name string, {RESPONSE} string")
    assert trends.relief_proportion_by_company(c, top=1).count() == 0
    assert rows(trends.relief_proportion_by_company(c, top=2)) == [(dt.date(2012, 1, 1), "a", 0.5, 0.5)]


def test_top_issue_tie_and_null_issue(spark):
    data = [(dt.date(2012, 1, 1), x) for x in ("b", "b", "a", "a")]
    data += [(dt.date(2013, 1, 1), x) for x in (None, None, "a", "Unknown")]
    c = spark.createDataFrame(data, "date_received date, issue string")
    assert rows(trends.top_issue_by_year(c)) == [(2012, "a", 2), (2013, "Unknown", 2)]


def test_disputes(spark):
    data = [("Closed", True)] * 3 + [("Closed", False), ("Closed", None), ("In progress", True), (None, True)]
    data += [(trends.MONETARY, False)] * 2
    c = spark.createDataFrame(data, f"{RESPONSE} string, consumer_disputed boolean")
    d = outcomes.dispute_by_response(c)
    assert set(rows(d)) == {("Closed", "True", 3), ("Closed", "False", 1), (trends.MONETARY, "False", 2)}
    assert set(rows(outcomes.dispute_percentage(d))) == {("Closed", 75.0), (trends.MONETARY, 0.0)}
    assert rows(outcomes.relief_dispute_table(d)) == [("Monetary", 2, 0), ("Non-Monetary", 1, 3)]


def test_presence_and_weighted_cells_drop_null_keys(spark):
    data = [("w", "x")] * 3 + [("w", "y"), ("v", "x"), (None, "x"), ("w", None)]
    c = spark.createDataFrame(data, "a string, b string")
    counted, present = pair_cells(c, "a", "b"), pair_cells(c, "a", "b", presence=True)
    assert rows(contingency(counted, dense=True)) == [("v", "x", 1), ("v", "y", 0), ("w", "x", 3), ("w", "y", 1)]
    assert rows(contingency(present, dense=True)) == [("v", "x", 1), ("v", "y", 0), ("w", "x", 1), ("w", "y", 1)]
    assert chi2(present, yates=False).first().statistic == pytest.approx(0.75)


def test_single_row_key_has_nothing_to_test(spark):
    cells = spark.createDataFrame([("a", "x", 3), ("a", "y", 1)], "row string, col string, n bigint")
    assert rows(chi2(cells))[0][:4] == (0.0, 0, 1.0, False)


def test_company_group_counts_itself(spark):
    c = spark.createDataFrame([("a",), ("a",), (None,)], "company_name string")
    assert rows(profile.top_companies(c)) == [(1, "a", 2), (0, None, 1)]
    assert rows(profile.company_count(c)) == [(1,)]


def test_submission_share_leaves_out_unknown_channels(spark):
    c = spark.createDataFrame([("Web",)] * 2 + [("Fax",), (None,)], "submitted_via string")
    assert rows(distribution.submission_share(c)) == [
        ("Fax", 1, 1 / 3 * 100, "33.33%"), ("Web", 2, 2 / 3 * 100, "66.67%"),
    ]


@pytest.mark.parametrize(
    "cells, odds, p",
    [
        ((8, 2, 1, 5), 20.0, 0.034965034965034965),
        ((10, 0, 0, 10), math.inf, 2 / 184756),
        ((3, 0, 2, 1), math.inf, 1.0),
        ((0, 4, 5, 1), 0.0, 10 / 210),
    ],
)
def test_fisher_small_tables(spark, cells, odds, p):
    a, b, c, d = cells
    t = spark.createDataFrame(
        [("Monetary", a, b), ("Non-Monetary", c, d)], "relief string, false_n bigint, true_n bigint"
    )
    got = fisher_exact(t).first()
    assert got.odds_ratio == odds and got.p_value == pytest.approx(p, rel=1e-9)
    assert got.reject == (p < 0.05)


def test_fisher_empty_margin(spark):
    t = spark.createDataFrame([("Monetary", 3, 4)], "relief string, false_n bigint, true_n bigint")
    got = fisher_exact(t).first()
    assert math.isnan(got.odds_ratio) and got.p_value == 1.0 and not got.reject


def test_preview(spark):
    c = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "k int, v string")
    assert rows(profile.sample_rows(c, 2)) == [(1, "a"), (2, "b")]
    assert profile.sample_rows(c, 2, ordered=False).count() == 2
