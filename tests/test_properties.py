"""Relations between results that must hold on any data, and on skewed data in particular."""

import pytest
from pyspark.sql import functions as F

from case_insights.operators.chi2 import chi2
from case_insights.operators.contingency import pair_cells
from case_insights.operators.fisher import fisher_exact
from case_insights.plans import distribution, outcomes, trends
from case_insights.sources.schema import RESPONSE
from case_insights.sources.star import star_complaints

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def flat(spark):
    return star_complaints(spark, SF).cache()


@pytest.fixture(scope="module")
def skewed(flat):
    """Every third row, by content, falls into one category of each kind and one day."""
    hot = F.pmod(F.xxhash64(*flat.columns), F.lit(3)) == 0
    fixed = {
        "product": F.lit("Hot"), "issue": F.lit("hot issue"), "subissue": F.lit("hot sub"),
        "submitted_via": F.lit("Web"), "company_name": F.lit("Hot Inc."),
        "date_received": F.lit("1998-02-03").cast("date"),
    }
    return flat.withColumns({k: F.when(hot, v).otherwise(F.col(k)) for k, v in fixed.items()}).cache()


def key(df):
    return sorted(map(str, df.collect()))


RESULTS = {
    "pairs": lambda c: distribution.issue_subissue_counts(c),
    "children": lambda c: distribution.issue_children(c),
    "share": distribution.submission_share,
    "daily": lambda c: trends.daily_trend(c, since_year=1990),
    "trend": lambda c: trends.category_trend(c, "product"),
    "company": trends.relief_proportion_by_company,
    "top_issue": trends.top_issue_by_year,
    "disputes": outcomes.dispute_by_response,
    "chi2": lambda c: chi2(pair_cells(c, "submitted_via", RESPONSE)).select(F.round("statistic", 6)),
    "fisher": lambda c: fisher_exact(
        outcomes.relief_dispute_table(outcomes.dispute_by_response(c))
    ).select(F.round("p_value", 9)),
}


@pytest.mark.parametrize("name", list(RESULTS))
def test_layout_does_not_matter(skewed, name):
    once = key(RESULTS[name](skewed.coalesce(1)))
    assert once and once == key(RESULTS[name](skewed.repartition(13)))


def test_skewed_rows_are_all_counted(skewed):
    total = skewed.count()
    assert distribution.submission_response(skewed).agg(F.sum("count_response")).first()[0] == total
    assert trends.daily_trend(skewed, since_year=1990).agg(F.sum("cnt")).first()[0] == total
    assert trends.category_trend(skewed, "product").agg(F.sum("cnt")).first()[0] == total
    assert skewed.filter("product = 'Hot'").count() > total / 4


def test_shares_add_up(flat):
    assert outcomes.response_share(flat).agg(F.sum("share")).first()[0] == pytest.approx(1)
    assert distribution.submission_share(flat).agg(F.sum("percentage")).first()[0] == pytest.approx(100)
    rates = outcomes.dispute_rate(outcomes.dispute_by_response(flat)).groupBy("response").agg(F.sum("share").alias("s"))
    assert all(r.s == pytest.approx(1) for r in rates.collect())


def test_long_and_wide_trends_agree(flat):
    long = trends.category_trend(flat, RESPONSE)
    wide = trends.category_trend_wide(long)
    names = [c for c in wide.columns if c != "date_received"]
    back = wide.unpivot("date_received", [f"`{n}`" for n in names], "category", "mva")
    assert key(back.select("date_received", "category", "mva")) == key(long.select("date_received", "category", "mva"))


def test_one_category_is_its_part_of_the_trend(flat):
    part = trends.category_trend_slice(trends.category_trend(flat, RESPONSE), "Closed")
    assert key(trends.one_category_trend(flat, RESPONSE, "Closed")) == key(part)


def test_trend_is_dense(flat):
    t = trends.category_trend(flat, "product")
    assert t.count() == t.select("date_received").distinct().count() * t.select("category").distinct().count()


def test_leaving_columns_out_of_the_star_changes_nothing(spark, flat):
    for names in (["product"], ["state", "zip_code"], ["company_name"], ["submitted_via", "subissue"]):
        assert key(star_complaints(spark, SF, names)) == key(flat.select(*names))
