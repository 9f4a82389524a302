"""How cases spread over products, issues and submission channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from case_insights.functions.columns import CASES, is_known, n_cases, or_unknown, percent, two_decimals
from case_insights.operators.ranking import ordered_children, top_rows
from case_insights.sources.schema import RESPONSE


# Products

def product_top10(c: DataFrame, lookup: DataFrame, n: int = 10) -> DataFrame:
    """Products with a known subproduct by number of cases, with their short name from ``lookup``
    (product, product_abbr), null where it has none."""
    counts = (
        c.filter(F.col("subproduct").isNotNull())
        .groupBy("product")
        .agg(n_cases(c, F.col("product").isNotNull()).alias("counts_complaints"))
    )
    top = top_rows(counts, "counts_complaints", n, ["product"])
    return top.join(lookup, "product", "left").orderBy(F.desc("counts_complaints"), "product")


def product_subproduct_state(c: DataFrame) -> DataFrame:
    """Cases by product, subproduct and state. The count is of known states, so a group without a
    state stays, with 0."""
    return (
        c.filter(F.col("subproduct").isNotNull())
        .groupBy("product", "subproduct", "state")
        .agg(n_cases(c, F.col("state").isNotNull()).alias("counts_complaints"))
        .orderBy(F.desc("counts_complaints"), "product", "subproduct", "state")
    )


def product_children(pss: DataFrame) -> DataFrame:
    """(parent, children): each product's subproducts in the order in which they first appear among
    the state counts, largest first."""
    known = pss.filter(F.col("product").isNotNull())
    return ordered_children(known, "product", "subproduct", "counts_complaints")


def state_counts_slice(pss: DataFrame, product: str, subproduct: str) -> DataFrame:
    """One product and subproduct by state. The filter reaches the scan."""
    chosen = (F.col("product") == product) & (F.col("subproduct") == subproduct)
    return pss.filter(chosen).select("state", "counts_complaints")


# Issues

def issue_counts(c: DataFrame, known_only: bool = False) -> DataFrame:
    """Cases by issue. Null and a literal 'Unknown' form one group; only rows that have an issue are
    counted, so nulls alone give 0. ``known_only`` leaves that group out before counting, in the scan."""
    if known_only:
        known = c.filter(_named("issue")).groupBy("issue").agg(n_cases(c).alias("cnt"))
        return known.orderBy(F.desc("cnt"), "issue")
    counts = (
        c.select("issue", or_unknown(F.col("issue")).alias("issue_key"), *_weight(c))
        .groupBy("issue_key")
        .agg(n_cases(c, F.col("issue").isNotNull()).alias("cnt"))
        .withColumnRenamed("issue_key", "issue")
    )
    return counts.orderBy(F.desc("cnt"), "issue")


def _weight(c: DataFrame) -> list[str]:
    return [CASES] if CASES in c.columns else []


def _pairs(c: DataFrame) -> DataFrame:
    return (
        c.select(
            F.col("issue").alias("raw"),
            or_unknown(F.col("issue")).alias("issue"),
            or_unknown(F.col("subissue")).alias("subissue"),
            *_weight(c),
        )
        .groupBy("issue", "subissue")
        .agg(n_cases(c, F.col("raw").isNotNull()).alias("cnt"))
    )


def _both_known() -> Column:
    return is_known(F.col("issue")) & is_known(F.col("subissue"))


def _named(column: str) -> Column:
    """Neither null nor the sentinel, as conditions that reach the scan."""
    return F.col(column).isNotNull() & is_known(F.col(column))


def _known_pairs(c: DataFrame, min_count: int) -> DataFrame:
    known = c.filter(_named("issue") & _named("subissue")).groupBy("issue", "subissue")
    return known.agg(n_cases(c).alias("cnt")).filter(F.col("cnt") >= min_count)


def issue_subissue_counts(c: DataFrame, min_count: int = 5, known_only: bool = False) -> DataFrame:
    """Cases by issue and sub-issue, pairs of at least ``min_count``."""
    kept = _known_pairs(c, min_count) if known_only else _pairs(c).filter(F.col("cnt") >= min_count)
    return kept.orderBy(F.desc("cnt"), "issue", "subissue")


def issue_totals(pairs: DataFrame) -> DataFrame:
    """Cases by issue, over a table of pairs."""
    return pairs.groupBy("issue").agg(F.sum("cnt").alias("cnt")).orderBy(F.desc("cnt"), "issue")


def top_issues(totals: DataFrame, n: int = 10) -> DataFrame:
    return top_rows(totals, "cnt", n, ["issue"])


def issue_children(c: DataFrame, min_count: int = 5) -> DataFrame:
    """(parent, rank, children): each issue's sub-issues by count, issues ranked by their total. A list is
    as long as its issue has sub-issues; ranking, in one task, sees only issues and totals."""
    pairs = _known_pairs(c, min_count)
    totals = pairs.groupBy("issue").agg(F.sum("cnt").alias("total"))
    rank = F.row_number().over(Window.orderBy(F.desc("total"), "issue"))
    ranked = totals.select(F.col("issue").alias("parent"), rank.alias("rank"))
    entry = F.struct((-F.col("cnt")).alias("o"), F.col("subissue").alias("s"))
    lists = pairs.groupBy(F.col("issue").alias("parent")).agg(F.array_sort(F.collect_list(entry)).alias("listed"))
    return ranked.join(lists, "parent").select(
        "parent", "rank", F.transform("listed", lambda x: x["s"]).alias("children")
    )


def subissue_slice(pairs: DataFrame, issue: str) -> DataFrame:
    """One issue's sub-issues, from a table of known pairs."""
    return pairs.filter(F.col("issue") == issue).select("subissue", "cnt")


def top_issue_subissue(
    c: DataFrame, lookup: DataFrame, issues: int = 10, pairs: int = 15, min_count: int = 5
) -> DataFrame:
    """The largest pairs inside the largest issues.

    Issues are ranked by the sum of their surviving pairs; the percentage is of all cases with a
    known issue, dropped pairs included. ``issue_total`` adds up the pairs shown for an issue, the
    order of a stacked bar. ``lookup`` is (issue, issue_abbrev).
    """
    everything = _pairs(c)
    # Both conditions look at counts, so they stay above the one aggregate that all parts share;
    # plain filters would reach the scan and split it into two reads of the table.
    total = everything.agg(F.sum(F.when(is_known(F.col("issue")), F.col("cnt")))).scalar()
    kept = everything.filter(F.when(_both_known(), F.col("cnt")) >= min_count)
    largest = top_issues(issue_totals(kept), issues).select("issue")
    shown = top_rows(kept.join(largest, "issue", "left_semi"), "cnt", pairs, ["issue", "subissue"])
    return (
        shown.join(lookup, "issue", "left")
        .select(
            "issue",
            "subissue",
            "cnt",
            "issue_abbrev",
            percent(F.col("cnt"), total).alias("percentage"),
            F.sum("cnt").over(Window.partitionBy("issue")).alias("issue_total"),
        )
        .orderBy(F.desc("cnt"), "issue", "subissue")
    )


# Submission channels

def submission_response(c: DataFrame) -> DataFrame:
    """Cases by channel and company response, null groups kept."""
    return (
        c.groupBy("submitted_via", RESPONSE)
        .agg(n_cases(c).alias("count_response"))
        .orderBy(F.desc("count_response"), "submitted_via", RESPONSE)
    )


def submission_share(c: DataFrame) -> DataFrame:
    """Cases by known channel, with the percentage and its text."""
    channels = (
        c.filter(F.col("submitted_via").isNotNull())
        .groupBy("submitted_via")
        .agg(n_cases(c).alias("count_response"))
    )
    total = F.sum("count_response").over(Window.partitionBy())
    share = percent(F.col("count_response"), total)
    return (
        channels.withColumn("percentage", share)
        .withColumn("label", two_decimals(F.col("percentage"), "%"))
        .orderBy("submitted_via")
    )
