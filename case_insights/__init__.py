"""Analysis of large tables of customer cases, as functions from DataFrame to DataFrame."""

from case_insights.operators.chi2 import chi2
from case_insights.operators.complement_nb import complement_nb, learn, load_model, save_model, score_texts
from case_insights.operators.contingency import contingency, expected, pair_cells
from case_insights.operators.fisher import fisher_exact
from case_insights.operators.heavy_hitters import top_values
from case_insights.plans.comparison import compare_feature_sets, tune_smoothing
from case_insights.plans.distribution import (
    issue_children,
    issue_counts,
    issue_subissue_counts,
    issue_totals,
    product_children,
    product_subproduct_state,
    product_top10,
    state_counts_slice,
    subissue_slice,
    submission_response,
    submission_share,
    top_issue_subissue,
    top_issues,
)
from case_insights.plans.marts import base_table, family_counts, read_days, refresh_days, report_tables, write_report
from case_insights.plans.outcomes import (
    dispute_by_response,
    dispute_percentage,
    dispute_rate,
    relief_dispute_table,
    response_share,
)
from case_insights.plans.profile import company_count, missing_profile, sample_rows, top_companies
from case_insights.plans.sketches import companies_between, companies_by_year, company_sketches, read_company_sketches, refresh_company_sketches
from case_insights.plans.sql_functions import register_functions
from case_insights.plans.text import (
    compare_models,
    evaluate,
    fit_text,
    held_out,
    random_narrative,
    score,
    score_narratives,
    training_set,
)
from case_insights.plans.trends import (
    category_trend,
    category_trend_slice,
    category_trend_wide,
    daily_trend,
    one_category_trend,
    relief_proportion_by_company,
    relief_proportion_by_year,
    top_issue_by_year,
    trend_year_slice,
    trend_years,
)
from case_insights.sources.lookups import (
    ISSUE_ABBREVIATIONS,
    PRODUCT_ABBREVIATIONS,
    RELIEF_CLASSES,
    lookup_frame,
)
from case_insights.sources.schema import (
    COMPLAINT_SCHEMA,
    read_complaints,
    read_complaints_bigquery,
    read_narratives_csv,
)
from case_insights.sources.sinks import write_complaints, write_marts, write_records
from case_insights.sources.split_csv import read_csv_in_ranges
