"""Lookup values and the helpers that apply them. A key that is absent maps to null."""

from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Product name -> short name.
PRODUCT_ABBREVIATIONS = {
    "Credit reporting, credit repair services, or other personal consumer reports": "CR, CRS, or OPC Reports",
    "Debt collection": "Debt Collection",
    "Mortgage": "Mortgage",
    "Credit card or prepaid card": "CC or PC",
    "Checking or savings account": "CoSA",
    "Credit reporting": "Credit Reporting",
    "Credit card": "Credit Card",
    "Bank account or service": "BAS",
    "Student loan": "Student Loan",
    "Money transfer, virtual currency, or money service": "MT, VC, or MS",
    "Vehicle loan or lease": "VLL",
    "Consumer Loan": "Consumer Loan",
    "Payday loan, title loan, or personal loan": "PayL, TL, or PL",
    "Payday loan": "Payday Loan",
    "Money transfers": "Money Transfers",
    "Prepaid card": "Prepaid Card",
    "Other financial service": "OFS",
    "Virtual currency": "Virtual Currency",
}

# Issue -> short name.
ISSUE_ABBREVIATIONS = {
    "Incorrect information on your report": "Incorrect Info on CR",
    "Problem with a credit reporting company's investigation into an existing problem": "CR: Investigation Problem",
    "Improper use of your report": "Improper Use of CR",
    "Loan modification,collection,foreclosure": "Loan Modification",
    "Attempts to collect debt not owed": "Unowed Debt Collection",
    "Loan servicing, payments, escrow account": "Loan Servicing",
    "Trouble during payment process": "Payment Trouble",
    "Written notification about debt": "Debt Notification",
    "Cont'd attempts collect debt not owed": "Continued Debt Collection",
    "Incorrect information on credit report": "Incorrect Credit Info",
    "Managing an account": "Account Management",
}

# Company response -> relief class.
RELIEF_CLASSES = {
    "Closed with monetary relief": "Monetary",
    "Closed with non-monetary relief": "Non-Monetary",
    "Closed": "Non-Monetary",
    "Closed with explanation": "Non-Monetary",
}

# Responses whose dispute rate is compared.
DISPUTE_RESPONSES = (
    "Closed",
    "Closed with explanation",
    "Closed with monetary relief",
    "Closed with non-monetary relief",
)

# Columns of the missing-value profile.
PROFILE_COLUMNS = (
    "subissue",
    "subproduct",
    "consumer_complaint_narrative",
    "company_public_response",
    "state",
    "zip_code",
    "tags",
    "consumer_disputed",
    "consumer_consent_provided",
    "company_response_to_consumer",
)


def lookup_frame(
    spark: SparkSession, values: Mapping[str, str], key: str, value: str
) -> DataFrame:
    """A mapping as a two-column frame, for a left join. Spark sees how small it is."""
    columns = {key: list(values.keys()), value: list(values.values())}
    schema = pa.schema([(key, pa.string()), (value, pa.string())])
    return spark.createDataFrame(pa.table(columns, schema=schema))


def mapped(column: Column, values: Mapping[str, str]) -> Column:
    """A short fixed mapping as one expression, with no join."""
    return F.element_at(F.create_map(*(F.lit(x) for item in values.items() for x in item)), column)
