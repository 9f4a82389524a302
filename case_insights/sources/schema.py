"""Schema of the fact table (one row per case) and its readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from case_insights.sources.split_csv import read_csv_in_ranges

COMPLAINT_SCHEMA = T.StructType(
    [
        T.StructField("date_received", T.DateType()),
        T.StructField("product", T.StringType()),
        T.StructField("subproduct", T.StringType()),
        T.StructField("issue", T.StringType()),
        T.StructField("subissue", T.StringType()),
        T.StructField("consumer_complaint_narrative", T.StringType()),
        T.StructField("company_public_response", T.StringType()),
        T.StructField("company_name", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("zip_code", T.StringType()),
        T.StructField("tags", T.StringType()),
        T.StructField("consumer_consent_provided", T.StringType()),
        T.StructField("submitted_via", T.StringType()),
        T.StructField("company_response_to_consumer", T.StringType()),
        T.StructField("timely_response", T.BooleanType()),
        T.StructField("consumer_disputed", T.BooleanType()),
    ]
)

NARRATIVE = "consumer_complaint_narrative"
RESPONSE = "company_response_to_consumer"


def read_complaints(spark: SparkSession, path: str) -> DataFrame:
    """The fact table as Parquet. The schema is given, so no file is opened to infer it."""
    return spark.read.schema(COMPLAINT_SCHEMA).parquet(path)


def read_complaints_bigquery(spark: SparkSession, table: str) -> DataFrame:
    """The fact table straight from a warehouse, where the Spark BigQuery connector is installed."""
    return spark.read.format("bigquery").option("table", table).load()


def read_narratives_csv(spark: SparkSession, path: str, in_ranges: bool = True) -> DataFrame:
    """Narratives from CSV files with a header; the first column is the text.

    Texts may hold line breaks and doubled quotes. Files are read in ranges, many tasks to a file, which needs quotes
    to stand around whole fields, as the format asks; with ``in_ranges=False`` one task reads a file and stray quotes do
    no harm. ``id`` is a 128-bit hash of the text: it stays the same when a lost task is run again, which a
    generated row number would not. It is null for a null text.
    """
    if in_ranges:
        raw = read_csv_in_ranges(spark, path)
    else:
        raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    text = F.col("`" + raw.columns[0].replace("`", "``") + "`")
    return raw.select(F.md5(text.cast("binary")).alias("id"), text.alias(NARRATIVE))
