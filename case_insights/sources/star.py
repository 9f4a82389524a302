"""The fact table's columns over a star of order tables, the data used by tests and benchmarks.

Grain: one row per ``lineitem``. Each attribute is looked up with a left join on a unique key, so a
join never adds or drops a row, and a join whose columns are not asked for can be left out without
changing any result. Callers name the columns they need; only those tables are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from case_insights.sources.schema import COMPLAINT_SCHEMA, NARRATIVE, RESPONSE

# Lookup tables behind each column; columns not listed come from lineitem alone.
_TABLES = {
    "product": {"part"},
    "subproduct": {"part"},
    "issue": {"part"},
    NARRATIVE: {"part"},
    "subissue": {"orders", "customer"},
    "state": {"orders", "customer", "nation"},
    "zip_code": {"orders"},
    "submitted_via": {"orders"},
    "consumer_disputed": {"orders"},
    "company_name": {"supplier"},
    "company_public_response": {"supplier"},
}


_EXPRESSIONS = {
    "date_received": "CAST(l_shipdate AS DATE)",
    "product": "p_brand",
    "subproduct": "CASE WHEN p_size % 10 != 0 THEN p_type END",
    "issue": "CASE WHEN l_partkey % 13 != 0 THEN p_name END",
    "subissue": "CASE WHEN l_orderkey % 7 != 0 THEN c_mktsegment END",
    NARRATIVE: "CASE WHEN l_linenumber % 3 != 0 THEN p_name END",
    "company_public_response": "CASE WHEN l_suppkey % 5 != 0 THEN s_name END",
    "company_name": "s_name",
    "state": "CASE WHEN c_custkey % 11 != 0 THEN n_name END",
    "zip_code": "CASE WHEN o_custkey % 23 != 0 THEN lpad(string(o_custkey % 100000), 5, '0') END",
    "tags": "CASE WHEN l_quantity > 40 THEN 'Older American' END",
    "consumer_consent_provided": "CASE WHEN l_linenumber % 4 != 0 THEN l_linestatus END",
    "submitted_via": "CASE WHEN l_suppkey % 17 != 0 THEN o_orderpriority END",
    RESPONSE: """
        CASE l_returnflag || l_linestatus
          WHEN 'RO' THEN 'Closed'
          WHEN 'RF' THEN 'Closed with explanation'
          WHEN 'AF' THEN 'Closed with monetary relief'
          WHEN 'AO' THEN 'Closed with non-monetary relief'
          WHEN 'NO' THEN 'In progress'
        END""",
    "timely_response": "l_tax < 0.07",
    "consumer_disputed": "CASE WHEN o_orderstatus != 'P' THEN l_quantity > 25 END",
}


@cache
def _schema(spark: SparkSession, path: str) -> StructType:
    """Inferred once per table, since many queries read the same few tables."""
    return spark.read.parquet(path).schema


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return spark.read.schema(_schema(spark, path)).parquet(path)


def star_complaints(
    spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """The fact table's ``columns`` (all by default) from the order tables in ``sf_dir``."""
    names = list(columns or COMPLAINT_SCHEMA.fieldNames())
    need = set().union(*(_TABLES.get(n, set()) for n in names))

    def table(name):
        return _table(spark, sf_dir, name)

    fact = table("lineitem")
    if "orders" in need:
        # Widen orders first: the fact table then moves once for this branch, not once per table.
        orders = table("orders")
        if "customer" in need:
            customer = table("customer")
            if "nation" in need:
                nation = table("nation")
                customer = customer.join(
                    nation, F.col("c_nationkey") == F.col("n_nationkey"), "left"
                )
            orders = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
        fact = fact.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    if "part" in need:
        fact = fact.join(table("part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    if "supplier" in need:
        fact = fact.join(table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return fact.selectExpr(*(f"{_EXPRESSIONS[n]} AS {n}" for n in names))


def star_narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narratives with their outcome: ``documents``, with ``labels.quality`` 1 as monetary and 0 as
    non-monetary relief, and documents without a label as cases closed with an explanation."""
    documents = _table(spark, sf_dir, "documents")
    return documents.join(_table(spark, sf_dir, "labels"), "doc_id", "left").selectExpr(
        "doc_id AS id",
        f"text AS {NARRATIVE}",
        f"""CASE quality WHEN 1 THEN 'Closed with monetary relief'
                         WHEN 0 THEN 'Closed with non-monetary relief'
                         ELSE 'Closed with explanation' END AS {RESPONSE}""",
        "lang AS product",
        "source AS submitted_via",
    )
