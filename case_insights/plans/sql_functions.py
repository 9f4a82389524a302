"""The analyses as SQL table functions with parameters, over a table or view of cases."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import SparkSession

from case_insights.sources.schema import RESPONSE

# name: parameters, columns of the result, query. Parameters begin with an underscore, unlike any column.
FUNCTIONS = {
    "dispute_by_response": (
        "_responses ARRAY<STRING>",
        "response STRING, dispute STRING, count_response BIGINT",
        f"""SELECT {RESPONSE}, if(consumer_disputed, 'True', 'False'), count(*) FROM {{cases}}
            WHERE array_contains(_responses, {RESPONSE}) AND consumer_disputed IS NOT NULL
            GROUP BY {RESPONSE}, consumer_disputed""",
    ),
    "product_totals": (
        "_n INT",
        "product STRING, counts_complaints BIGINT",
        """SELECT product, n FROM (
             SELECT product, count(product) AS n, row_number() OVER (ORDER BY count(product) DESC, product) AS place
             FROM {cases} WHERE subproduct IS NOT NULL GROUP BY product)
           WHERE place <= _n""",
    ),
    "state_counts": (
        "_product STRING, _subproduct STRING",
        "state STRING, counts_complaints BIGINT",
        """SELECT state, count(state) FROM {cases}
           WHERE product = _product AND subproduct = _subproduct GROUP BY state""",
    ),
    "issue_pairs": (
        "_min_count BIGINT",
        "issue STRING, subissue STRING, cnt BIGINT",
        """SELECT coalesce(issue, 'Unknown'), coalesce(subissue, 'Unknown'), count(issue) FROM {cases}
           GROUP BY 1, 2 HAVING count(issue) >= _min_count""",
    ),
    "daily_trend": (
        "_since INT",
        "date_received DATE, cnt BIGINT, monthly_mva DOUBLE",
        """SELECT date_received, cnt, monthly_mva FROM (
             SELECT date_received, cnt,
                    if(count(*) OVER trailing = 30, avg(cnt) OVER trailing, NULL) AS monthly_mva
             FROM (SELECT date_received, count(*) AS cnt FROM {cases} WHERE date_received IS NOT NULL GROUP BY 1)
             WINDOW trailing AS (ORDER BY date_received ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
           WHERE year(date_received) >= _since""",
    ),
    "top_companies": (
        "_n INT",
        "total_companies BIGINT, company_name STRING, total_complaints BIGINT",
        """SELECT named, company_name, n FROM (
             SELECT count(DISTINCT company_name) AS named, company_name, count(*) AS n,
                    row_number() OVER (ORDER BY count(*) DESC, company_name NULLS LAST) AS place
             FROM {cases} GROUP BY company_name)
           WHERE place <= _n""",
    ),
}


def register_functions(
    spark: SparkSession, cases: str, prefix: str = "", only: Sequence[str] = tuple(FUNCTIONS)
) -> list[str]:
    """Create the functions (or ``only`` some, where the cases have not all columns) for this session, over the
    table or view named ``cases``, and return their names:

        SELECT * FROM dispute_by_response(array('Closed', 'In progress'))
        SELECT * FROM state_counts(:product, :subproduct) ORDER BY 2 DESC

    Arguments may be expressions or parameters; a query around a call is planned together with it, so that filters
    and columns reach the scan. An existing function of the same name is replaced."""
    if not all(re.fullmatch(r"\w+(\.\w+)*", x) for x in (cases, f"x{prefix}")):
        raise ValueError("a plain name is needed")
    names = []
    for name in only:
        parameters, columns, query = FUNCTIONS[name]
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS TABLE ({columns}) "
            f"RETURN {query.replace('{cases}', cases)}"
        )
        names.append(prefix + name)
    return names
