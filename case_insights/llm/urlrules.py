"""URL verdicts by a curated list and, where it is silent, by mined association rules.

FP-growth finds the combinations of URL tokens that are frequent in labelled URLs and the verdict they imply.
A rule stays if its support and confidence reach the thresholds and leaving out one of its tokens would cost
confidence. An inverted index from token to rules matches them: a URL's tokens are joined to the index, and a
rule applies where all of its tokens are found. Only distinct token sets are matched, so a frequent host costs
one row. Everything is DataFrame operations, and nothing but frequent tokens comes to the driver.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from case_insights.llm.store import saved

ALLOW, BLOCK = "allow", "block"

# The curated list, (verdict, host, path).
CURATED = (
    (ALLOW, "com", "/"),
    (BLOCK, "example.com", "/en/"),
    (ALLOW, "www.example.com", "/en/"),
    (BLOCK, "net", "/es/"),
    (BLOCK, "net", "/fr/"),
)

_LABEL = "="  # starts the item of a label; tokens start otherwise


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(_after_scheme(url), "^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def curated_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The struct (rule, verdict) of the longest rule that fits, or null. A rule fits its host and all subdomains
    if the path starts with the rule's."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, rule).otherwise(found)
    return found


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """The sorted distinct tokens: labels of the host, segments of the path, names of the query's parameters.
    Numbers are left out, as they name pages."""
    query = F.coalesce(F.regexp_extract(url, "[?]([^#]*)", 1), F.lit(""))

    def tokens(parts: Column, mark: str) -> Column:
        kept = F.filter(parts, lambda x: (x != "") & ~x.rlike("^[0-9]+([.][a-z]+)?$"))
        return F.transform(kept, lambda x: F.concat(F.lit(mark), x))

    names = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    return F.array_sort(
        F.array_distinct(
            F.concat(tokens(F.split(host, "[.]"), "h:"), tokens(F.split(path, "/"), "p:"), tokens(names, "q:"))
        )
    )


def mine_rules(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.9) -> DataFrame:
    """``tokens, verdict, confidence, support`` of the pruned rules of ``labelled`` (tokens, verdict)."""
    baskets = labelled.select(F.array_union("tokens", F.array(F.concat(F.lit(_LABEL), F.col("verdict")))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.filter(F.col("consequent")[0].startswith(_LABEL)).select(
        F.array_sort("antecedent").alias("tokens"),
        F.substring(F.col("consequent")[0], len(_LABEL) + 1, 100).alias("verdict"),
        "confidence", "support",
    )
    rules = saved(rules, "url-rules")
    shorter = rules.select(F.col("tokens").alias("rest"), "verdict", F.col("confidence").alias("enough"))
    without_one = rules.withColumn("out", F.explode("tokens")).withColumn(
        "rest", F.array_except("tokens", F.array("out"))
    )
    idle = without_one.join(shorter, ["rest", "verdict"]).filter("enough >= confidence").select("tokens", "verdict")
    return rules.join(idle, ["tokens", "verdict"], "left_anti")


def match_rules(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """For each distinct ``tokens`` of ``token_sets`` that a rule fits: ``tokens, mined, mined_verdict,
    confidence`` of the best one, by confidence, support, number of tokens, then the tokens."""
    index = rules.select(
        F.explode("tokens").alias("token"), F.size("tokens").alias("need"), F.col("tokens").alias("mined"),
        F.col("verdict").alias("mined_verdict"), "confidence", "support",
    )
    found = (
        token_sets.select("tokens").distinct()
        .withColumn("token", F.explode("tokens"))
        .join(index, "token")
        .groupBy("tokens", "mined", "mined_verdict", "confidence", "support", "need")
        .count()
        .filter("count = need")
    )
    best = F.max(F.struct("confidence", "support", "need", "mined", "mined_verdict")).alias("best")
    return found.groupBy("tokens").agg(best).select(
        "tokens", "best.mined", "best.mined_verdict", "best.confidence"
    )


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = CURATED, **thresholds: float) -> DataFrame:
    """``page_id, host, path, rule, verdict, mined, confidence`` for each row of ``pages`` (page_id, url; other
    columns are ignored).

    rule is the longest curated rule that fits, written as host and path; its verdict holds. The URLs that the
    list decides are the labels from which the mined rules come; these decide the others, and ``mined`` are the
    tokens of the one used. Where none fits, or nothing could be mined, the verdict is allow. A null URL or one
    without ``://`` has an empty host and path. Repeated rows and null ids keep their row; an empty table gives
    no rows."""
    host, path = F.col("host"), F.col("path")
    urls = (
        pages.select("page_id", "url")
        .withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
        .withColumn("curated", curated_rule(host, path, rules))
        .withColumn("tokens", url_tokens(F.col("url"), host, path))
        .select("page_id", "host", "path", "curated.rule", "curated.verdict", "tokens")
    )
    labelled = urls.filter("verdict is not null").select("tokens", "verdict")
    if labelled.isEmpty():
        matched = urls.select("tokens").limit(0).selectExpr(
            "tokens", "tokens as mined", "'' as mined_verdict", "0D as confidence"
        )
    else:
        matched = match_rules(urls.filter("verdict is null"), mine_rules(labelled, **thresholds))
    return urls.join(matched, "tokens", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("verdict", "mined_verdict", F.lit(ALLOW)).alias("verdict"),
        F.when(F.col("verdict").isNull(), F.col("mined")).alias("mined"),
        F.when(F.col("verdict").isNull(), F.col("confidence")).alias("confidence"),
    )
