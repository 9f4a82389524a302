"""Sources, sinks, saved models, SQL with parameters."""

import json

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from case_insights.functions.columns import counted
from case_insights.operators.complement_nb import learn, load_model, save_model, score_texts
from case_insights.plans import marts, outcomes, text
from case_insights.sources.lookups import (
    DISPUTE_RESPONSES,
    ISSUE_ABBREVIATIONS,
    PRODUCT_ABBREVIATIONS,
    lookup_frame,
)
from case_insights.sources.schema import COMPLAINT_SCHEMA, NARRATIVE, RESPONSE, read_complaints, read_narratives_csv
from case_insights.sources.sinks import write_complaints, write_marts, write_records
from case_insights.sources.star import star_complaints, star_narratives

SF = "/root/testdata/sf0.001"


def scans(df, path):
    """Leaves of the plan that read a folder."""
    leaves = df._jdf.queryExecution().sparkPlan().collectLeaves()
    found = [leaves.apply(i) for i in range(leaves.size())]
    roots = [str(x.relation().location().rootPaths().mkString(" ")) for x in found if "Scan parquet" in x.nodeName()]
    return sum(r.endswith(path) for r in roots)


def plain_rows(df):  # numbers are added in another order
    return sorted(str([f"{v:.9g}" if isinstance(v, float) else v for v in r]) for r in df.collect())


@pytest.fixture(scope="module")
def flat(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cases") / "flat")
    write_complaints(star_complaints(spark, SF), path)
    return path


@pytest.fixture(scope="module")
def lookups(spark):
    return (
        lookup_frame(spark, PRODUCT_ABBREVIATIONS, "product", "product_abbr"),
        lookup_frame(spark, ISSUE_ABBREVIATIONS, "issue", "issue_abbrev"),
    )


def test_flat_table_round_trip(spark, tmp_path):
    star = star_complaints(spark, SF)
    assert [(f.name, f.dataType) for f in star.schema] == [(f.name, f.dataType) for f in COMPLAINT_SCHEMA]
    write_complaints(star, str(tmp_path / "flat"))
    back = read_complaints(spark, str(tmp_path / "flat"))
    assert back.exceptAll(star).isEmpty() and back.count() == star.count()


def test_narratives_from_csv_are_scored_by_a_saved_model(spark, tmp_path):
    t = star_narratives(spark, SF)
    model = text.fit_text(text.training_set(t))
    model.write().overwrite().save(str(tmp_path / "model"))
    (tmp_path / "n.csv").write_text('narrative,other\n"He said ""no"",\nand left",1\nPlain text,2\n')
    texts = read_narratives_csv(spark, str(tmp_path / "n.csv"))
    assert {r[NARRATIVE] for r in texts.collect()} == {'He said "no",\nand left', "Plain text"}
    loaded = PipelineModel.load(str(tmp_path / "model"))
    assert sorted(text.score(loaded, texts).collect()) == sorted(text.score(model, texts).collect())
    assert all(r.prob_text == f"{r.prob_max:.2f}" for r in text.score(loaded, texts).collect())


def test_records(spark, tmp_path):
    write_records(spark.createDataFrame([(1, "a")], "k int, v string"), str(tmp_path / "r"))
    lines = [x for f in (tmp_path / "r").glob("*.json") for x in f.read_text().splitlines()]
    assert [json.loads(x) for x in lines] == [{"k": 1, "v": "a"}]


def test_marts(spark, flat, lookups, tmp_path):
    c = read_complaints(spark, flat)
    tables = marts.report_tables(c, *lookups)
    parts = {"response_trend": ["category"]}
    write_marts(tables, str(tmp_path / "marts"), parts)
    write_marts({"response_trend": tables["response_trend"]}, str(tmp_path / "marts"), parts)
    for name, df in tables.items():
        assert spark.read.parquet(str(tmp_path / "marts" / name)).count() == df.count(), name
    plan = spark.read.parquet(str(tmp_path / "marts" / "response_trend")).filter("category = 'Closed'")
    assert "PartitionFilters: [isnotnull(category" in plan._jdf.queryExecution().toString()


def test_base_counts_are_those_of_each_family(spark, flat):
    c = read_complaints(spark, flat)
    year = F.trunc("date_received", "year").alias("date_received")
    date = {None: [], "day": ["date_received"], "year": [year]}
    for name, got in marts.family_counts(marts.base_table(c)).items():
        columns, kept = marts.FAMILIES[name]
        want = counted(c, *columns, *date[kept])
        assert got.dtypes == want.dtypes and plain_rows(got) == plain_rows(want), name


def test_report_scans_the_cases_once_for_all_counts(spark, flat, lookups, tmp_path, monkeypatch):
    c = read_complaints(spark, flat)
    written = {}

    def write(results, path, partition_by=None):
        written.update((name, scans(df, flat)) for name, df in results.items())
        write_marts(results, path, partition_by)

    monkeypatch.setattr(marts, "write_marts", write)
    marts.write_report(c, *lookups, str(tmp_path / "report"))
    assert {name for name, n in written.items() if n} == {"base_counts", "missing_profile", "sample_rows"}
    assert set(written.values()) == {0, 1}
    plain = marts.report_tables(c, *lookups)
    assert written.keys() == plain.keys() | {"base_counts"}
    for name, df in plain.items():
        if name != "sample_rows":
            back = spark.read.parquet(str(tmp_path / "report" / name))
            assert back.dtypes == df.dtypes, name
            assert plain_rows(back) == plain_rows(df), name


def test_days_are_refreshed_one_by_one(spark, flat, lookups, tmp_path):
    dated = read_complaints(spark, flat)
    days = [r[0] for r in dated.select("date_received").distinct().orderBy("date_received").limit(40).collect()]
    some = dated.filter(F.col("date_received") <= days[-1])
    undated = some.limit(3).withColumn("date_received", F.lit(None).cast("date"))
    c = some.union(undated).cache()
    first, second = c.filter(F.col("date_received") < days[20]), c.filter(~(F.col("date_received") < days[20]) | F.col("date_received").isNull())
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    marts.refresh_days(c, one)
    want = plain_rows(marts.base_table(c))
    assert first.count() and second.count()
    assert plain_rows(marts.read_days(spark, one, c.schema)) == want
    stale = second.withColumn("product", F.lit("stale"))
    for part in (first, stale, second, second):  # days counted wrongly before, and a day counted twice
        marts.refresh_days(part, two)
    assert plain_rows(marts.read_days(spark, two, c.schema)) == want
    names = sorted(p.name for p in (tmp_path / "two").iterdir() if p.is_dir())
    assert len(names) == c.select("date_received").distinct().count() and "date_received=__HIVE_DEFAULT_PARTITION__" in names
    counts = marts.family_counts(marts.read_days(spark, two, c.schema))
    for name in ("top_companies", "response_share", "issue_counts_known"):
        got = marts.report_tables(c, *lookups, counts)[name]
        assert scans(got, two) == 1 and plain_rows(got) == plain_rows(marts.report_tables(c, *lookups)[name])


def test_sql_with_a_list_parameter_gives_the_same(spark):
    c = star_complaints(spark, SF, [RESPONSE, "consumer_disputed"])
    sql = f"""
        SELECT {RESPONSE} AS response, string(consumer_disputed) AS dispute, count(*) AS n FROM {{c}}
        WHERE array_contains(:responses, {RESPONSE}) AND consumer_disputed IS NOT NULL GROUP BY ALL"""
    theirs = spark.sql(sql, args={"responses": list(DISPUTE_RESPONSES)}, c=c)
    ours = outcomes.dispute_by_response(c)
    assert {(r[0], r[1].title(), r[2]) for r in theirs.collect()} == {tuple(r) for r in ours.collect()}


def test_a_saved_model_scores_without_a_shuffle_of_its_counts(spark, tmp_path):
    t = star_narratives(spark, SF)
    model = learn(text.training_set(t))
    save_model(model, str(tmp_path / "model"), parts=6)
    other = spark.newSession()  # with a catalog of its own
    loaded = load_model(other, str(tmp_path / "model"))
    assert (loaded.classes, loaded.smoothing, loaded.buckets) == ((0.0, 1.0), 1.0, None)
    texts = star_narratives(other, SF)
    other.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    df = score_texts(loaded, texts, frequent_share=0.01)
    mine = {r.id: r for r in df.collect()}
    theirs = {r.id: r for r in score_texts(model, t).collect()}
    assert mine.keys() == theirs.keys()
    for i, r in theirs.items():
        assert mine[i].prediction == r.prediction and mine[i].prob_max == pytest.approx(r.prob_max, abs=1e-9)
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # of the two sides of a join by token only the texts are shuffled, into as many parts as the counts have
    shuffled = [line for line in plan.splitlines() if "Exchange hashpartitioning(h1" in line]
    assert plan.count("SortMergeJoin [h1") == len(shuffled) > 0 and all(", 6)" in line for line in shuffled)
    save_model(model, str(tmp_path / "model"), parts=3)  # a model is replaced
    again = score_texts(load_model(spark, str(tmp_path / "model")), t)
    assert {r.id: r.prediction for r in again.collect()} == {i: r.prediction for i, r in theirs.items()}


def test_rows_of_a_frequent_text_spread(spark):
    train = spark.createDataFrame([("refund loan", 1.0), ("agent letter", 0.0)], f"{NARRATIVE} string, label double")
    many = spark.range(3000).selectExpr(
        "id", f"CASE WHEN id % 3 = 0 THEN 'refund loan' WHEN id % 3 = 1 THEN null ELSE concat('letter ', id) END AS {NARRATIVE}"
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = score_texts(learn(train), many, frequent_share=0.1)
        sizes = [len(p) for p in df.rdd.glom().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = {r.id: r.prediction for r in df.collect()}
    assert len(got) == 3000 and all(got[i] == float(i % 3 == 0) for i in range(3000))
    assert max(sizes) < 2 * 3000 / len(sizes)
