"""Inputs as they really arrive: references that are no numbers, sheets without row numbers, empty subgroups."""

import pytest
from pyspark.sql import functions as F

from tagweave.operators.combine import combine_sources, pre_clean
from tagweave.operators.dedup import dedup_exact
from tagweave.operators.metrics import metric_suite
from tagweave.operators.numbering import number_rows
from tagweave.sources.readers import combine_survey_years, load_sheet, read_second_source, read_survey_year

COLS = "project_id string, project_title string, scientific_abstract string, ukcrc_value string, hrcs_rac_category string, ukcrc_value_rac string"


def second(spark, ids):
    rows = [(i, f"title {n}", f"abstract {n}", "cancer", "2 Aetiology", "2.1 Factors") for n, i in enumerate(ids)]
    return read_second_source(spark.createDataFrame(rows, COLS))


def test_references_that_are_no_numbers_keep_their_rows(spark):
    ids = ["NIHR200033", "17/44/42", "12345", None, "99999999999999999999", "-7", "NIHR200033"]
    got = pre_clean(second(spark, ids)).collect()
    assert sorted(r["index"] for r in got) == list(range(len(ids)))
    assert dedup_exact(pre_clean(second(spark, ids)), "AwardTitle", ["index"]).count() == len(ids)


def test_sheet_without_row_numbers(spark):
    cols = "FundingOrganisation string, OrganisationReference string, AwardTitle string, AwardAbstract string, CodingType string, RA_1 string, HC_1 string"
    raw = spark.createDataFrame([("F", "a", "t1", "x", "Manual", "2.1", "Cancer"), ("F", "b", "t2", "x", "Manual", "2.1", None)], cols)
    years = [read_survey_year(raw, 2018), read_survey_year(raw, 2022)]
    got = combine_survey_years(years).collect()
    assert len(got) == 2 and all(r["src_row"] is not None and r["src_year"] == 2022 for r in got)


def test_subgroup_scores_only_when_computed(spark):
    truth = spark.createDataFrame([("1", "1.1"), ("2", "2.1")], "row_id string, label string")
    for meta, scopes in (([("1", "Wellcome Trust"), ("2", "Other")], {"all", "sub"}), ([("1", "Other"), ("2", "Other")], {"all"}),
                         ([("1", "Wellcome Trust")], {"all"})):
        got = metric_suite(truth, truth, spark.createDataFrame(meta, "row_id string, FundingOrganisation string"))
        assert {r["scope"] for r in got.collect()} == scopes


SHEET = ("FundingOrganisation string, OrganisationReference string, AwardTitle string, AwardAbstract string, CodingType string, "
         "RA_1 string, HC_1 string")


@pytest.fixture
def many_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_equal_references_get_different_row_ids(many_partitions):
    ids = ["123", "123", "0123", " 123", None, None, "NIHR1"] * 30
    got = pre_clean(second(many_partitions, ids))
    assert sorted(r["index"] for r in got.collect()) == list(range(len(ids)))
    copies = many_partitions.range(0, 5000, 1, 40).select(F.lit("same").alias("t"), F.lit(1).alias("k"))
    numbered = number_rows(copies, ["k"]).withColumn("p", F.spark_partition_id())
    assert sorted(r["index"] for r in numbered.collect()) == list(range(5000))
    assert number_rows(copies.limit(0), ["k"]).count() == 0


def test_numbers_follow_the_order(many_partitions):
    df = many_partitions.range(0, 3000, 1, 17).select(F.pmod(F.xxhash64("id"), F.lit(97)).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("b"), "id")
    rows = sorted(number_rows(df, ["a", "b"], "n", 10).collect(), key=lambda r: r["n"])
    assert [r["n"] for r in rows] == list(range(10, 3010))
    keys = [(r["a"], r["b"] is not None, r["b"] or 0) for r in rows]
    assert keys == sorted(keys)


def test_newest_year_wins_without_sheet_rows(spark):
    def sheet(year):
        return read_survey_year(spark.createDataFrame(
            [("F", f"{year}-{i}", "title", f"the same text {i}", "Manual", "2.1", None) for i in range(400)], SHEET), year)

    survey = combine_survey_years([sheet(2018), sheet(2022)])
    p = pre_clean(combine_sources(survey, second(spark, ["x"])))
    years = {r["index"]: r["src_year"] for r in p.filter("src_rank = 0").collect()}
    assert max(i for i, y in years.items() if y == 2018) < min(i for i, y in years.items() if y == 2022)
    kept = dedup_exact(p, "AwardAbstract", ["index"]).filter("src_rank = 0").collect()
    assert len(kept) == 400 and {r["src_year"] for r in kept} == {2022}


def test_sheet_rows_are_file_positions(spark, tmp_path):
    rows = [("F", f"r{i}", f"t{i}", "x" * (i % 50), "Manual", "2.1", "Cancer") for i in range(2000)]
    with open(tmp_path / "sheet.csv", "w") as f:
        f.write("\n".join(",".join(r) for r in rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")      # several blocks of one file
    got = load_sheet(spark, str(tmp_path / "sheet.csv"), "csv", SHEET).collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["sheet_row"], r["OrganisationReference"]) for r in got) == [(i + 1, f"r{i}") for i in range(2000)]
