"""The command-line jobs end to end on the golden fixture: CSV exports → anonymised tables → cases → report."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import functions as F

from caseload import cli
from caseload import schema as S
from caseload.sources import tables


def test_anonymize_build_report(spark, golden_tables, golden_cases):
    root = tempfile.mkdtemp(prefix="caseload-cli-")
    exports = os.path.join(root, "exports")
    os.makedirs(exports)
    names = {"main": "Registrations.csv", "members": "FamilyMembers.csv", "damage": "Damag_Group.csv",
             "needs": "Needsgroup.csv"}
    for role, df in golden_tables.as_dict().items():
        pdf = df.toPandas()
        if role == "members":  # raw exports still hold PII and free text
            pdf["الاسم الاول"] = "x"
            pdf[S.MemberCols.DATE_OF_BIRTH] = "1985-03-02"
            pdf[S.MemberCols.OCCUPATION_TEXT] = "طالب"
        pdf.to_csv(os.path.join(exports, names[role]), index=False)

    anon, cases_dir, out = (os.path.join(root, x) for x in ("anon", "cases", "report"))
    assert cli.main(["anonymize", "--input", exports, "--output", anon]) == 0
    members = spark.read.parquet(os.path.join(anon, "members"))
    assert "الاسم الاول" not in members.columns and S.MemberCols.DATE_OF_BIRTH not in members.columns
    assert {r[0] for r in members.select(S.MemberCols.BIRTH_YEAR).collect()} == {1985}

    assert cli.main(["build", "--input", anon, "--output", cases_dir]) == 0
    cols = ["family_id", "family_num", "priority_score", "priority_tier", "need_type", *S.SIGNALS]
    built = spark.read.parquet(cases_dir).select(cols)
    assert sorted(built.collect()) == sorted(golden_cases.select(cols).collect())

    assert cli.main(["report", "--cases", cases_dir, "--output", out]) == 0
    budget = spark.read.option("header", True).csv(os.path.join(out, "budget"))
    assert budget.where(F.col("category") == "Grand Total").first()["total_usd"] == "1180"
    assert spark.read.option("header", True).csv(os.path.join(out, "priority_list")).count() == 6

    homeless = os.path.join(root, "report_homeless")
    assert cli.main(["report", "--cases", cases_dir, "--output", homeless,
                     "--filter", '{"col": "is_homeless", "op": "is_true"}']) == 0
    assert spark.read.option("header", True).csv(os.path.join(homeless, "priority_list")).count() == 1


def test_build_partitioned_by_governorate(spark, golden_tables):
    root = tempfile.mkdtemp(prefix="caseload-cli-")
    survey = os.path.join(root, "survey")
    for role, df in golden_tables.as_dict().items():
        df.write.parquet(os.path.join(survey, role))
    out = os.path.join(root, "cases")
    assert cli.main(["build", "--input", survey, "--output", out, "--partition-by", "governorate"]) == 0
    assert sorted(d for d in os.listdir(out) if d.startswith("governorate=")) == ["governorate=G1", "governorate=G2"]
    g1 = spark.read.parquet(out).where(F.col("governorate") == "G1")
    assert "PartitionFilters: [isnotnull(governorate" in g1._jdf.queryExecution().executedPlan().toString()
    assert sorted(r[0] for r in g1.select("family_id").collect()) == [1, 2, 3]


def test_intake_writes_the_new_rows_only(spark, golden_cases, tmp_path):
    cases, responses, first, second = (str(tmp_path / x) for x in ("cases", "responses", "first", "second"))
    golden_cases.write.parquet(cases)
    rows = [(1, '{"city": "Q", "family_size": "3"}'), (1, '{"city": "R"}'), (2, "bad"), (None, '{"city": "N"}')]
    spark.createDataFrame(rows, "intake_id bigint, response string").write.parquet(responses)
    assert cli.main(["intake", "--responses", responses, "--cases", cases, "--output", first]) == 0
    assert spark.read.parquet(first).count() == 2
    assert cli.main(["intake", "--responses", responses, "--cases", f"{cases},{first}", "--output", second]) == 0
    assert spark.read.parquet(second).count() == 1  # only the record without id cannot be known again
    whole = tables.load_caseload(spark, [cases, first, second])
    assert whole.columns == golden_cases.columns
    assert sorted(r[0] for r in whole.select("family_num").collect()) == list(range(1, 10))
    out = str(tmp_path / "report")
    assert cli.main(["report", "--cases", f"{cases},{first}", "--output", out]) == 0
    assert spark.read.option("header", True).csv(os.path.join(out, "priority_list")).count() == 8


def test_stream_ends_with_reports_over_caseload_and_intake(spark, golden_cases, tmp_path):
    cases, responses, out = (str(tmp_path / x) for x in ("cases", "responses", "out"))
    golden_cases.write.parquet(cases)
    spark.createDataFrame([(1, '{"city": "Q"}'), (2, "bad")], "intake_id bigint, response string").write.parquet(responses)
    assert cli.main(["intake", "--responses", responses, "--cases", cases, "--output", out, "--stream"]) == 0
    headline = spark.read.option("header", True).csv(os.path.join(out, "headline")).first()
    assert headline.families == str(golden_cases.count() + 1)


def test_partitioned_build_writes_few_files(spark, golden_tables, tmp_path):
    big = golden_tables.main.crossJoin(spark.range(2000)).drop("id").repartition(8)  # a governorate holds half of the rows
    big.write.parquet(str(tmp_path / "survey/main"))
    for role in ("members", "damage", "needs"):
        golden_tables.as_dict()[role].write.parquet(str(tmp_path / "survey" / role))
    out = tmp_path / "cases"
    assert cli.main(["build", "--input", str(tmp_path / "survey"), "--output", str(out), "--partition-by", "governorate"]) == 0
    files = {d.name: len(list(d.glob("*.parquet"))) for d in out.iterdir() if d.is_dir()}
    assert set(files) == {"governorate=G1", "governorate=G2"} and max(files.values()) <= 2
    assert spark.read.parquet(str(out)).count() == 12_000
