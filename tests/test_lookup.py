"""Single-case lookup and the layout of the written case table: which rows a scan reads, and files per folder."""

from __future__ import annotations

import glob
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from caseload.operators import reports
from caseload.sources.tables import write_cases

ROWS = 60_000


@pytest.fixture(scope="module")
def case_rows(spark):
    """Numbered cases with gaps in the ids; a third of the families are of one governorate."""
    return spark.range(0, ROWS, 1, 4).select(
        (F.col("id") * 3).alias("family_id"), (F.col("id") + 1).alias("family_num"),
        F.when(F.col("id") % 3 == 0, "Gaza").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("governorate"),
        F.sha2(F.col("id").cast("string"), 256).alias("city"))


def scanned(found) -> tuple[int, list]:
    """Rows the scan hands on (whole pages of the row groups it reads), and the result."""
    rows = found.collect()
    leaf = found._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().get("numOutputRows").get().value(), rows


def test_lookup_reads_few_row_groups(spark, case_rows):
    out = tempfile.mkdtemp(prefix="caseload-lookup-")
    write_cases(case_rows, out, row_group_bytes=200_000)
    cases = spark.read.parquet(out)
    for how in ({"family_num": 30_001}, {"family_id": 90_000}, {"family_id": "90000"}):
        read, rows = scanned(reports.find_case(cases, **how))
        assert [(r.family_num, r.family_id) for r in rows] == [(30_001, 90_000)]
        assert 0 < read <= ROWS / 10


def test_absent_id_is_excluded_by_the_bloom_filters(spark, case_rows):
    plain, out = tempfile.mkdtemp(prefix="caseload-plain-"), tempfile.mkdtemp(prefix="caseload-lookup-")
    case_rows.write.mode("overwrite").parquet(plain)
    write_cases(case_rows, out, row_group_bytes=200_000)
    absent = [3 * k + 1 for k in range(500, 550)]  # between the bounds of a row group, of no family
    without, with_filters = (sum(scanned(reports.find_case(spark.read.parquet(p), family_id=i))[0] for i in absent) for p in (plain, out))
    assert without >= len(absent) and with_filters <= without / 10
    assert scanned(reports.find_case(spark.read.parquet(out), family_num=ROWS + 5)) == (0, [])


def test_lookup_arguments(golden_cases):
    assert reports.find_case(golden_cases, family_id="no number").count() == 0
    assert reports.find_case(golden_cases, family_id=4).count() == 1
    by_id = reports.case_profile(golden_cases, family_id=4).collect()
    num = golden_cases.where("family_id = 4").first()["family_num"]
    assert by_id == reports.case_profile(golden_cases, family_num=num).collect() != []
    with pytest.raises(ValueError):
        reports.find_case(golden_cases, family_num=1, family_id=1)


def test_partitioned_write_has_a_bounded_number_of_files(spark, case_rows):
    out = tempfile.mkdtemp(prefix="caseload-folders-")
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "400k")
    try:
        write_cases(case_rows.repartition(40), out, ["governorate"])
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    files = {os.path.basename(d): len(glob.glob(f"{d}/*.parquet")) for d in glob.glob(f"{out}/governorate=*")}
    assert len(files) == 8
    assert files["governorate=Gaza"] > 1  # a third of the families: split
    assert sum(files.values()) <= 40  # 40 tasks would write up to 320
    back = spark.read.parquet(out)
    assert back.count() == ROWS
    read, rows = scanned(reports.find_case(back, family_num=1))
    assert len(rows) == 1 and read < ROWS / 4
