"""Numbering (W1): contiguous in order, balanced ranges, one wide pass, nothing left behind."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from caseload.operators.cases import REGISTRATION_COLUMNS, build_cases
from caseload.operators.scoring import number_cases, range_tagged
from caseload.session import checkpoint_dir
from caseload.sources import adapters

from conftest import SF


def folder(spark) -> set[str]:
    root = checkpoint_dir(spark).removeprefix("file:")
    return set(os.listdir(root)) if os.path.isdir(root) else set()


@pytest.mark.parametrize("parts", [1, 2, 7, 50])
def test_numbers_follow_the_order(spark, parts):
    df = spark.range(0, 5000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, F.lit(None).cast("bigint")).otherwise(F.col("id") * 7919 % 1000).alias("family_id"),
        F.concat(F.lit("c"), F.col("id")).alias("city"))
    before = folder(spark)
    rows = number_cases(df, start=11, num_partitions=parts).collect()
    assert folder(spark) == before
    assert sorted(r.family_num for r in rows) == list(range(11, 5011))
    ordered = [r.family_id for r in sorted(rows, key=lambda r: r.family_num)]
    known = [i for i in ordered if i is not None]
    assert ordered == sorted(known) + [None] * (5000 - len(known))
    assert len({r.city for r in rows}) == 5000


def test_ranges_are_balanced_with_a_third_of_rows_without_key(spark):
    df = spark.range(0, 60_000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, F.lit(None).cast("bigint")).otherwise(F.col("id")).alias("family_id"), F.col("id").alias("x"))
    sizes = [r["count"] for r in range_tagged(df, "family_id", 40).groupBy(F.shiftright("_rid", 33)).count().collect()]
    assert len(sizes) == 40 and max(sizes) < 2 * 60_000 / 40


def test_several_keys_and_text(spark):
    df = spark.createDataFrame([("b", 2), ("a", 3), (None, 1), ("b", 1), ("a", 3)], "k string, v int")
    rows = sorted((r.family_num, r.k, r.v) for r in number_cases(df, order_by=["k", "v"], num_partitions=3).collect())
    assert rows == [(1, "a", 3), (2, "a", 3), (3, "b", 1), (4, "b", 2), (5, None, 1)]
    assert number_cases(df.limit(0), order_by="k").collect() == []


def test_narrow_passes_read_the_registrations_only(spark):
    """The splitters and counts drop every join of the case build; the children are read once, by the wide pass."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        built = build_cases(adapters.case_tables(spark, SF))
        plain = built._jdf.queryExecution().optimizedPlan().toString()
        numbered = number_cases(built, tie=REGISTRATION_COLUMNS)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for column in ("o_orderpriority", "l_linestatus", "l_returnflag"):
        scans = lambda text: sum(column in line and "Relation" in line for line in text.splitlines())  # noqa: E731, B023
        assert scans(numbered) == scans(plain) > 0


def test_few_rows_make_few_ranges(spark):
    rows = spark.range(0, 500, 1, 6).select(F.col("id").alias("family_id"))
    assert number_cases(rows).select(F.spark_partition_id()).distinct().count() == 1
    assert sorted(r.family_num for r in number_cases(rows).collect()) == list(range(1, 501))
