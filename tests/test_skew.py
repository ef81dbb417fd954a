"""Hot keys: one family holding a third of all child rows must not reach one task whole.

The shuffle metrics of the executed plan show how many records each exchange
wrote: with map-side partial aggregation it is at most one row per (map task,
family), however many child rows the hot family has.
"""

from __future__ import annotations

import contextlib

import pytest
from pyspark.sql import functions as F

from caseload import schema as S
from caseload.operators.cases import damage_signals, member_signals, need_signals
from caseload.operators.scoring import _ID_BITS, number_cases, range_tagged

ROWS, MAPS, FAMILIES = 60_000, 8, 1_000


@contextlib.contextmanager
def static_plan(spark):
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


def shuffle_records(df) -> int:
    """Run ``df`` and return the records written by all its shuffle exchanges."""
    qe = df._jdf.queryExecution()
    df.write.format("noop").mode("overwrite").save()
    total, stack = 0, [qe.executedPlan()]
    while stack:
        node = stack.pop()
        if node.nodeName() == "Exchange":
            total += node.metrics().apply("shuffleRecordsWritten").value()
        children = node.children()
        stack.extend(children.apply(i) for i in range(children.size()))
    return total


def hot_family(spark, n=ROWS):
    """Child keys where family 0 holds a third of the rows."""
    r = spark.range(0, n, 1, MAPS)
    return r.select(F.when(r.id % 3 == 0, F.lit(0)).otherwise(r.id % FAMILIES + 1).alias("fid"), r.id.alias("k"))


def test_members_hot_family(spark):
    keys = hot_family(spark)
    members = keys.select(
        F.col("fid").alias(S.MemberCols.FAMILY_ID),
        F.lit(S.YES).alias(S.MemberCols.IS_HOH), F.lit(S.FEMALE).alias(S.MemberCols.GENDER),
        F.lit(S.WIDOW_MARITAL[0]).alias(S.MemberCols.MARITAL_STATUS),
        F.lit(S.PRESENT).alias(S.MemberCols.INDIVIDUAL_STATUS),
        (F.col("k") % 53 == 0).cast("double").alias(S.MemberCols.V_CHRONIC_DISEASE),
    )
    with static_plan(spark):
        agg = member_signals(members)
        written = shuffle_records(agg)
    assert written <= MAPS * (FAMILIES + 1)  # one row per (map task, family), not 20,000 for family 0
    hot = agg.where("family_id = 0").first()
    assert hot["member_count"] == ROWS // 3 and hot["_m_widow"]


def test_needs_hot_family(spark):
    keys = hot_family(spark)
    needs = keys.select(
        F.col("fid").alias(S.NeedsCols.FAMILY_ID),
        F.when(F.col("k") % 5 == 0, F.lit(S.PROGRAM_MEDICAL)).otherwise(F.lit(S.PROGRAM_FOOD)).alias(S.NeedsCols.PROGRAM),
        F.lit(S.NEED_BLANKETS).alias(S.NeedsCols.CLASSIFICATION), F.lit(S.NO).alias(S.NeedsCols.SERVICE_RECEIVED),
    )
    with static_plan(spark):
        agg = need_signals(needs)
        written = shuffle_records(agg)
    # first exchange: ≤ one row per (map task, family, program); second: distinct (family, program) pairs
    assert written <= MAPS * (FAMILIES + 1) * 2 + (FAMILIES + 1) * 2
    hot = agg.where("family_id = 0").first()
    assert hot["need_type"] == f"{S.PROGRAM_FOOD}, {S.PROGRAM_MEDICAL}"


def test_damage_hot_family(spark):
    keys = hot_family(spark)
    damage = keys.select(F.col("fid").alias(S.DamageCols.FAMILY_ID),
                         F.element_at(F.array(*[F.lit(c) for c in S.DAMAGE_CATEGORIES]),
                                      (F.col("k") % 3 + 1).cast("int")).alias(S.DamageCols.CATEGORY))
    with static_plan(spark):
        agg = damage_signals(damage)
        written = shuffle_records(agg)
    assert written <= MAPS * (FAMILIES + 1)
    assert agg.where("family_id = 0").first()["damage_categories"] == [S.DAMAGE_CATEGORIES[0]]


@pytest.mark.parametrize("parts", [4, 8])
def test_numbering_splits_hot_id(spark, parts):
    keys = hot_family(spark, 30_000).select(F.col("fid").alias("family_id"), "k")
    tagged = range_tagged(keys, "family_id", parts)
    sizes = [r["n"] for r in tagged.groupBy(F.shiftright("_rid", _ID_BITS).alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 30_000
    assert max(sizes) <= 2 * 30_000 / parts  # the 10,000-row id is spread over several ranges
    nums = number_cases(keys, num_partitions=parts)
    agg = nums.agg(F.min("family_num"), F.max("family_num"), F.count_distinct("family_num")).first()
    assert tuple(agg) == (1, 30_000, 30_000)
    # numbers follow the id order
    bad = nums.where("family_id = 0 AND family_num > 10000").count()
    assert bad == 0
