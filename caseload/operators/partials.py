"""Reports kept up to date by mergeable parts.

Every total of the needs report and the overview is a count or a sum, so the totals of a table are
the sums of the totals of its parts. A part is one row of totals and one row per city; whoever adds
rows to the caseload stores the part of just these rows, partitioned by ``intake_batch``, and a
replayed batch overwrites its own. A report after any number of batches reads a row
per batch and never the caseload.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseload import schema as S
from caseload.functions.scalars import num
from caseload.operators import planning
from caseload.operators.planning import _sig_sql, summary_aggregates

#: The batch number of what was there before the first batch.
BASE_BATCH = -1
CITY_SCHEMA = "city string, families bigint, score_sum double, score_n bigint, intake_batch bigint"


def totals_part(df: DataFrame) -> DataFrame:
    """One row: the totals of the needs report, people, families per tier and per signal."""
    size = "try_cast(family_size AS DOUBLE)"
    tiers = [f"count_if(priority_tier = '{t}') AS tier_{t.lower()}" for t in S.TIER_ORDER]
    signals = [f"count_if({_sig_sql(df, c)}) AS signal_{c}" for c, _ in S.SIGNAL_LABELS]
    people = f"coalesce(sum(CASE WHEN isnan({size}) THEN NULL ELSE {size} END), CAST(0 AS DOUBLE)) AS people"
    return df.selectExpr(*summary_aggregates(df), people, *tiers, *signals)


def city_part(df: DataFrame) -> DataFrame:
    """Per non-null city: families, and sum and count of the scores."""
    score = num(F.col("priority_score"))
    return df.where("city is not null").groupBy("city").agg(
        F.count(F.lit(1)).alias("families"), F.coalesce(F.sum(score), F.lit(0.0)).alias("score_sum"), F.count(score).alias("score_n"))


def _paths(root: str) -> tuple[str, str]:
    return os.path.join(root, "totals"), os.path.join(root, "cities")


def store(df: DataFrame, root: str, batch_id: int) -> None:
    """Store the part of ``df``'s rows under ``root``; the same batch overwrites its own."""
    for part, path in zip((totals_part(df), city_part(df)), _paths(root)):
        (part.withColumn("intake_batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("intake_batch").parquet(path))


def totals(spark: SparkSession, root: str) -> DataFrame:
    """One row: the sums of all stored totals, the ``summary`` of the report functions."""
    parts = spark.read.parquet(_paths(root)[0]).drop("intake_batch")
    return parts.agg(*[F.sum(c).cast(t).alias(c) for c, t in parts.dtypes])


def cities(spark: SparkSession, root: str) -> DataFrame:
    """One row per city: the sums of all stored parts."""
    parts = spark.read.schema(CITY_SCHEMA).parquet(_paths(root)[1])
    return parts.groupBy("city").agg(*[F.sum(c).alias(c) for c in ("families", "score_sum", "score_n")])


def needs_report(spark: SparkSession, root: str) -> DataFrame:
    """The whole needs report (needs, rations, medical, budget) from the stored parts."""
    return planning.needs_report_table(None, summary=totals(spark, root))


def headline(spark: SparkSession, root: str) -> DataFrame:
    """Families, individuals and families per tier from the stored parts."""
    return totals(spark, root).select("families", F.col("people").cast("bigint").alias("individuals"),
                                      *[F.col(f"tier_{t.lower()}").alias(t.lower()) for t in S.TIER_ORDER])


def signal_totals(spark: SparkSession, root: str) -> DataFrame:
    """Families per vulnerability signal from the stored parts (A15), ascending."""
    structs = [F.struct(F.lit(label).alias("signal"), F.lit(c).alias("column"), F.col(f"signal_{c}").alias("families"))
               for c, label in S.SIGNAL_LABELS]
    return totals(spark, root).select(F.inline(F.array(*structs))).orderBy("families", "signal")


def top_cities(spark: SparkSession, root: str, n: int = 10) -> DataFrame:
    """Cities with most families from the stored parts (A14); ties by name."""
    return cities(spark, root).select("city", "families").orderBy(F.desc("families"), "city").limit(n)


def mean_scores(spark: SparkSession, root: str, n: int = 10) -> DataFrame:
    """Cities with the highest mean score from the stored parts (A17); ties by name."""
    mean = (F.col("score_sum") / F.nullif(F.col("score_n"), F.lit(0))).alias("avg_value")
    return cities(spark, root).select("city", mean).orderBy(F.desc("avg_value"), "city").limit(n)
