"""Scaling probe: the case build on generated survey tables of growing size (not a registered query).

Usage: python tools/scale_probe.py [families ...] [--hot]
       python tools/scale_probe.py --intake [responses ...]

Tables are generated with ``spark.range`` (no input files): 10 members,
3 need rows and 1 damage row per family. With ``--hot`` family 0 additionally
holds a third of all member rows. For each size the full build (flags,
counts, need summaries, score, numbering, Parquet case table) runs once after
a warm-up; prints one JSON line per size with seconds and rows per second.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from caseload import schema as S  # noqa: E402
from caseload.operators.cases import REGISTRATION_COLUMNS, build_cases  # noqa: E402
from caseload.operators.scoring import number_cases, score  # noqa: E402
from caseload.schema import CaseTables, DamageCols, MainCols, MemberCols, NeedsCols  # noqa: E402
from caseload.session import local_session, materialize  # noqa: E402


def tables(spark, families: int, hot: bool) -> CaseTables:
    parts = max(8, families // 250_000)
    f = spark.range(0, families, 1, parts)
    main = f.select(
        F.col("id").alias(MainCols.ID),
        F.concat(F.lit("G"), (F.col("id") % 14).cast("string")).alias(MainCols.GOVERNORATE),
        F.concat(F.lit("D"), (F.col("id") % 300).cast("string")).alias(MainCols.DISTRICT),
        F.element_at(F.array(*[F.lit(v) for v in (*S.DISPLACED_TYPES, S.HOST_COMMUNITY)]),
                     (F.col("id") % 4 + 1).cast("int")).alias(MainCols.DISPLACEMENT_TYPE),
        F.element_at(F.array(*[F.lit(v) for v in (S.HOUSING_OWN, S.HOUSING_RENTING, S.HOUSING_HOMELESS)]),
                     (F.col("id") % 3 + 1).cast("int")).alias(MainCols.HOUSING_TYPE),
        (F.col("id") % 9).cast("double").alias(MainCols.FAMILY_SIZE),
        (F.col("id") % 4).cast("double").alias(MainCols.BREADWINNERS),
    )
    m = spark.range(0, families * 10, 1, parts * 4)
    fid = (F.col("id") % families)
    if hot:
        fid = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(fid)
    members = m.select(
        fid.alias(MemberCols.FAMILY_ID),
        F.when(F.col("id") % 10 == 0, F.lit(S.YES)).otherwise(F.lit(S.NO)).alias(MemberCols.IS_HOH),
        F.when(F.col("id") % 2 == 0, F.lit(S.FEMALE)).otherwise(F.lit(S.MALE)).alias(MemberCols.GENDER),
        F.lit(S.WIDOW_MARITAL[0]).alias(MemberCols.MARITAL_STATUS),
        F.lit(S.PRESENT).alias(MemberCols.INDIVIDUAL_STATUS),
        (F.col("id") % 53 == 0).cast("double").alias(MemberCols.V_CHRONIC_DISEASE),
        (F.col("id") % 97 == 0).cast("double").alias(MemberCols.V_IMMEDIATE_HEALTH),
        (F.col("id") % 83 == 0).cast("double").alias(MemberCols.V_MENTAL_DISABILITY),
    )
    n = spark.range(0, families * 3, 1, parts * 2)
    programs = [S.PROGRAM_FOOD, S.PROGRAM_MEDICAL, S.PROGRAM_FINANCIAL, S.PROGRAM_LEGAL]
    needs = n.select(
        (F.col("id") % families).alias(NeedsCols.FAMILY_ID),
        F.element_at(F.array(*[F.lit(p) for p in programs]), (F.col("id") % 4 + 1).cast("int")).alias(NeedsCols.PROGRAM),
        F.when(F.col("id") % 20 == 0, F.lit(S.BABY_NEEDS[0])).otherwise(F.lit(S.NEED_BLANKETS)).alias(NeedsCols.CLASSIFICATION),
        F.when(F.col("id") % 2 == 0, F.lit(S.YES)).otherwise(F.lit(S.NO)).alias(NeedsCols.SERVICE_RECEIVED),
    )
    d = spark.range(0, families, 1, parts)
    damage = d.select((F.col("id") * 7 % families).alias(DamageCols.FAMILY_ID),
                      F.lit(S.DAMAGE_CATEGORIES[0]).alias(DamageCols.CATEGORY))
    return CaseTables(main=main, members=members, damage=damage, needs=needs)


def build(spark, families: int, hot: bool) -> float:
    t0 = time.perf_counter()
    materialize(number_cases(score(build_cases(tables(spark, families, hot))), tie=REGISTRATION_COLUMNS)).count()
    return time.perf_counter() - t0


def intake_run(spark, responses: int) -> float:
    """Parse, score and number ``responses`` generated model responses after a 100,000-family caseload."""
    from caseload.operators import intake
    r = spark.range(0, responses, 1, max(8, responses // 500_000))
    good = F.concat(F.lit('note: {"family_size": "'), (F.col("id") % 10).cast("string"),
                    F.lit('", "city": "C'), (F.col("id") % 97).cast("string"),
                    F.lit('", "housing_type": "'), F.lit(S.HOUSING_HOMELESS),
                    F.lit('", "breadwinners": "'), (F.col("id") % 3).cast("string"), F.lit('"} end'))
    texts = r.select(F.col("id").alias("intake_id"),
                     F.when(F.col("id") % 17 == 0, F.lit("note {broken")).otherwise(good).alias("response"))
    existing = materialize(number_cases(score(build_cases(tables(spark, 100_000, False))), tie=REGISTRATION_COLUMNS))
    t0 = time.perf_counter()
    out = intake.append(existing, intake.score_intake(intake.parse_responses(texts)))
    out.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    args = [a for a in sys.argv[1:] if not a.startswith("--")]
    hot = "--hot" in sys.argv
    if "--intake" in sys.argv:
        spark = local_session(shuffle_partitions=16, app="caseload-scale")
        intake_run(spark, 10_000)  # warm-up
        for n in [int(a) for a in args] or [1_000_000, 10_000_000]:
            sec = intake_run(spark, n)
            print(json.dumps({"responses": n, "sec": round(sec, 2), "responses_per_sec": int(n / sec)}))
        return
    sizes = [int(a) for a in args] or [100_000, 300_000, 1_000_000]
    spark = local_session(shuffle_partitions=16, app="caseload-scale")
    build(spark, 10_000, hot)  # warm-up
    for n in sizes:
        sec = build(spark, n, hot)
        rows = n * 15  # main + 10 members + 3 needs + 1 damage per family
        print(json.dumps({"families": n, "input_rows": rows, "hot_family": hot, "sec": round(sec, 2),
                          "input_rows_per_sec": int(rows / sec)}))


if __name__ == "__main__":
    main()
