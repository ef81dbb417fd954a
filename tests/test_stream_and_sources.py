"""Streaming parity / idempotent replay (T1) and CSV/Parquet round trips."""

from __future__ import annotations

import glob
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from caseload import schema as S
from caseload.operators import intake, privacy
from caseload.operators.scoring import number_cases
from caseload.sources import adapters, tables
from caseload.streaming.intake_stream import process_batch, start_stream

from conftest import SF


def _scratch():
    return tempfile.mkdtemp(prefix="caseload-test-")


def test_stream_equals_batch_and_replay_is_idempotent(spark):
    root = _scratch()
    src = os.path.join(root, "src")
    responses = adapters.intake_texts(spark, SF)
    responses.write.parquet(src)
    table, quarantine, ckpt = (os.path.join(root, x) for x in ("table", "quarantine", "ckpt"))
    start_stream(spark, src, table, quarantine, ckpt).awaitTermination()

    streamed = spark.read.parquet(table).drop("intake_batch")
    batch = number_cases(intake.score_intake(intake.parse_responses(responses)), order_by="intake_id")
    cols = ["family_num", "family_id", "priority_score", "city", "family_size"]
    assert sorted(streamed.select(cols).collect()) == sorted(batch.select(cols).collect())
    n_bad = spark.read.parquet(quarantine).count()
    n_good = streamed.count()
    assert n_bad + n_good == responses.count() and n_bad > 0

    # replaying batch 0 (e.g. after a failure before the commit) must not add rows
    process_batch(spark.read.parquet(src), 0, table, quarantine)
    assert spark.read.parquet(table).count() == n_good
    # a later batch continues the numbering after the current maximum
    extra = spark.createDataFrame([(10**9, '{"family_size": "3", "city": "Z"}')], "intake_id bigint, response string")
    process_batch(extra, 1, table, quarantine)
    after = spark.read.parquet(table)
    assert after.agg(F.max("family_num")).first()[0] == n_good + 1


def test_append_continues_numbering(spark, golden_cases):
    new = spark.createDataFrame([(7, '{"family_size": "2"}'), (8, '{"city": "Q"}'), (9, "bad")],
                                "intake_id bigint, response string")
    out = intake.append(golden_cases, intake.score_intake(intake.parse_responses(new)))
    nums = sorted(r[0] for r in out.select("family_num").collect())
    assert nums == [1, 2, 3, 4, 5, 6, 7, 8]
    assert out.columns == golden_cases.columns
    assert dict(out.dtypes)["family_id"] == "string"


def test_csv_round_trip_and_routing(spark, golden_tables):
    root = _scratch()
    names = {"main": "main_registrations", "members": "FamilyMembers", "damage": "Damag_Group", "needs": "Needsgroup"}
    paths = []
    for role, df in golden_tables.as_dict().items():
        p = os.path.join(root, names[role])
        df.write.option("header", True).csv(p)
        paths.append(p)
    assert privacy.route_files(paths) == {r: [os.path.join(root, names[r])] for r in S.ROLES}
    raw = tables.load_exports(spark, paths, schemas={
        "main": golden_tables.main.schema, "members": golden_tables.members.schema,
        "damage": golden_tables.damage.schema, "needs": golden_tables.needs.schema})
    assert raw.members.count() == golden_tables.members.count()
    out = os.path.join(root, "anon")
    tables.write_tables(tables.anonymize_tables(raw), out)
    back = tables.load_case_tables(spark, out)
    assert back.main.count() == 6 and back.needs.count() == 8


def test_routing_falls_back_to_sorted_names():
    assert privacy.route_files(["d", "c", "b", "a"]) == {"main": ["a"], "members": ["b"], "damage": ["c"], "needs": ["d"]}
    with pytest.raises(ValueError):
        privacy.route_files(["a", "b"])
    with pytest.raises(ValueError):
        privacy.route_files(["a", "b", "c", "d", "e"])
    several = ["main_2.csv", "members_1.csv", "members_2.csv", "needs.csv", "damage.csv", "main_1.csv"]
    assert privacy.route_files(several) == {"main": ["main_1.csv", "main_2.csv"], "members": ["members_1.csv", "members_2.csv"],
                                            "damage": ["damage.csv"], "needs": ["needs.csv"]}


def test_pii_is_removed_and_checked(spark):
    raw = adapters.raw_main(spark, SF)
    assert privacy.pii_columns(raw)
    with pytest.raises(privacy.PIIError):
        tables.write_tables(S.CaseTables(raw, raw, raw, raw), _scratch())
    clean = privacy.anonymize(raw, "main")
    assert privacy.pii_columns(clean) == []
    members = privacy.anonymize(adapters.raw_members(spark, SF), "members")
    assert S.MemberCols.DATE_OF_BIRTH not in members.columns and S.MemberCols.OCCUPATION_TEXT not in members.columns
    assert {S.MemberCols.BIRTH_YEAR, S.MemberCols.OCCUPATION} <= set(members.columns)


def test_export_csv_with_arrays(spark, golden_cases):
    out = os.path.join(_scratch(), "export")
    tables.export_csv(golden_cases, out, order_by=["family_num"], single_file=True)
    files = glob.glob(os.path.join(out, "*.csv"))
    assert len(files) == 1
    back = spark.read.option("header", True).csv(out)
    assert back.count() == 6 and "needs_programs" in back.columns


def test_schema_less_csv_builds_the_same_cases(spark, golden_tables, golden_cases):
    """All-text columns (CSV read without a schema) give the same case table as typed input."""
    from caseload.operators.cases import build_cases
    from caseload.operators.scoring import number_cases, score
    root = _scratch()
    for role, df in golden_tables.as_dict().items():
        df.write.option("header", True).csv(os.path.join(root, role))
    text_tables = tables.load_case_tables(spark, root, fmt="csv")
    assert all(t == "string" for df in text_tables.as_dict().values() for _, t in df.dtypes)
    got = number_cases(score(build_cases(text_tables)))
    cols = ["family_id", "family_num", "priority_score", "priority_tier", "need_type", "member_count",
            "chronic_disease_members", "disability_members", "school_dropout_children", *S.SIGNALS]
    assert sorted(got.select(cols).collect()) == sorted(golden_cases.select(cols).collect())


def test_null_matrix_gives_false_signals(spark):
    """Every input value null: no errors, every signal false, counts null or zero."""
    from caseload.operators.cases import build_cases
    from caseload.operators.scoring import score
    from conftest import make_tables
    main = [(1, None, None, None, None, None, None, None)]
    members = [(1, None, None, None, None, None, None, None, None, None, None)]
    needs = [(1, None, None, None)]
    damage = [(None, None)]
    r = score(build_cases(make_tables(spark, main, members, needs, damage))).first()
    assert not any(r[s] for s in S.SIGNALS)
    assert (r["priority_score"], r["priority_tier"], r["member_count"], r["need_type"]) == (0, "LOW", 1, "")
    assert r["chronic_disease_members"] is None and r["city"] is None


def test_stream_numbers_continue_across_micro_batches(spark):
    root = _scratch()
    src = os.path.join(root, "src")
    for part in range(3):
        rows = [(part * 100 + i, f'{{"family_size": "{i % 9}", "city": "P{part}"}}') for i in range(20)]
        rows.append((part * 100 + 99, "broken {"))
        spark.createDataFrame(rows, "intake_id bigint, response string").coalesce(1).write.mode("append").parquet(src)
    table, quarantine, ckpt = (os.path.join(root, x) for x in ("table", "quarantine", "ckpt"))
    start_stream(spark, src, table, quarantine, ckpt, start_number=1000,
                 source_options={"maxFilesPerTrigger": 1}).awaitTermination()
    out = spark.read.parquet(table)
    assert out.select("intake_batch").distinct().count() == 3
    nums = sorted(r[0] for r in out.select("family_num").collect())
    assert nums == list(range(1001, 1061))  # contiguous after the existing caseload, 60 parsed rows
    by_batch = {r["intake_batch"]: (r["lo"], r["hi"]) for r in
                out.groupBy("intake_batch").agg(F.min("family_num").alias("lo"), F.max("family_num").alias("hi")).collect()}
    spans = [by_batch[b] for b in sorted(by_batch)]
    assert all(prev[1] < nxt[0] for prev, nxt in zip(spans, spans[1:]))
    assert spark.read.parquet(quarantine).count() == 3
