"""Points that once went wrong: strict JSON, null-safe predicates, re-sent records, row order, skewed parents."""

from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caseload import schema as S
from caseload.operators import intake, reports, search
from caseload.operators.cases import build_cases
from caseload.schema import CaseTables, MainCols
from caseload.sources import adapters
from caseload.streaming.intake_stream import process_batch

SF = "/root/testdata/sf0.001"


def one_json(text: str, first: str, last: str, kind: type):
    a, b = text.find(first), text.rfind(last)
    if a < 0 or b < a:
        return None
    try:
        value = json.loads(text[a:b + 1])
    except ValueError:
        return None
    return value if isinstance(value, kind) else None


PIECES = st.sampled_from(['{"city":"A"}', "{", "}", "[", "]", ",", " x ", '{"_end": "1"}', '"a"', ":", "1", '{"city": null}', "[]", "{}"])


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=6), min_size=1, max_size=40))
def test_strict_json_object_and_array(spark, lists):
    texts = ["".join(p) for p in lists] + ['{"city":"A"}]}', '{"city":"A"}] x [{"city":"B"}', '[{"item":"a"}]] x [[{"item":"b"}]']
    df = spark.createDataFrame(list(enumerate(texts)), "intake_id int, response string")
    got = {r.intake_id: (r.parse_ok, r.city) for r in intake.parse_responses(df).collect()}
    for i, text in enumerate(texts):
        value = one_json(text, "{", "}", dict)
        assert got[i] == (value is not None, value.get("city") if value else None), text
    items = intake.parse_need_items(df).groupBy("intake_id").count().collect()
    counts = {r.intake_id: r["count"] for r in items}
    for i, text in enumerate(texts):
        value = one_json(text, "[", "]", list)
        if value is None or all(isinstance(x, dict) for x in value):
            assert counts.get(i, 0) == len(value or []), text


def test_ne_holds_for_a_missing_value(spark):
    df = spark.createDataFrame([(None,), ("a",), ("b",)], "city string")
    rows = search.where(df, {"col": "city", "op": "ne", "value": "a"}).collect()
    assert {r.city for r in rows} == {None, "b"}
    assert {r.city for r in search.where(df, {"not": {"col": "city", "op": "ne", "value": "a"}}).collect()} == {"a"}


@pytest.mark.parametrize("spec", [
    {"col": "city", "op": "is_true"}, {"col": "size", "op": "eq", "value": "four"}, {"col": "size", "op": "in", "value": [1, "x"]},
    {"col": "city", "op": "in", "value": [1]}, {"col": "city", "op": "lt", "value": None}, {"col": "day", "op": "gt", "value": "soon"}])
def test_types_are_checked_before_anything_runs(spark, spec):
    df = spark.createDataFrame([("a", 1.0, None)], "city string, size double, day date")
    with pytest.raises(ValueError):
        search.where(df, spec)
    with pytest.raises(ValueError):
        search.analyse(df, None, "sum", None)


def test_row_order(spark, golden_cases):
    signals = [(r.families, r.signal) for r in reports.signal_totals(golden_cases).collect()]
    assert signals == sorted(signals)
    options = [(r.dimension, r.value) for r in reports.filter_options(golden_cases).collect()]
    assert options == sorted(options)
    needs = spark.createDataFrame([("food", 3), ("medical", 1), ("food", 2), ("baby", 2)], "category string, families_count bigint")
    assert [r.category for r in reports.needs_by_category(needs).collect()] == ["medical", "baby", "food"]


def test_all_groups_without_a_limit(spark):
    df = spark.createDataFrame([(f"c{i:02}", float(i)) for i in range(11)], "city string, score double")
    assert reports.avg_by(df, "city", "score").count() == 11
    assert reports.avg_by(df, "city", "score", n=10).count() == 10


def test_whole_digest_is_the_intake_key(spark):
    df = intake.score_intake(intake.parse_responses(spark.createDataFrame([(1, '{"city": "Q"}')], "intake_id bigint, response string")))
    assert len(df.first().family_id) == 32


RECORDS = "intake_id bigint, response string"


def test_stream_of_malformed_and_repeated_records(spark, tmp_path):
    table, quarantine = f"{tmp_path}/table", f"{tmp_path}/quarantine"
    seen = []
    run = lambda rows, n: process_batch(spark.createDataFrame(rows, RECORDS), n, table, quarantine, start_number=6, on_commit=lambda t: seen.append(t.count()))
    run([(1, "bad"), (2, "{worse")], 0)
    run([(3, '{"city": "A"}'), (3, '{"city": "A"}'), (4, '{"city": "B"}')], 1)
    run([(3, '{"city": "A"}'), (5, '{"city": "C"}')], 2)
    run([(3, '{"city": "A"}'), (5, '{"city": "C"}')], 2)  # replayed
    rows = sorted((r.intake_id, r.family_num) for r in spark.read.parquet(table).collect())
    assert rows == [(3, 7), (4, 8), (5, 9)]
    assert spark.read.parquet(quarantine).count() == 2
    assert seen == [0, 2, 3, 3]


def test_append_adds_a_record_once(spark, golden_cases):
    new = intake.score_intake(intake.parse_responses(spark.createDataFrame([(7, '{"city": "Q"}'), (7, '{"city": "Q"}')], RECORDS)))
    once = intake.append(golden_cases, new)
    assert once.count() == golden_cases.count() + 1
    assert intake.append(once, new).count() == once.count()


def test_registrations_without_id_are_spread(spark):
    t = adapters.case_tables(spark, SF)
    main = t.main
    lost = main.crossJoin(spark.range(20)).drop("id").withColumn(MainCols.ID, F.lit(None).cast("bigint"))
    cases = build_cases(CaseTables(main=main.unionByName(lost), members=t.members, damage=t.damage, needs=t.needs))
    rows = cases.where("family_id is null")
    assert rows.count() == 20 * main.count()
    assert rows.where("is_widow or has_damage or member_count is not null or need_type <> ''").count() == 0
    key = F.coalesce(F.lit(None).cast("bigint"), F.xxhash64(*[F.col(f"`{c}`") for c in main.columns]))
    assert main.select(F.pmod(F.hash(key), F.lit(8)).alias("p")).groupBy("p").count().agg(F.max("count")).first()[0] < main.count() / 3
    assert S.ROLES


def test_stored_tables_get_small_arrow_batches(spark):
    """A stored table's Python steps receive bounded batches; the session's setting is as before."""
    from caseload.session import BATCH_BYTES, drop_table, materialize

    def sizes(batches):
        import pyarrow as pa
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    wide = spark.range(0, 6000, 1, 1).selectExpr("repeat('x', 2000) AS t")
    stored = materialize(wide.mapInArrow(sizes, "n long"))
    assert max(r.n for r in stored.collect()) <= int(BATCH_BYTES) + 4000
    drop_table(stored)
    assert spark.conf.get(key, None) == before
