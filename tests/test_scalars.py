"""Scalar cases of FIXTURES.md §4.4 and the null matrix of the signal predicates."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from caseload import schema as S
from caseload.functions import scalars as X
from caseload.operators import intake
from caseload.operators.scoring import score


def _one(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_occupation_bucket(spark):
    cases = {None: "unknown", "  ": "unknown", "لا يعمل": "no_work", "طالب جامعي": "student",
             "فلاح": "no_work", "غير عامل": "no_work", "عامل": "self_employed", "Driver": "other",
             "ربة منزل": "homemaker", "مزارع": "agriculture", "متقاعد": "retired", "طفل": "child"}
    assert _one(spark, list(cases), X.occupation_bucket) == list(cases.values())


def test_birth_year_forms(spark):
    cases = {"19900506": 1990, "05/06/85": 1985, "1890-05-06 00:00:00": 1890, "5/6/1890": 1890, "1990-25-12": 1990, "31.12.68": 2068,
             "31.12.69": 1969, "1990/5/6T10:20:30.5+03:00": 1990, "19901399": None, "13/13/85": None, "30/2/1890": None, "2/30/1985": 1985,
             "1990 - 5 - 6": 1990, "٦/٥/١٨٩٠": 1890, "5/6": None, "1/2/345": None, "1890": 1890, "29/2/1900": 1900, "29/2/1896": 1896,
             "6 May 1990": 1990, "1990-05-06 25": 1990, "0": None}
    assert _one(spark, list(cases), X.birth_year) == list(cases.values())


def test_birth_year(spark):
    cases = {"1985-03-02": 1985, "1985": 1985, "31/12/1990": 1990, "born 1985": 1985, "2010-13-45": 2010,
             "12": None, "unknown": None, "": None, None: None, "03/02/1985": 1985, "١٩٨٥": 1985}
    assert _one(spark, list(cases), X.birth_year) == list(cases.values())


def test_numeric_coerce(spark):
    cases = {" 5 ": 5.0, "5.7": 5.7, "1e1": 10.0, "abc": None, "": None, "NaN": None}
    assert _one(spark, list(cases), X.num) == list(cases.values())


def test_size_bonus(spark):
    cases = {"2": 0, "3": 5, "4.9": 5, "5": 10, "6": 10, "7": 15, None: 0, "abc": 0, "-8": 0}
    assert _one(spark, list(cases), X.size_bonus) == list(cases.values())


def test_tier_edges(spark):
    cases = {24: "LOW", 25: "MEDIUM", 49: "MEDIUM", 50: "HIGH", 79: "HIGH", 80: "CRITICAL"}
    assert _one(spark, list(cases), X.tier, "int") == list(cases.values())


def test_capitalize(spark):
    assert _one(spark, ["food", "PSYCHOSOCIAL", "x"], X.capitalize) == ["Food", "Psychosocial", "X"]


def test_json_object_strict(spark):
    texts = ['x {"a":1} y {"b":2} z', "no braces", 'pre {"family_size": 5, "city": "X"} post',
             '{"family_size": "5.9"}', '{"a":1},{"b":2}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "intake_id int, response string")
    got = intake.parse_responses(df).orderBy("intake_id").collect()
    assert [r["parse_ok"] for r in got] == [False, False, True, True, False]
    assert got[2]["family_size"] == 5 and got[2]["city"] == "X"
    assert got[3]["family_size"] == 5
    assert got[0]["family_size"] is None


def test_blank_as_zero(spark):
    df = spark.createDataFrame([(1, '{"family_size": "", "breadwinners": null}')], "intake_id int, response string")
    r = intake.parse_responses(df, blank_as_zero=True).first()
    assert (r["family_size"], r["breadwinners"]) == (0, 0)
    r = intake.parse_responses(df).first()
    assert (r["family_size"], r["breadwinners"]) == (None, None)


def test_need_array_strict(spark):
    texts = ['[{"item":"a","category":"food","urgency":"high"}] x [1]', 'ok [{"item":"b"}] done', "none"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "response_id int, response string")
    got = [(r["response_id"], r["item"]) for r in intake.parse_need_items(df).collect()]
    assert got == [(1, "b")]


def test_manual_append_score(spark):
    rows = [(1, S.DISPLACED_TYPES[0], S.HOUSING_HOMELESS, 0, 5, None)]
    df = spark.createDataFrame(
        rows, "intake_id int, displacement_type string, housing_type string, breadwinners bigint, "
              "family_size bigint, city string")
    for f in S.INTAKE_FIELDS:
        if f not in df.columns:
            df = df.withColumn(f, F.lit(None).cast("string"))
    r = intake.score_intake(df).first()
    assert (r["priority_score"], r["priority_tier"], r["city"]) == (95, "CRITICAL", "Unknown")
    assert r["source_file"] == "manual_entry" and len(r["family_id"]) == 32


@pytest.mark.parametrize("value,expected", [(None, False), (True, True), (False, False)])
def test_flag_null_matrix(spark, value, expected):
    df = spark.createDataFrame([(value,)], "b boolean")
    assert df.select(X.flag(F.col("b"))).first()[0] is expected


def test_score_ignores_absent_signals(spark):
    df = spark.createDataFrame([(True, 8.0)], "is_homeless boolean, family_size double")
    r = score(df).first()
    assert (r["priority_score"], r["priority_tier"]) == (55, "HIGH")
