"""Typed CSV scan with a table of malformed rows (S1); four tables written all or nothing."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from caseload import schema as S
from caseload.schema import CaseTables, MainCols
from caseload.sources import tables, typed_csv

HEADER = f"{MainCols.ID},{MainCols.FAMILY_SIZE},notes,{MainCols.SURVEY_DATE}"


def put(path, *lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_round_trip_keeps_types(spark, golden_tables, tmp_path):
    paths = {}
    for role, df in golden_tables.as_dict().items():
        df.write.option("header", True).csv(str(tmp_path / role))
        paths[role] = sorted(str(p) for p in (tmp_path / role).glob("*.csv"))
    back, errors = typed_csv.scan_tables(spark, paths)
    assert errors.count() == 0
    for role, df in golden_tables.as_dict().items():
        got = back.as_dict()[role]
        assert got.dtypes == df.dtypes
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)


def test_malformed_rows_are_kept_apart(spark, tmp_path):
    path = put(tmp_path / "main.csv", HEADER, "1,4,plain,2024-01-31", '2,5.5,"a, quoted ""one""",', "3.0,,,", "x,4,bad id,", "4,many,bad size,2024-02-31",
               "5,1,too,2024-01-01,long", "6,2", " 7 , 8 ,spaces, 2024-01-01 ")
    found = typed_csv.scan(spark, path, "main")
    assert dict(found.rows.dtypes) == {MainCols.ID: "bigint", MainCols.FAMILY_SIZE: "double", "notes": "string", MainCols.SURVEY_DATE: "date"}
    rows = found.rows.orderBy(F.col(f"`{MainCols.ID}`")).collect()
    assert [(r[0], r[1], r[2], str(r[3])) for r in rows] == [
        (1, 4.0, "plain", "2024-01-31"), (2, 5.5, 'a, quoted "one"', "None"), (3, None, None, "None"), (7, 8.0, "spaces", "2024-01-01")]
    errors = sorted((r.reason, sorted(r.columns), r.role, os.path.basename(r.source_file)) for r in found.errors.collect())
    assert errors == [("fields", [], "main", "main.csv"), ("fields", [], "main", "main.csv"), ("values", [MainCols.ID], "main", "main.csv"),
                      ("values", sorted([MainCols.FAMILY_SIZE, MainCols.SURVEY_DATE]), "main", "main.csv")]
    assert {r.record for r in found.errors.where("reason = 'fields'").collect()} == {"5,1,too,2024-01-01,long", "6,2"}
    # whatever columns are read, the same rows are good
    assert found.rows.select("notes").count() == found.rows.select(F.col(f"`{MainCols.ID}`")).where(f"`{MainCols.ID}` > 0").count() == 4
    assert found.errors.select("reason").count() == found.errors.count() == 4


def test_line_breaks_and_other_headers(spark, tmp_path):
    a = put(tmp_path / "a.csv", HEADER, "1,4,plain,", "2,5,also plain,")
    b = put(tmp_path / "b.csv", f"notes,{MainCols.ID}", '"two\nlines",3', "plain,4")
    assert not typed_csv.has_inner_line_breaks(spark, [a]) and typed_csv.has_inner_line_breaks(spark, [a, b])
    found = typed_csv.scan(spark, [a, b], "main")
    rows = sorted((r[MainCols.ID], r["notes"], r[MainCols.FAMILY_SIZE]) for r in found.rows.collect())
    assert rows[:2] == [(1, "plain", 4.0), (2, "also plain", 5.0)]
    assert rows[2:] == [(3, "two\nlines", None), (4, "plain", None)] and found.errors.count() == 0
    empty = typed_csv.scan(spark, put(tmp_path / "c.csv", HEADER), "main")
    assert empty.rows.count() == 0 and empty.errors.count() == 0


@pytest.mark.parametrize("bad", ["damage", "needs"])
def test_a_failed_write_leaves_the_old_tables(spark, golden_tables, tmp_path, bad):
    out = str(tmp_path / "set")
    tables.write_tables(golden_tables, out)
    before = {r: df.count() for r, df in tables.load_case_tables(spark, out).as_dict().items()}
    frames = {r: df.limit(1) for r, df in golden_tables.as_dict().items()}
    frames[bad] = frames[bad].withColumn("x", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        tables.write_tables(CaseTables(**frames), out)
    assert {r: df.count() for r, df in tables.load_case_tables(spark, out).as_dict().items()} == before
    assert sorted(os.listdir(out)) == sorted(S.ROLES)
    tables.write_tables(CaseTables(**{r: df.limit(1) for r, df in golden_tables.as_dict().items()}), out)
    assert all(df.count() == 1 for df in tables.load_case_tables(spark, out).as_dict().values())
    assert sorted(os.listdir(out)) == sorted(S.ROLES)


def test_a_failed_rename_puts_all_back(spark, golden_tables, tmp_path):
    out = str(tmp_path / "set")
    tables.write_tables(golden_tables, out)
    stage = str(tmp_path / "stage")
    golden_tables.main.limit(1).write.parquet(f"{stage}/new/main")  # the second table is missing from the staging folder
    with pytest.raises(Exception):
        tables._take_places(spark, stage, out, ["main", "members"])
    back = tables.load_case_tables(spark, out)
    assert back.main.count() == golden_tables.main.count() and back.members.count() == golden_tables.members.count()
