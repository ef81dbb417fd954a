from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from caseload import schema as S  # noqa: E402
from caseload.schema import CaseTables, DamageCols, MainCols, MemberCols, NeedsCols  # noqa: E402
from caseload.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(cores="*", shuffle_partitions=8, app="caseload-tests")


# --- the six-family golden fixture (FIXTURES.md §4.1) ---------------------------

N1, N2, N3 = S.DISPLACED_TYPES
HOST = S.HOST_COMMUNITY
YES, NO = S.YES, S.NO
FEM, MALE = S.FEMALE, S.MALE
SEP, DIV = S.WIDOW_MARITAL
MAR, SGL = S.MARRIED, S.SINGLE
PRES = S.PRESENT
DEAD = S.ORPHAN_STATUS[0]
FIN, MED, FOOD, LEGAL, EDU = S.PROGRAM_FINANCIAL, S.PROGRAM_MEDICAL, S.PROGRAM_FOOD, S.PROGRAM_LEGAL, S.PROGRAM_EDUCATION
MILK, DIAPERS, BLANKETS = S.BABY_NEEDS[0], S.BABY_NEEDS[1], S.NEED_BLANKETS

MAIN_ROWS = [
    (1, "G1", "D1", "S1", N1, S.HOUSING_HOMELESS, 8.0, 0.0),
    (2, "G1", "D1", "S1", HOST, S.HOUSING_OWN, 4.0, 1.0),
    (3, "G1", "D2", None, None, S.HOUSING_RENTING, None, None),
    (4, "G2", "D3", "S4", N3, S.HOUSING_HOSTED, 5.0, 2.0),
    (5, "G2", None, None, HOST, S.HOUSING_OTHER, 4.4, 1.0),
    (6, "G2", "D3", "S4", N2, S.HOUSING_OWN, 0.0, 1.0),
]
MEMBER_ROWS = [
    (1, YES, FEM, DIV, PRES, 0.0, 0.0, 1.0, 0.0, None, 0.0),
    (1, NO, MALE, SGL, PRES, 0.0, 0.0, 0.0, 0.0, None, 1.0),
    (3, YES, MALE, MAR, PRES, 0.0, 0.0, 0.0, 0.0, None, 0.0),
    (4, YES, MALE, MAR, DEAD, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0),
    (4, NO, FEM, SGL, PRES, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0),
    (4, NO, FEM, SGL, PRES, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0),
    (5, YES, FEM, MAR, PRES, 1.0, 0.0, 0.0, 0.0, 2.0, 0.0),
    (6, NO, FEM, SEP, PRES, 0.0, 1.0, 0.0, 0.0, None, 0.0),
]
NEED_ROWS = [
    (1, MED, BLANKETS, NO), (1, FOOD, MILK, NO), (1, MED, BLANKETS, NO), (1, LEGAL, BLANKETS, NO),
    (3, FIN, BLANKETS, YES), (4, EDU, BLANKETS, NO), (4, FOOD, BLANKETS, None), (6, None, DIAPERS, NO),
]
DAMAGE_ROWS = [(1, S.DAMAGE_CATEGORIES[0]), (1, S.DAMAGE_CATEGORIES[1]), (6, S.DAMAGE_CATEGORIES[0])]


def _ddl(cols):
    return ", ".join(f"`{n}` {t}" for n, t in cols)


MAIN_SCHEMA = _ddl([(MainCols.ID, "bigint"), (MainCols.GOVERNORATE, "string"), (MainCols.DISTRICT, "string"),
                    (MainCols.SUB_DISTRICT, "string"), (MainCols.DISPLACEMENT_TYPE, "string"),
                    (MainCols.HOUSING_TYPE, "string"), (MainCols.FAMILY_SIZE, "double"),
                    (MainCols.BREADWINNERS, "double")])
MEMBER_SCHEMA = _ddl([(MemberCols.FAMILY_ID, "bigint"), (MemberCols.IS_HOH, "string"), (MemberCols.GENDER, "string"),
                      (MemberCols.MARITAL_STATUS, "string"), (MemberCols.INDIVIDUAL_STATUS, "string"),
                      (MemberCols.V_FEMALE_HOH, "double"), (MemberCols.V_IMMEDIATE_HEALTH, "double"),
                      (MemberCols.V_CHRONIC_DISEASE, "double"), (MemberCols.V_MENTAL_DISABILITY, "double"),
                      (MemberCols.V_PHYSICAL_DISABILITY, "double"), (MemberCols.V_CHILD_DROPOUT, "double")])
NEED_SCHEMA = _ddl([(NeedsCols.FAMILY_ID, "bigint"), (NeedsCols.PROGRAM, "string"),
                    (NeedsCols.CLASSIFICATION, "string"), (NeedsCols.SERVICE_RECEIVED, "string")])
DAMAGE_SCHEMA = _ddl([(DamageCols.FAMILY_ID, "bigint"), (DamageCols.CATEGORY, "string")])


def make_tables(spark, main=MAIN_ROWS, members=MEMBER_ROWS, needs=NEED_ROWS, damage=DAMAGE_ROWS) -> CaseTables:
    return CaseTables(
        main=spark.createDataFrame(main, MAIN_SCHEMA),
        members=spark.createDataFrame(members, MEMBER_SCHEMA),
        damage=spark.createDataFrame(damage, DAMAGE_SCHEMA),
        needs=spark.createDataFrame(needs, NEED_SCHEMA),
    )


@pytest.fixture(scope="session")
def golden_tables(spark):
    return make_tables(spark)


@pytest.fixture(scope="session")
def golden_cases(spark, golden_tables):
    from caseload.operators.cases import build_cases
    from caseload.operators.scoring import number_cases, score
    return number_cases(score(build_cases(golden_tables))).cache()
