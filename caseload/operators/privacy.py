"""Removal of personal data before anything is stored.

Pure projections: no shuffle, runs map-side on any number of rows.
"""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseload import schema as S
from caseload.functions.scalars import birth_year, first_present, occupation_bucket
from caseload.schema import MemberCols

ALL_PII = frozenset(c for cols in S.PII.values() for c in cols)


class PIIError(ValueError):
    pass


def pii_columns(df: DataFrame, pii: Iterable[str] = ALL_PII) -> list[str]:
    """PII column names still present."""
    wanted = set(pii)
    return [c for c in df.columns if c in wanted]


def assert_no_pii(df: DataFrame, table: str = "table") -> DataFrame:
    """Raise before anything is written if a PII column remains."""
    found = pii_columns(df)
    if found:
        raise PIIError(f"{table} still contains PII columns: {found}")
    return df


def anonymize(df: DataFrame, role: str) -> DataFrame:
    """Anonymise one survey table.

    Members: the birth year is derived from the date-of-birth text *before*
    both date columns are dropped (D1); the occupation text becomes a bucket
    and the raw text is dropped. Then the role's PII names are removed
    (absent names are ignored).
    """
    out = df
    if role == "members":
        dob = first_present(out, (MemberCols.DATE_OF_BIRTH, MemberCols.DATE_OF_BIRTH_ALT))
        if dob:
            out = out.withColumn(MemberCols.BIRTH_YEAR, birth_year(F.col(f"`{dob}`")))
        occ = first_present(out, (MemberCols.OCCUPATION_TEXT, MemberCols.OCCUPATION_TEXT_ALT))
        if occ:
            out = out.withColumn(MemberCols.OCCUPATION, occupation_bucket(F.col(f"`{occ}`"))).drop(occ)
        out = out.drop(MemberCols.DATE_OF_BIRTH, MemberCols.DATE_OF_BIRTH_ALT)
    return out.drop(*S.PII[role])


#: Role by a part of the lower-cased file name; the first that fits decides, any other name is main.
_ROLE_NAMES = (("damage", ("damag",)), ("members", ("member", "family")), ("needs", ("need",)))


def route_files(paths: Iterable[str]) -> dict[str, list[str]]:
    """All export files of each table role, by name.

    A role may have any number of files. If the names leave a role without one, exactly four files
    in sorted order are main, members, damage, needs; any other number is an error, so no
    file is ever left out silently.
    """
    ordered = sorted(paths)
    roles: dict[str, list[str]] = {role: [] for role in S.ROLES}
    for path in ordered:
        name = os.path.basename(path).lower()
        roles[next((role for role, parts in _ROLE_NAMES if any(p in name for p in parts)), "main")].append(path)
    missing = [role for role, found in roles.items() if not found]
    if not missing:
        return roles
    if len(ordered) != len(S.ROLES):
        raise ValueError(f"no file name says {missing}, and {len(ordered)} files cannot be the four tables in order: {ordered}")
    return {role: [path] for role, path in zip(S.ROLES, ordered)}
