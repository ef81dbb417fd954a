"""Filters over the case table: option filters, declarative predicates, analytics.

A predicate spec is plain data, never code text:

    {"col": "family_size", "op": "gt", "value": 4}
    {"and": [spec, spec, ...]}   {"or": [...]}   {"not": spec}

Leaves read a missing value as *false* (as a pandas mask does), but for ``ne``, which holds for it, so
``not`` of a leaf over a null is true. Column, operator and value types are checked against the
schema before anything runs.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseload.functions.scalars import flag, num
from caseload.operators import planning

_COMPARE = {
    "eq": lambda c, v: c == F.lit(v),
    "ne": lambda c, v: ~c.eqNullSafe(F.lit(v)),
    "lt": lambda c, v: c < F.lit(v),
    "le": lambda c, v: c <= F.lit(v),
    "gt": lambda c, v: c > F.lit(v),
    "ge": lambda c, v: c >= F.lit(v),
}


def _is_number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def _is_numeric(kind: str) -> bool:
    return kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")


def _check_value(name: str, kind: str, op: str, value) -> None:
    """A value must be comparable with the column: numbers with numbers, text with text, dates by their text."""
    fits = (_is_number(value) and _is_numeric(kind) or isinstance(value, bool) and kind == "boolean"
            or isinstance(value, str) and kind == "string")
    if isinstance(value, str) and kind in ("date", "timestamp"):
        try:
            fits = bool(datetime.fromisoformat(value))
        except ValueError:
            fits = False
    if not fits:
        raise ValueError(f"{op} cannot compare {name!r} ({kind}) with {value!r}")


def compile_predicate(df: DataFrame, spec: dict) -> F.Column:
    """Compile a predicate spec to a null-free boolean ``Column``."""
    if "and" in spec or "or" in spec:
        key = "and" if "and" in spec else "or"
        parts = [compile_predicate(df, s) for s in spec[key]]
        if not parts:
            return F.lit(key == "and")
        out = parts[0]
        for p in parts[1:]:
            out = (out & p) if key == "and" else (out | p)
        return out
    if "not" in spec:
        return ~compile_predicate(df, spec["not"])
    name, op = spec["col"], spec.get("op", "eq")
    if name not in df.columns:
        raise ValueError(f"unknown column {name!r}; available: {df.columns}")
    c = F.col(f"`{name}`")
    value = spec.get("value")
    kind = dict(df.dtypes)[name]
    if op in _COMPARE:
        if _is_number(value) and kind == "string":
            c = num(c)
        else:
            _check_value(name, kind, op, value)
        return flag(_COMPARE[op](c, value))
    if op == "is_true":
        if kind != "boolean" and not _is_numeric(kind):
            raise ValueError(f"{op} needs a boolean or number; {name!r} is {kind}")
        return flag(c.cast("boolean"))
    if op == "in":
        for v in value:
            _check_value(name, kind, op, v)
        return flag(c.isin(*value))
    if op == "contains":
        return flag(c.cast("string").contains(F.lit(str(value))))
    if op == "icontains":
        return flag(F.lower(c.cast("string")).contains(F.lit(str(value).lower())))
    if op == "is_null":
        return c.isNull()
    raise ValueError(f"unknown operator {op!r}")


def where(df: DataFrame, spec: dict | None) -> DataFrame:
    """Rows of ``df`` matching the spec (all rows when ``spec`` is None)."""
    return df if spec is None else df.where(compile_predicate(df, spec))


def _option_predicate(tiers=None, cities=None, displacement=None) -> F.Column:
    conds = []
    for col_name, chosen in (("priority_tier", tiers), ("city", cities), ("displacement_type", displacement)):
        c = F.col(col_name)
        conds.append(c.isNotNull() if chosen is None else flag(c.isin(*chosen)))
    return conds[0] & conds[1] & conds[2]


def by_options(df: DataFrame, tiers=None, cities=None, displacement=None) -> DataFrame:
    """The sidebar filter (F1): tier, city and displacement membership.

    ``None`` for a dimension means every non-null option is selected, which
    (like a membership test against the option list) still drops null values.
    """
    return df.where(_option_predicate(tiers, cities, displacement))


def filtered_counts(df: DataFrame, tiers=None, cities=None, displacement=None) -> DataFrame:
    """``n of N``: matching and total families in one pass."""
    pred = _option_predicate(tiers, cities, displacement)
    return df.agg(F.count_if(pred).alias("shown"), F.count(F.lit(1)).alias("total"))


MEASURES = ("needs", "rations", "medical", "financial", "count", "sum")


def analyse(df: DataFrame, spec: dict | None, measure: str, column: str | None = None) -> DataFrame:
    """Analytics over the filtered subset (F9): one of the planners or a direct aggregate."""
    subset = where(df, spec)
    if measure == "needs":
        return planning.aggregate_needs(subset)
    if measure == "rations":
        packs = planning.ration_packs(subset)
        return packs.agg(F.count(F.lit(1)).alias("families"),
                         F.coalesce(F.sum("ration_packs"), F.lit(0)).cast("bigint").alias("total_packs"),
                         F.coalesce(F.sum("family_size"), F.lit(0)).cast("bigint").alias("total_people"))
    if measure == "medical":
        return planning.medical_supplies(subset)
    if measure == "financial":
        return planning.financial_totals(subset)
    if measure == "count":
        return subset.agg(F.count(F.lit(1)).alias("families"))
    if measure == "sum":
        kinds = dict(df.dtypes)
        if column not in kinds or not (_is_numeric(kinds[column]) or kinds[column] == "string"):
            raise ValueError(f"sum needs a column of numbers; got {column!r}")
        return subset.agg(F.coalesce(F.sum(num(F.col(column))), F.lit(0.0)).alias(f"sum_{column}"))
    raise ValueError(f"unknown measure {measure!r}; one of {MEASURES}")
