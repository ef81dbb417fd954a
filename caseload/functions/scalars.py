"""Scalar column expressions (JVM-side built-ins only, no Python UDFs).

Every helper returns a ``pyspark.sql.Column`` so callers can keep whole
stages inside whole-stage codegen. Null discipline follows the survey tools:
a predicate over a missing value is *false*, never null (``flag``).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseload import schema as S


def col_or(df: DataFrame, name: str, default=None, dtype: str | None = None) -> Column:
    """Column ``name`` of ``df`` when present, else a literal default."""
    if name in df.columns:
        return F.col(f"`{name}`")
    lit = F.lit(default)
    return lit.cast(dtype) if dtype else lit


def first_present(df: DataFrame, names: Sequence[str]) -> str | None:
    """Name of the first of ``names`` that ``df`` has (P5)."""
    return next((n for n in names if n in df.columns), None)


def is_one(c: Column) -> Column:
    """A 0/1 survey flag (number or text such as "1.0") equal to 1, null read as false."""
    return flag(num(c) == F.lit(1.0))


def flag(pred: Column) -> Column:
    """A predicate with null read as false."""
    return F.coalesce(pred, F.lit(False))


def num(c: Column) -> Column:
    """Numeric coercion: text or number to double, unparseable or NaN to null."""
    d = c.try_cast("double")
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def text_int(c: Column) -> Column:
    """Text to integer through a double (``int(float(x))``), null when unparseable."""
    return num(c).try_cast("bigint")


def clipped_size(size: Column, default: int = S.RATION_BASE_PEOPLE) -> Column:
    """Family size for planning: numeric, null to ``default``, at least 1 (X5); untruncated."""
    return F.greatest(F.coalesce(num(size), F.lit(float(default))), F.lit(1.0))


def truncated(c: Column) -> Column:
    """Truncation toward zero to a whole number."""
    return c.try_cast("bigint")


def size_bonus(size: Column, bonus: Iterable[tuple[int, int]] = S.SIZE_BONUS) -> Column:
    """Family-size bonus on the truncated size (X2); null or unparseable gives 0.

    For a double x and an integer threshold t, ``trunc(x) >= t`` equals ``x >= t``,
    so the comparison runs on the double and never overflows an int cast.
    """
    s = num(size)
    out = None
    for minimum, points in bonus:
        cond = s >= F.lit(float(minimum))
        out = F.when(cond, F.lit(points)) if out is None else out.when(cond, F.lit(points))
    return F.coalesce(out.otherwise(F.lit(0)), F.lit(0))


def weighted_sum(weights: Iterable[tuple[str, int]], available: Iterable[str]) -> Column:
    """Sum of weights of the true signal columns (X1); absent signals count as false."""
    have = set(available)
    terms = [F.when(flag(F.col(sig)), F.lit(w)).otherwise(F.lit(0)) for sig, w in weights if sig in have]
    if not terms:
        return F.lit(0)
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def tier(score: Column, tiers: Iterable[tuple[int, str]] = S.TIERS, low: str = S.LOW_TIER) -> Column:
    """Priority tier from the score."""
    out = None
    for minimum, name in tiers:
        cond = score >= F.lit(minimum)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit(low))


def any_true(cols: Iterable[Column]) -> Column:
    cols = list(cols)
    out = cols[0]
    for c in cols[1:]:
        out = out | c
    return out


def row_max_is_one(cols: Sequence[Column]) -> Column:
    """Row-wise max of flags with null (or unparseable text) as 0, compared to 1.0 (X13); no columns gives false."""
    if not cols:
        return F.lit(False)
    filled = [F.coalesce(num(c), F.lit(0.0)) for c in cols]
    top = filled[0] if len(filled) == 1 else F.greatest(*filled)
    return top == F.lit(1.0)


# --- text helpers -----------------------------------------------------------

_UNICODE_SPACE_EDGES = r"(?U)^\s+|\s+$"
_ARABIC_INDIC = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
_ASCII_DIGITS = "0123456789" * 2


def strip(c: Column) -> Column:
    """Remove leading/trailing whitespace, Unicode-aware (Python ``str.strip``)."""
    return F.regexp_replace(c.cast("string"), _UNICODE_SPACE_EDGES, "")


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == F.lit(""))


def occupation_bucket(c: Column, buckets=S.OCCUPATION_BUCKETS) -> Column:
    """First bucket (declared order) with a keyword that is a substring of the text."""
    text = F.lower(strip(c))
    out = F.when(is_blank(c), F.lit(S.UNKNOWN_BUCKET))
    for bucket, keywords in buckets:
        out = out.when(any_true(text.contains(F.lit(k.lower())) for k in keywords), F.lit(bucket))
    return out.otherwise(F.lit(S.OTHER_BUCKET))


# The forms of a whole date text: three fields of digits, with a time of day after them or not; eight digits; a year.
_DATE_FIELDS = r"^(\d{1,4})\s*[-/.]\s*(\d{1,2})\s*[-/.]\s*(\d{1,4})(?:[T ]+\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"
_DATE_DIGITS = r"^(\d{4})(\d{2})(\d{2})$"
_YEAR_ONLY = r"^\d{4}$"
#: Two-digit years from this on are 19xx, those below 20xx.
YEAR_PIVOT = 69


def _year_if_date(year: Column, a: Column, b: Column) -> Column:
    """The year, if ``a`` and ``b`` are month and day of it in either order; else null."""
    day = lambda m, d: F.try_to_timestamp(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), m, d), F.lit("yyyy-M-d"))
    return F.when(F.coalesce(day(a, b), day(b, a)).isNotNull(), year)


def birth_year(c: Column) -> Column:
    """Year of a date-of-birth text.

    Blank gives null. The (trimmed, ASCII-digit) text is read by the widths of its fields: a four-digit
    field at either end is the year; without one the last field is a two-digit year (``YEAR_PIVOT``); the two
    other fields must be a month and a day that exist, in either order. A time of day may follow. Eight digits are
    year, month and day; four digits are a year. Any other text gives its first stand-alone 19xx/20xx number; else null.
    """
    text = F.translate(strip(c), _ARABIC_INDIC, _ASCII_DIGITS)
    first, middle, last = (F.regexp_extract(text, _DATE_FIELDS, i) for i in (1, 2, 3))
    short = last.try_cast("int")
    short = F.when(short < YEAR_PIVOT, short + 2000).otherwise(short + 1900)
    digits = [F.regexp_extract(text, _DATE_DIGITS, i) for i in (1, 2, 3)]
    by_fields = (
        F.when((F.length(first) == 4) & (F.length(last) <= 2), _year_if_date(first.try_cast("int"), middle, last))
        .when((F.length(last) == 4) & (F.length(first) <= 2), _year_if_date(last.try_cast("int"), first, middle))
        .when((F.length(last) == 2) & (F.length(first) <= 2), _year_if_date(short, first, middle))
    )
    by_digits = _year_if_date(digits[0].try_cast("int"), digits[1], digits[2])
    alone = F.when(text.rlike(_YEAR_ONLY), text.try_cast("int"))
    found = F.regexp_extract(text, S.BIRTH_YEAR_PATTERN, 1)
    by_regex = F.when(found != F.lit(""), found.try_cast("int"))
    return F.when(is_blank(c), F.lit(None).cast("int")).otherwise(F.coalesce(by_fields, by_digits, alone, by_regex))


def capitalize(c: Column) -> Column:
    """Python ``str.capitalize``: first character upper, the rest lower."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def labels_of(pairs: Iterable[tuple[str, str]], available: Iterable[str], sep: str = ", ") -> Column:
    """Labels of the true signals in declared order joined by ``sep``."""
    have = set(available)
    parts = [F.when(flag(F.col(c)), F.lit(lbl)) for c, lbl in pairs if c in have]
    return F.concat_ws(sep, *parts) if parts else F.lit("")


def case_label(num_col: Column, city: Column, tier_col: Column, score: Column) -> Column:
    """``Family #007  ·  city  ·  TIER  (score n)``."""
    return F.format_string(
        "Family #%03d  ·  %s  ·  %s  (score %d)",
        num_col.cast("bigint"), F.coalesce(city, F.lit("?")), tier_col, score.cast("bigint"),
    )


# --- JSON in free text (X15, X16) --------------------------------------------


def json_object_span(text: Column) -> Column:
    """Greedy span from the first ``{`` to the last ``}``; '' when none."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def json_array_span(text: Column) -> Column:
    """Greedy span from the first ``[`` to the last ``]``; '' when none."""
    return F.regexp_extract(text, r"(?s)\[.*\]", 0)


def with_strict_json(df: DataFrame, span: Column, ddl: str, name: str, in_list: bool) -> DataFrame:
    """Add column ``name``: ``span`` parsed as exactly one JSON value of type ``ddl``, else null.

    ``ddl`` is a struct or, with ``in_list``, a list of structs. ``from_json`` stops after the first
    value and ignores what follows, so the text parsed is ``[span, end]``: the parse is strict when
    it yields exactly these two elements. ``end`` carries the digest of the span, which no
    text within the span can foresee, so a span cannot close the list itself and still look complete.
    The parse is staged over two projections, so the JSON is parsed once per
    row even when many fields are read from it (Catalyst does not inline an
    expensive alias that is used repeatedly).
    """
    digest = F.sha2(span, 256)
    end = F.concat(F.lit('{"_end": "'), digest, F.lit('"}'))
    end = F.concat(F.lit("["), end, F.lit("]")) if in_list else end
    marked = re.sub("struct<", "struct<_end: string, ", ddl, count=1)
    arr = F.from_json(F.concat(F.lit("["), span, F.lit(", "), end, F.lit("]")), f"array<{marked}>",
                      {"mode": "PERMISSIVE", "allowSingleQuotes": "false"})
    staged = df.withColumns({"_arr": arr, "_digest": F.when(span != F.lit(""), digest)})
    last = F.get("_arr", F.lit(1))
    seen = (F.get(last, F.lit(0)) if in_list else last)["_end"]
    value = F.get("_arr", F.lit(0))
    value = F.transform(value, lambda x: x.dropFields("_end")) if in_list else value.dropFields("_end")
    pick = F.when((F.size("_arr") == F.lit(2)) & (seen == F.col("_digest")), value)
    return staged.withColumn(name, pick).drop("_arr", "_digest")


# --- literal-heavy generators as one SQL expression ------------------------------


def sql_literal(v) -> str:
    """A Spark SQL literal for a Python value (doubles typed as DOUBLE, not DECIMAL)."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def inline_rows(df: DataFrame, rows: Sequence[Sequence[tuple[str, str]]]) -> DataFrame:
    """Unpivot: one output row per entry of ``rows`` for every input row (in practice a one-row aggregate).

    Each entry is a list of (column name, SQL expression over ``df``'s columns).
    The whole generator is one SQL expression, so a rule table of dozens of
    rows costs one plan call instead of hundreds of column constructors.
    """
    structs = ["named_struct(" + ", ".join(f"{sql_literal(n)}, {e}" for n, e in r) + ")" for r in rows]
    return df.selectExpr(f"inline(array({', '.join(structs)}))")
