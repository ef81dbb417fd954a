"""Typed CSV scan of the four survey roles with a table of the rows that do not fit.

The form tool's exports are text with a header. A scan gives the role's typed rows
(``schema.COLUMN_TYPES``; every other column stays text) and, apart from them, the malformed rows:

* records with another number of fields than the header, as the CSV parser reports them;
* records with a non-blank value that is not of its column's type.

Nothing is dropped silently and nothing becomes null silently: a record is in exactly one of the two.
Files whose headers differ (other columns or another order) are read by their own headers.

A file with line breaks inside quoted values cannot be split, so it is one task; whether there are such is
found by one pass over the lines, which stops at the first. All other files are split at any size.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseload import schema as S
from caseload.functions.scalars import is_blank, num
from caseload.schema import CaseTables

_CORRUPT = "_corrupt_record"
_FILE = "_source_file"
ERROR_COLUMNS = ("role", "source_file", "reason", "columns", "record")


@dataclass
class TypedScan:
    """``rows`` with typed columns, and ``errors``: role, source_file, reason, columns, record."""

    rows: DataFrame
    errors: DataFrame


def has_inner_line_breaks(spark: SparkSession, paths: list[str]) -> bool:
    """Whether some line has an odd number of quotes, so that a quoted value goes on in the next line."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return bool(spark.read.text(paths).where(quotes % 2 == 1).limit(1).count())


def headers(spark: SparkSession, paths: list[str]) -> dict[tuple[str, ...], list[str]]:
    """The files of each distinct header."""
    found: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        names = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path).columns
        found.setdefault(tuple(names), []).append(path)
    return found


def _converted(name: str, dtype: str) -> F.Column:
    """A text column in its type; null if the text is not of the type. "12.0" is the integer 12."""
    c = F.col(f"`{name}`")
    if dtype == "bigint":
        number = num(c)
        return F.coalesce(F.trim(c).try_cast("bigint"), F.when(number == F.floor(number), number.try_cast("bigint")))
    return num(F.trim(c)) if dtype == "double" else F.trim(c).try_cast(dtype)


def _raw(spark: SparkSession, names: tuple[str, ...], paths: list[str], multiline: bool) -> DataFrame:
    ddl = ", ".join(f"`{n.replace('`', '``')}` string" for n in (*names, _CORRUPT))
    reader = (spark.read.schema(ddl).option("header", True).option("multiLine", multiline).option("escape", '"')
              .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _CORRUPT).option("encoding", "UTF-8")
              .option("columnPruning", False))  # a record's number of fields is checked whatever columns are read
    return reader.csv(paths).withColumn(_FILE, F.col("_metadata.file_path"))


def scan(spark: SparkSession, paths: str | list[str], role: str, types: dict[str, str] | None = None,
         multiline: bool | None = None) -> TypedScan:
    """Scan one role's CSV files; ``multiline`` None finds out whether values hold line breaks."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    types = S.COLUMN_TYPES[role] if types is None else types
    multiline = has_inner_line_breaks(spark, paths) if multiline is None else multiline
    rows, errors = [], []
    for names, files in headers(spark, paths).items():
        raw = _raw(spark, names, files, multiline)
        typed = {n: t for n, t in types.items() if n in names}
        wrong = F.filter(F.array(*[F.when(~is_blank(F.col(f"`{n}`")) & _converted(n, t).isNull(), F.lit(n)) for n, t in typed.items()],
                                 F.lit(None).cast("string")), lambda x: x.isNotNull())
        checked = raw.withColumn("_wrong", wrong)
        good = F.col(_CORRUPT).isNull() & (F.size("_wrong") == 0)
        rows.append(checked.where(good).select(*[
            _converted(n, typed[n]).alias(n) if n in typed else F.col(f"`{n}`") for n in names]))
        errors.append(checked.where(~good).select(
            F.lit(role).alias("role"), F.col(_FILE).alias("source_file"),
            F.when(F.col(_CORRUPT).isNotNull(), F.lit("fields")).otherwise(F.lit("values")).alias("reason"),
            F.when(F.col(_CORRUPT).isNull(), F.col("_wrong")).otherwise(F.array().cast("array<string>")).alias("columns"),
            F.coalesce(F.col(_CORRUPT), F.to_json(F.struct(*[F.col(f"`{n}`") for n in names]))).alias("record")))
    union = lambda frames: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return TypedScan(union(rows), union(errors))


def scan_tables(spark: SparkSession, roles: dict[str, list[str]]) -> tuple[CaseTables, DataFrame]:
    """The four typed tables from each role's files, and the malformed rows of all."""
    scans = {role: scan(spark, roles[role], role) for role in S.ROLES}
    errors = reduce(DataFrame.unionByName, [s.errors for s in scans.values()])
    return CaseTables(**{role: s.rows for role, s in scans.items()}), errors
