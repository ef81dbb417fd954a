"""Reading and writing the four survey tables and report exports.

The survey tables are directories (Parquet by default, CSV for raw exports),
one per role. CSV is read with an explicit schema when one is given; header
row, multi-line quoted fields and ``"`` escapes as the form tool writes them.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseload.operators.privacy import anonymize, assert_no_pii, route_files
from caseload.schema import ROLES, CaseTables
from caseload.session import remove


def read_table(spark: SparkSession, path: str | list[str], fmt: str = "parquet", schema=None, multiline: bool = True) -> DataFrame:
    """One survey table (S1). CSV without a schema keeps every column as text (coerced later).

    Form exports hold free-text notes with line breaks, so CSV is read with
    ``multiLine`` by default; such a file cannot be split, so parallelism comes
    from the number of files. Pass ``multiline=False`` for exports without
    embedded newlines to let Spark split large files.
    """
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = (reader.option("header", True).option("multiLine", multiline).option("escape", '"')
                  .option("mode", "PERMISSIVE").option("encoding", "UTF-8"))
    return reader.format(fmt).load(path)


def load_case_tables(spark: SparkSession, base: str, fmt: str = "parquet", schemas: dict | None = None) -> CaseTables:
    """The four tables under ``base/{main,members,damage,needs}`` (S3)."""
    schemas = schemas or {}
    frames = {r: read_table(spark, os.path.join(base, r), fmt, schemas.get(r)) for r in ROLES}
    return CaseTables(**frames)


def load_caseload(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The case table from its folders: the built one first, then those of appended rows.

    Every folder keeps the files that it was written with; the columns are those of the first, missing ones null.
    Survey ids are long and intake ids text, so ``family_id`` is text as soon as there are several (D12).
    """
    first, *rest = (spark.read.parquet(p) for p in paths)
    if not rest:
        return first
    text = [df.withColumn("family_id", F.col("family_id").cast("string")) for df in (first, *rest)]
    out = text[0]
    for df in text[1:]:
        out = out.unionByName(df.select(*[c for c in df.columns if c in first.columns]), allowMissingColumns=True)
    return out


#: Columns a single case is looked up by.
LOOKUP_KEYS = ("family_num", "family_id")


def write_cases(cases: DataFrame, out: str, partition_by: list[str] | None = None, keys: tuple[str, ...] = LOOKUP_KEYS,
                row_group_bytes: int = 32 << 20) -> None:
    """Write a case table that answers lookups of one case from few row groups.

    Rows keep the ranges of the numbering and are sorted by ``keys`` within a file, so the row groups' minima
    and maxima exclude most of them for a value that exists; each group also has a Bloom filter of every
    key, which excludes it for a value that lies between its bounds without being there (ids with gaps, ids
    of appended rows). The filters' size follows the number of distinct values (1 MB a group at most).

    ``partition_by`` writes a folder per value (S5). Rows are rebalanced by these columns first: a value has few
    files, and one that holds much of the table is split by adaptive execution at its advisory partition size.
    """
    keys = [k for k in keys if k in cases.columns]
    if partition_by:
        cases = cases.hint("rebalance", *partition_by)
    cases = cases.sortWithinPartitions(*(partition_by or []), *[k for k in keys if k not in (partition_by or [])])
    writer = cases.write.mode("overwrite").option("parquet.block.size", row_group_bytes)
    for key in keys:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", True)
    writer = writer.option("parquet.bloom.filter.adaptive.enabled", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(out)


def load_exports(spark: SparkSession, paths: list[str], fmt: str = "csv", schemas: dict | None = None) -> CaseTables:
    """Raw form exports routed to roles by file name (S2), then read."""
    roles = route_files(paths)
    schemas = schemas or {}
    return CaseTables(**{r: read_table(spark, roles[r], fmt, schemas.get(r)) for r in ROLES})


def anonymize_tables(tables: CaseTables) -> CaseTables:
    """Apply the per-role anonymisation and check that no PII column remains."""
    return CaseTables(**{r: assert_no_pii(anonymize(df, r), r) for r, df in tables.as_dict().items()})


def write_tables(tables: CaseTables, out: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write the four tables (S4), all or nothing; refuses to write a table that still holds a PII column.

    Every table is first written to a staging folder beside its place. Only when all four are complete do they
    take their places, by renames; a failure before that leaves the tables that were there untouched, and
    one in between puts them back. ``mode="append"`` adds to the tables in place instead.
    """
    frames = {role: assert_no_pii(df, role) for role, df in tables.as_dict().items()}
    if mode != "overwrite":
        for role, df in frames.items():
            df.write.mode(mode).format(fmt).save(os.path.join(out, role))
        return
    spark = tables.main.sparkSession
    stage = os.path.join(out, f"_staging-{uuid.uuid4().hex}")
    try:
        for role, df in frames.items():
            df.write.format(fmt).save(os.path.join(stage, "new", role))
        _take_places(spark, stage, out, list(frames))
    finally:
        remove(spark, stage)


def _take_places(spark: SparkSession, stage: str, out: str, names: list[str]) -> None:
    """Rename ``stage/new/<name>`` to ``out/<name>`` for all names, or put everything back."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(out).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(stage, "old"))
    done: list[tuple[str, str]] = []

    def move(a: str, b: str) -> None:
        if not fs.rename(path(a), path(b)):
            raise OSError(f"cannot rename {a} to {b}")
        done.append((a, b))

    try:
        for name in names:
            place = os.path.join(out, name)
            if fs.exists(path(place)):
                move(place, os.path.join(stage, "old", name))
            move(os.path.join(stage, "new", name), place)
    except Exception:
        for a, b in reversed(done):
            fs.rename(path(b), path(a))
        raise


def csv_ready(df: DataFrame) -> DataFrame:
    """Array, map and struct columns as JSON text, since the CSV writer takes only atomic columns."""
    cols = []
    for name, dtype in df.dtypes:
        c = F.col(f"`{name}`")
        cols.append(F.to_json(c).alias(name) if dtype.startswith(("array", "map", "struct")) else c)
    return df.select(*cols)


def export_csv(df: DataFrame, path: str, order_by: list | None = None, single_file: bool = False) -> None:
    """Export a report as CSV with a header.

    ``order_by`` sorts globally (range-partitioned, parallel). ``single_file``
    funnels through one task and is meant only for small reports.
    """
    out = csv_ready(df)
    if order_by:
        out = out.orderBy(*order_by)
    if single_file:
        out = out.coalesce(1)
    out.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def export_json(df: DataFrame, path: str) -> None:
    """Export rows as JSON lines."""
    df.write.mode("overwrite").json(path)
