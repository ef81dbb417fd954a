"""Intake of new records from model responses.

One pure transform chain is shared by batch and streaming:
``parse_responses`` → ``score_intake`` → ``append``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseload import schema as S
from caseload.functions.scalars import flag, json_array_span, json_object_span, text_int, with_strict_json
from caseload.operators.scoring import number_cases, score

RECORD_DDL = "struct<" + ", ".join(f"{f}: string" for f in S.INTAKE_FIELDS) + ">"
ITEM_DDL = "array<struct<" + ", ".join(f"{f}: string" for f in S.NEED_ITEM_FIELDS) + ">>"


def parse_responses(df: DataFrame, text_col: str = "response", blank_as_zero: bool = False) -> DataFrame:
    """Extract the intake record from each response text.

    The greedy ``{...}`` span must be exactly one JSON object, otherwise the
    row is marked ``parse_ok = false`` (all fields null) for quarantine.
    Numbers go text → double → truncated integer; unparseable gives null, or
    0 with ``blank_as_zero`` (the review form's behaviour, D13).
    """
    keep = [c for c in df.columns if c != text_col]
    staged = with_strict_json(df, json_object_span(F.col(text_col)), RECORD_DDL, "_rec", in_list=False)
    rec = F.col("_rec")
    fields = []
    for f in S.INTAKE_FIELDS:
        value = rec[f]
        if f in S.INTAKE_NUMERIC:
            value = text_int(value)
            if blank_as_zero:
                value = F.when(rec.isNotNull(), F.coalesce(value, F.lit(0)))
        fields.append(value.alias(f))
    return staged.select(*keep, F.col(text_col), rec.isNotNull().alias("parse_ok"), *fields)


def parse_need_items(df: DataFrame, text_col: str = "response") -> DataFrame:
    """Need items from a response holding a JSON array (X16): one row per item, position kept.

    The greedy ``[...]`` span must be exactly one JSON array; otherwise the
    response yields no items.
    """
    keep = [c for c in df.columns if c != text_col]
    staged = with_strict_json(df, json_array_span(F.col(text_col)), ITEM_DDL, "_items", in_list=True)
    items = F.coalesce(F.col("_items"), F.array().cast(ITEM_DDL))
    return staged.select(*keep, F.posexplode(items).alias("item_pos", "it")).select(
        *keep, "item_pos", *[F.col("it")[f].alias(f) for f in S.NEED_ITEM_FIELDS])


def record_id(key: Column, payload: list[Column]) -> Column:
    """Upper-hex id of a record (X22): the digest of its intake id, or of its payload if it has none.

    The form tool shows 8 random hex characters; 32 bits collide after tens of thousands of records,
    so the whole digest (128 bits) is the key. Records of one intake id share it, whatever they hold, so a
    corrected resend is known again.
    """
    by_payload = F.concat_ws("␟", *[c.cast("string") for c in payload])
    return F.upper(F.md5(F.when(key.isNull(), by_payload).otherwise(F.concat(F.lit("id␟"), key.cast("string")))))


def rows_where(df: DataFrame, condition: Column) -> DataFrame:
    """The rows that satisfy a condition on columns which are costly to compute, each computed once.

    A plain ``where`` would be pushed below the staged parse projections, where it
    re-evaluates ``from_json`` (several times a row); selecting through a generator
    keeps the check above them.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(F.inline(F.when(condition, F.array(row)).otherwise(F.array().cast(f"array<{row_ddl(df)}>"))))


def parsed_rows(parsed: DataFrame) -> DataFrame:
    """The rows whose response parsed (``parse_ok``), each JSON parsed once."""
    return rows_where(parsed, F.col("parse_ok"))


def first_records(parsed: DataFrame, key: str = "intake_id", text_col: str = "response") -> DataFrame:
    """The records to add from parsed responses, the one rule of batch and stream intake.

    Only responses that parsed count, so a malformed one never displaces a good one. Of the good ones
    that share an id the one with the smallest digest of its text stays, whatever order they came in. A
    response without id cannot be a resend of anything: each is a record of its own.
    An id that repeats any number of times is one row per task before the shuffle.
    """
    good = parsed_rows(parsed)
    columns = [c for c in good.columns if c != key]
    known = good.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.min(F.struct(F.sha2(text_col, 256).alias("_digest"), *[F.col(c) for c in columns])).alias("_first"))
    unknown = good.where(F.col(key).isNull())
    return known.select(key, *[F.col("_first")[c].alias(c) for c in columns]).unionByName(unknown).select(*good.columns)


def row_ddl(df: DataFrame) -> str:
    return "struct<" + ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in df.schema.fields) + ">"


def score_intake(parsed: DataFrame, key: str = "intake_id") -> DataFrame:
    """Case rows for parsed records (T1): four derived signals, the rest false, then scored."""
    p = parsed_rows(parsed) if "parse_ok" in parsed.columns else parsed
    disp = F.coalesce(F.col("displacement_type"), F.lit(""))
    housing = F.coalesce(F.col("housing_type"), F.lit(""))
    false = F.lit(False)
    rows = p.select(
        F.col(key),
        record_id(F.col(key), [F.col(f) for f in S.INTAKE_FIELDS]).alias("family_id"),
        F.lit(S.MANUAL_SOURCE_FILE).alias("source_file"),
        F.lit(S.MANUAL_SOURCE_SHEET).alias("source_sheet"),
        F.col("family_size").cast("double").alias("family_size"),
        F.coalesce(F.nullif(F.col("city"), F.lit("")), F.lit(S.UNKNOWN_CITY)).alias("city"),
        F.coalesce(F.col("governorate"), F.lit("")).alias("governorate"),
        disp.alias("displacement_type"),
        housing.alias("housing_type"),
        F.col("dependents").cast("double").alias("dependents"),
        F.col("breadwinners").cast("double").alias("breadwinners"),
        F.coalesce(F.col("need_type"), F.lit("")).alias("need_type"),
        disp.isin(*S.DISPLACED_TYPES).alias("is_displaced"),
        (housing == F.lit(S.HOUSING_HOMELESS)).alias("is_homeless"),
        (housing == F.lit(S.HOUSING_RENTING)).alias("is_renting"),
        flag(F.col("breadwinners") == F.lit(0)).alias("is_unemployed"),
        *[false.alias(s) for s in ("is_widow", "is_orphan_family", "has_medical", "has_disability",
                                   "is_pregnant", "has_damage", "service_received")],
    )
    return score(rows)


def next_number(existing: DataFrame, name: str = "family_num") -> Column:
    """max(number) + 1 of the existing table, 1 when empty (W3), as a scalar subquery."""
    return existing.agg((F.coalesce(F.max(name), F.lit(0)) + F.lit(1)).cast("bigint")).scalar()


def fresh_rows(existing: DataFrame, new_rows: DataFrame, key: str = "intake_id") -> DataFrame:
    """The scored rows whose record is not stored yet (same ``family_id``: the digest of the intake id).

    Rows without id are all fresh. Of rows that still repeat an id the first in column order stays.
    """
    columns = [c for c in new_rows.columns if c != key]
    once = new_rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*columns)).alias("_first")).select(
        key, *[F.col("_first")[c].alias(c) for c in columns])
    stored = existing.where(F.col("source_file") == S.MANUAL_SOURCE_FILE).select(F.col("family_id").cast("string").alias("family_id"))
    known = once.join(stored, "family_id", "left_anti")
    return known.unionByName(new_rows.where(F.col(key).isNull()))


def rows_to_append(existing: DataFrame, new_rows: DataFrame, key: str = "intake_id") -> DataFrame:
    """The fresh rows, numbered after the existing ones and with the existing columns.

    Missing columns become null, extra ones are dropped. Nothing of ``existing`` but its records' ids and
    its largest number is read.
    """
    fresh = fresh_rows(existing, new_rows, key)
    numbered = number_cases(fresh, order_by=[key, "family_id"], start=next_number(existing), tie=[]).drop(key)
    shape = existing.limit(0).withColumn("family_id", F.col("family_id").cast("string"))
    return shape.unionByName(numbered, allowMissingColumns=True).select(*existing.columns)


def append(existing: DataFrame, new_rows: DataFrame, key: str = "intake_id") -> DataFrame:
    """The caseload with the fresh rows.

    Survey ids are long and intake ids text, so ``family_id`` is text in the union (D12). To store the
    result, write ``rows_to_append`` beside the existing files instead.
    """
    old = existing.withColumn("family_id", F.col("family_id").cast("string"))
    return old.unionByName(rows_to_append(existing, new_rows, key))
