"""Stand-in survey tables built from the driver's benchmark tables.

These views only *shape* rows of the benchmark tables into the survey schema
(see FIXTURES.md §2): each output row comes from one source row (joined to its
parent key where the child needs the family id), and every value is a plain
function of that row. They do none of the library's work; the operators treat
their output like any other survey export.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseload import schema as S
from caseload.schema import CaseTables, DamageCols, MainCols, MemberCols, NeedsCols


@lru_cache(maxsize=256)
def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # the benchmark tables are read-only: one lazy reader per (session, table) is enough
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _by(value: F.Column, mapping: list[tuple[object, str]], default: str | None) -> F.Column:
    out = None
    for key, result in mapping:
        cond = value == F.lit(key)
        out = F.when(cond, F.lit(result)) if out is None else out.when(cond, F.lit(result))
    return out.otherwise(F.lit(default))


def _flag_every(k: F.Column, n: int) -> F.Column:
    return F.when(k % n == 0, F.lit(1.0)).otherwise(F.lit(0.0))


def _main_rows(spark: SparkSession, sf_dir: str, with_pii: bool) -> DataFrame:
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    n = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = _read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    key = F.col("c_custkey")
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    cols = [
        key.cast("bigint").alias(MainCols.ID),
        F.col("r_name").alias(MainCols.GOVERNORATE),
        F.col("n_name").alias(MainCols.DISTRICT),
        F.when(key % 7 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.col("n_name"), F.lit("-"), (key % 4).cast("string")))
        .alias(MainCols.SUB_DISTRICT),
        _by(F.col("c_mktsegment"), [("BUILDING", S.DISPLACED_TYPES[0]), ("MACHINERY", S.DISPLACED_TYPES[1]),
                                    ("FURNITURE", S.DISPLACED_TYPES[2])], S.HOST_COMMUNITY)
        .alias(MainCols.DISPLACEMENT_TYPE),
        _by(key % 5, [(0, S.HOUSING_OWN), (1, S.HOUSING_RENTING), (2, S.HOUSING_HOSTED),
                      (3, S.HOUSING_HOMELESS)], S.HOUSING_OTHER).alias(MainCols.HOUSING_TYPE),
        F.when(key % 11 == 0, F.lit(None).cast("double")).otherwise((key % 9).cast("double"))
        .alias(MainCols.FAMILY_SIZE),
        (key % 6).cast("double").alias(MainCols.DEPENDENTS),
        (key % 4).cast("double").alias(MainCols.BREADWINNERS),
    ]
    if with_pii:
        cols += [F.col("c_name").alias("_submitted_by"),
                 F.concat(F.lit("balance "), F.col("c_acctbal").cast("string")).alias("ملاحظات عن العائلة")]
    return rows.select(*cols)


def main_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registration rows (one per customer) as an anonymised export holds them."""
    return _main_rows(spark, sf_dir, with_pii=False)


def raw_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registration rows as the form tool exports them, with two PII columns."""
    return _main_rows(spark, sf_dir, with_pii=True)


def _member_rows(spark: SparkSession, sf_dir: str, with_free_text: bool) -> DataFrame:
    o = _read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    k = F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    cols = [
        F.col("o_custkey").cast("bigint").alias(MemberCols.FAMILY_ID),
        k.cast("bigint").alias("_index"),
        F.when((F.col("o_orderstatus") == "F") & (k % 4 == 0), F.lit(S.YES)).otherwise(F.lit(S.NO))
        .alias(MemberCols.IS_HOH),
        F.when(k % 3 == 0, F.lit(S.FEMALE)).otherwise(F.lit(S.MALE)).alias(MemberCols.GENDER),
        _by(F.col("o_orderpriority"), [("1-URGENT", S.WIDOW_MARITAL[0]), ("2-HIGH", S.WIDOW_MARITAL[1]),
                                       ("3-MEDIUM", S.MARRIED)], S.SINGLE).alias(MemberCols.MARITAL_STATUS),
        F.when(k % 13 == 0, F.lit(S.ORPHAN_STATUS[0])).when(k % 17 == 0, F.lit(S.ORPHAN_STATUS[1]))
        .otherwise(F.lit(S.PRESENT)).alias(MemberCols.INDIVIDUAL_STATUS),
        _flag_every(k, 101).alias(MemberCols.V_FEMALE_HOH),
        _flag_every(k, 97).alias(MemberCols.V_IMMEDIATE_HEALTH),
        _flag_every(k, 53).alias(MemberCols.V_CHRONIC_DISEASE),
        _flag_every(k, 83).alias(MemberCols.V_MENTAL_DISABILITY),
        F.when(k % 2 == 1, F.lit(None).cast("double")).otherwise(_flag_every(k, 62))
        .alias(MemberCols.V_PHYSICAL_DISABILITY),
        _flag_every(k, 29).alias(MemberCols.V_CHILD_DROPOUT),
    ]
    if with_free_text:
        cols += [
            _by(k % 12, [(1, ""), (2, "لا يعمل"), (3, "ربة منزل"), (4, "طالب جامعي"), (5, "مزارع"),
                         (6, "فلاح"), (7, "موظف"), (8, "عامل"), (9, "متقاعد"), (10, "طفل"), (11, "Driver")],
                None).alias(MemberCols.OCCUPATION_TEXT),
            F.when(k % 6 == 1, F.date_format(day, "yyyy-MM-dd"))
            .when(k % 6 == 2, F.date_format(day, "yyyy"))
            .when(k % 6 == 3, F.date_format(day, "MM/dd/yyyy"))
            .when(k % 6 == 4, F.concat(F.lit("born "), F.date_format(day, "yyyy")))
            .when(k % 6 == 5, F.lit("unknown"))
            .alias(MemberCols.DATE_OF_BIRTH),
        ]
    return o.select(*cols)


def date_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of birth (one per order) in the forms that people write, some of them no date."""
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    day, k = F.to_date("o_orderdate"), F.col("o_orderkey")
    old = F.add_months(day, -1200)
    form = lambda c, f: F.date_format(c, f)
    arabic = F.translate(form(day, "yyyy/M/d"), "0123456789", "٠١٢٣٤٥٦٧٨٩")
    texts = [form(day, "yyyyMMdd"), form(day, "MM/dd/yy"), F.concat(form(old, "yyyy-MM-dd"), F.lit(" 00:00:00")), form(old, "d/M/yyyy"),
             F.concat(F.lit("  "), form(day, "dd.MM.yyyy"), F.lit(" ")), arabic, form(day, "yyyy-dd-MM"),
             F.concat(form(day, "yyyy-MM-dd"), F.lit("T07:30:00Z")), F.concat(F.lit("about "), form(day, "yyyy")), F.lit("13/45/85"),
             F.lit("19901399"), F.concat(form(day, "yyyy"), F.lit("-02-30")), F.lit(""), F.lit("٢٠"), form(day, "d-M-yy")]
    text = F.get(F.array(*texts), (k % (len(texts) + 1)).cast("int"))  # null for the last
    return o.select(k.cast("bigint").alias("member_key"), text.alias("dob_text"))


def occupation_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupations as free sentences (one per order): a keyword within other words, white space, digits, capitals."""
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    k = F.col("o_orderkey")
    words = [w for _, keywords in S.OCCUPATION_BUCKETS for w in keywords]
    word = F.get(F.array(*[F.lit(w) for w in words]), (k % len(words)).cast("int"))
    texts = [word, F.concat(F.lit("  "), word, F.lit("\t")), F.concat(F.col("o_orderstatus"), F.lit(" "), F.upper(word), F.lit(" منذ ٢٠١٥")),
             F.concat(F.lit("كان "), word, F.lit("، والآن "), F.col("o_orderpriority")), F.lit(" \t "), F.col("o_orderstatus"), F.lit("")]
    text = F.get(F.array(*texts), (F.floor(k / 32) % (len(texts) + 1)).cast("int"))
    return o.select(k.cast("bigint").alias("member_key"), text.alias("occupation_text"))


def raw_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage rows as exported, with the form tool's columns that name people."""
    return damage_table(spark, sf_dir).withColumn(sorted(S.PII["damage"])[0], F.concat(F.lit("by "), F.col(DamageCols.FAMILY_ID)))


def raw_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Need rows as exported, with the form tool's columns that name people."""
    return needs_table(spark, sf_dir).withColumn(sorted(S.PII["needs"])[0], F.concat(F.lit("by "), F.col(NeedsCols.FAMILY_ID)))


def raw_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Person rows (one per order) as exported, with raw occupation and date-of-birth text."""
    return _member_rows(spark, sf_dir, with_free_text=True)


def members_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Person rows as an anonymised export holds them (the case builder's input)."""
    return _member_rows(spark, sf_dir, with_free_text=False)


def _lines_with_family(spark: SparkSession, sf_dir: str, cols: list[str], damage: bool) -> DataFrame:
    """Every line with its order's customer; a returned line of every fifth customer, and any line of every
    13th, is a damage record, any other line a need record."""
    li = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", *cols)
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    returned = F.col("l_returnflag").isin("A", "R") & (F.col("o_custkey") % 5 == 0)
    damaged = F.coalesce(returned | (F.col("o_custkey") % 13 == 0), F.lit(False))
    rows = li.join(o, li.l_orderkey == o.o_orderkey, "left")
    return rows.where(damaged if damage else ~damaged)


def needs_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines_with_family(spark, sf_dir, ["l_partkey", "l_suppkey", "l_quantity", "l_linestatus"], damage=False)
    p = (F.col("o_custkey") * 7 + F.col("l_partkey") % 4) % 16
    s = F.when(F.col("o_custkey") % 9 == 0, F.col("l_suppkey") % 3)
    served = (F.col("l_linestatus") == "F") & (F.col("o_custkey") % 3 == 0)
    return rows.select(
        F.col("o_custkey").cast("bigint").alias(NeedsCols.FAMILY_ID),
        F.when(p == 0, F.lit(S.PROGRAM_FINANCIAL)).when(p == 1, F.lit(S.PROGRAM_MEDICAL))
        .when(p == 2, F.lit(S.PROGRAM_LEGAL)).when(p == 3, F.lit(S.PROGRAM_EDUCATION))
        .when(p == 15, F.lit(None).cast("string")).otherwise(F.lit(S.PROGRAM_FOOD)).alias(NeedsCols.PROGRAM),
        F.when(s == 0, F.lit(S.BABY_NEEDS[0])).when(s == 1, F.lit(S.BABY_NEEDS[1]))
        .otherwise(F.lit(S.NEED_BLANKETS)).alias(NeedsCols.CLASSIFICATION),
        F.col("l_quantity").alias(NeedsCols.QUANTITY),
        F.when(served, F.lit(S.YES)).otherwise(F.lit(S.NO)).alias(NeedsCols.SERVICE_RECEIVED),
    )


def damage_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines_with_family(spark, sf_dir, ["l_partkey", "l_quantity"], damage=True)
    c = (F.col("o_custkey") + F.col("l_partkey") % 2) % 3
    return rows.select(
        F.col("o_custkey").cast("bigint").alias(DamageCols.FAMILY_ID),
        F.when(c == 0, F.lit(S.DAMAGE_CATEGORIES[0])).when(c == 1, F.lit(S.DAMAGE_CATEGORIES[1]))
        .otherwise(F.lit(S.DAMAGE_CATEGORIES[2])).alias(DamageCols.CATEGORY),
        F.col("l_quantity").alias(DamageCols.QUANTITY),
    )


@lru_cache(maxsize=64)
def case_tables(spark: SparkSession, sf_dir: str) -> CaseTables:
    return CaseTables(
        main=main_table(spark, sf_dir),
        members=members_table(spark, sf_dir),
        damage=damage_table(spark, sf_dir),
        needs=needs_table(spark, sf_dir),
    )


def intake_texts(spark: SparkSession, sf_dir: str, resent: bool = False) -> DataFrame:
    """Model responses for the intake path: one text per event, some of them not one JSON object.

    With ``resent`` every 19th has no id and every 23rd the id of the response before it, which may be
    malformed (a corrected resend) or hold another record.
    """
    e = _read(spark, sf_dir, "events").select("event_id", "user_id")
    eid = F.col("event_id")
    record = F.concat(
        F.lit('{"family_size": "'), (eid % 10).cast("string"),
        F.lit('", "city": "C'), (F.col("user_id") % 8).cast("string"),
        F.lit('", "breadwinners": "'), (eid % 3).cast("string"), F.lit('"}'),
    )
    response = (
        F.when(eid % 17 == 0, F.lit("note {broken"))
        .when(eid % 17 == 1, F.concat(record, F.lit("]}")))
        .when(eid % 17 == 2, F.concat(record, F.lit("] x ["), record))
        .when(eid % 17 == 3, F.concat(record, F.lit(", "), record))
        .when(eid % 17 == 4, F.concat(F.lit("\n\t"), record, F.lit("\n")))
        .when(eid % 17 == 5, F.lit('{"family_size": 4, "city": "م", "extra": {"a": [1, {}]}}'))
        .otherwise(F.concat(F.lit("note: "), record, F.lit(" end")))
    )
    key = F.when(eid % 19 == 0, F.lit(None).cast("bigint")).when(eid % 23 == 1, eid - 1).otherwise(eid) if resent else eid
    return e.select(key.alias("intake_id"), response.alias("response"))


def need_item_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model responses holding a JSON array of need items; some malformed."""
    e = _read(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    eid = F.col("event_id")
    items = F.concat(
        F.lit('[{"item": "'), F.col("event_type"),
        F.lit('", "category": "other", "urgency": "high"}, {"item": "v'),
        (F.col("user_id") % 5).cast("string"), F.lit('", "category": "food", "urgency": "medium"}]'),
    )
    response = (
        F.when(eid % 13 == 0, F.lit("items: [broken"))
        .when(eid % 13 == 1, F.concat(items, F.lit("] x [["), items, F.lit("]")))
        .when(eid % 13 == 2, F.concat(items, F.lit(", "), items))
        .when(eid % 13 == 3, F.concat(items, F.lit("}]")))
        .when(eid % 13 == 4, F.lit("[]"))
        .otherwise(F.concat(F.lit("items: "), items, F.lit(" done")))
    )
    return e.select(eid.alias("response_id"), response.alias("response"))
