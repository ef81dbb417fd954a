"""Flat case table: the four survey tables reduced to one row per family.

Members and damage are each reduced by ONE grouped aggregation on the family
key (all booleans and counts of that child at once); needs are first reduced
to (family, program) pairs and then to one row per family. Partial
aggregation combines rows map-side before every shuffle, so a family holding
a third of all child rows still ships one row per map task. The three
per-family results are then left-joined to the registrations. Their output is
already hash-partitioned on ``family_id``, so the joins shuffle only the
registrations, once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseload import schema as S
from caseload.functions.scalars import col_or, flag, is_one, num, row_max_is_one
from caseload.schema import CaseTables, DamageCols, MainCols, MemberCols, NeedsCols


def _key(df: DataFrame, name: str) -> F.Column:
    """Family key as a long. Integer keys are cast directly (never through a double); text keys
    such as "12" or "12.0" parse; anything else is null and never matches."""
    c = F.col(f"`{name}`")
    if dict(df.dtypes).get(name) == "string":
        return F.coalesce(c.try_cast("bigint"), num(c).try_cast("bigint"))
    return c.try_cast("bigint")


def _typed(c: F.Column, dtype: str) -> F.Column:
    """Numbers through ``num`` (text from a schema-less CSV parses), dates through ``try_cast``."""
    return num(c) if dtype == "double" else c.try_cast(dtype)


def member_signals(members: DataFrame) -> DataFrame:
    """Per family: widow / orphan / medical / disability flags and member counts."""
    m = members
    hoh = flag(col_or(m, MemberCols.IS_HOH) == F.lit(S.YES))
    widow = flag(hoh & (col_or(m, MemberCols.GENDER) == F.lit(S.FEMALE))
                 & col_or(m, MemberCols.MARITAL_STATUS).isin(*S.WIDOW_MARITAL)) \
        | is_one(col_or(m, MemberCols.V_FEMALE_HOH))
    orphan = flag(hoh & col_or(m, MemberCols.INDIVIDUAL_STATUS).isin(*S.ORPHAN_STATUS))
    chronic = is_one(col_or(m, MemberCols.V_CHRONIC_DISEASE))
    medical = is_one(col_or(m, MemberCols.V_IMMEDIATE_HEALTH)) | chronic
    disabled = row_max_is_one([F.col(f"`{c}`") for c in S.DISABILITY_FLAGS if c in m.columns])
    dropout = is_one(col_or(m, MemberCols.V_CHILD_DROPOUT))
    fid = _key(m, MemberCols.FAMILY_ID)
    return (
        m.where(fid.isNotNull())
        .groupBy(fid.alias("family_id"))
        .agg(
            F.bool_or(widow).alias("_m_widow"),
            F.bool_or(orphan).alias("_m_orphan"),
            F.bool_or(medical).alias("_m_medical"),
            F.bool_or(disabled).alias("_m_disability"),
            F.nullif(F.count_if(chronic), F.lit(0)).alias("chronic_disease_members"),
            F.nullif(F.count_if(disabled), F.lit(0)).alias("disability_members"),
            F.nullif(F.count_if(dropout), F.lit(0)).alias("school_dropout_children"),
            F.count(F.lit(1)).alias("member_count"),
        )
    )


def program_counts(needs: DataFrame) -> DataFrame:
    """Need rows per (family, program), with the row-level need flags pre-combined."""
    n = needs
    fid = _key(n, NeedsCols.FAMILY_ID)
    return (
        n.where(fid.isNotNull())
        .groupBy(fid.alias("family_id"), col_or(n, NeedsCols.PROGRAM, dtype="string").alias("program"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.bool_or(flag(col_or(n, NeedsCols.CLASSIFICATION).isin(*S.BABY_NEEDS))).alias("baby"),
            F.bool_or(flag(col_or(n, NeedsCols.SERVICE_RECEIVED) == F.lit(S.YES))).alias("served"),
        )
    )


def need_signals(needs: DataFrame, top: int = 2) -> DataFrame:
    """Per family: financial / medical / infant / service flags, top programs and program list.

    ``need_type`` joins the ``top`` most frequent non-null programs by ", "; ties
    break by program text. ``needs_programs`` is the sorted distinct non-null list.
    Rows are first reduced to one per (family, program), so a family's list holds
    one entry per distinct program. The branch ends in a grouped aggregate, so its key is
    provably unique and the optimizer drops its join from queries that use none of its columns.
    """
    known = F.col("program").isNotNull()
    ranked = F.array_sort(F.collect_list(F.when(known, F.struct(F.negative("n").alias("less"), F.col("program")))))
    leading = F.transform(F.slice(ranked, 1, top), lambda x: x["program"])
    return program_counts(needs).groupBy("family_id").agg(
        F.bool_or(flag(F.col("program") == F.lit(S.PROGRAM_FINANCIAL))).alias("_n_financial"),
        F.bool_or(flag(F.col("program") == F.lit(S.PROGRAM_MEDICAL))).alias("_n_medical"),
        F.bool_or("baby").alias("_n_baby"),
        F.bool_or("served").alias("_n_served"),
        F.array_join(leading, ", ").alias("need_type"),
        F.array_sort(F.collect_list("program")).alias("needs_programs"),
    )


def damage_signals(damage: DataFrame) -> DataFrame:
    """Per family: damage presence and sorted distinct categories.

    ``collect_set`` aggregates partially, so a map task ships at most one
    set of distinct categories per family.
    """
    d = damage
    fid = _key(d, DamageCols.FAMILY_ID)
    return (
        d.where(fid.isNotNull())
        .groupBy(fid.alias("family_id"))
        .agg(
            F.lit(True).alias("_d_any"),
            F.array_sort(F.collect_set(col_or(d, DamageCols.CATEGORY, dtype="string"))).alias("damage_categories"),
        )
    )


_RENAMES = (
    (MainCols.FAMILY_SIZE, "family_size", "double"),
    (MainCols.DEPENDENTS, "dependents", "double"),
    (MainCols.BREADWINNERS, "breadwinners", "double"),
    (MainCols.SURVEY_DATE, "survey_date", "date"),
)


#: Columns of the case table that come from the registrations alone.
REGISTRATION_COLUMNS = ["family_size", "dependents", "breadwinners", "city", "governorate", "displacement_type", "housing_type"]


def build_cases(tables: CaseTables) -> DataFrame:
    """One row per registration row with the 11 signals, counts and need summaries (§1.4)."""
    main = tables.main
    mem = member_signals(tables.members)
    need = need_signals(tables.needs)
    dmg = damage_signals(tables.damage)

    gov = col_or(main, MainCols.GOVERNORATE, dtype="string")
    dist = col_or(main, MainCols.DISTRICT, dtype="string")
    sub = col_or(main, MainCols.SUB_DISTRICT, dtype="string")
    disp = col_or(main, MainCols.DISPLACEMENT_TYPE, dtype="string")
    housing = col_or(main, MainCols.HOUSING_TYPE, dtype="string")
    bw = col_or(main, MainCols.BREADWINNERS, dtype="double")

    renamed = {src for src, _, _ in _RENAMES}
    passthrough = [c for c in main.columns if c != MainCols.ID and c not in S.MAIN_DROP_COLS and c not in renamed]
    base = main.select(
        _key(main, MainCols.ID).alias("family_id"),
        *[F.col(f"`{c}`") for c in passthrough],
        *[_typed(col_or(main, src, dtype=t), t).alias(dst) for src, dst, t in _RENAMES],
        F.coalesce(sub, dist, gov).alias("city"),
        gov.alias("governorate"),
        disp.alias("displacement_type"),
        housing.alias("housing_type"),
        flag(disp.isin(*S.DISPLACED_TYPES)).alias("is_displaced"),
        flag(housing == F.lit(S.HOUSING_HOMELESS)).alias("is_homeless"),
        flag(housing == F.lit(S.HOUSING_RENTING)).alias("is_renting"),
        flag(num(bw) == F.lit(0.0)).alias("_no_breadwinner"),
        # registrations without an id never match; a hash of the row spreads them over the join's tasks
        F.coalesce(_key(main, MainCols.ID), F.xxhash64(*[F.col(f"`{c}`") for c in main.columns])).alias("_key"),
        _key(main, MainCols.ID).isNotNull().alias("_known"),
    )
    joined = base
    for child in (mem, need, dmg):
        side = child.withColumnRenamed("family_id", "_key").withColumn("_known", F.lit(True))
        joined = joined.join(side, ["_key", "_known"], "left")
    false = F.lit(False)
    return joined.select(
        "family_id",
        *[F.col(f"`{c}`") for c in passthrough],
        "family_size", "dependents", "breadwinners", "survey_date",
        "city", "governorate", "displacement_type", "housing_type",
        F.coalesce("_m_widow", false).alias("is_widow"),
        F.coalesce("_m_orphan", false).alias("is_orphan_family"),
        "is_displaced", "is_homeless", "is_renting",
        (F.col("_no_breadwinner") | F.coalesce("_n_financial", false)).alias("is_unemployed"),
        (F.coalesce("_m_medical", false) | F.coalesce("_n_medical", false)).alias("has_medical"),
        F.coalesce("_m_disability", false).alias("has_disability"),
        F.coalesce("_n_baby", false).alias("is_pregnant"),
        F.coalesce("_d_any", false).alias("has_damage"),
        F.coalesce("_n_served", false).alias("service_received"),
        "chronic_disease_members", "disability_members", "school_dropout_children", "member_count",
        F.coalesce("need_type", F.lit("")).alias("need_type"),
        "needs_programs", "damage_categories",
        F.lit(S.SOURCE_FILE).alias("source_file"),
        F.lit(S.SOURCE_SHEET).alias("source_sheet"),
    )


def families_without(main: DataFrame, child: DataFrame, child_key: str) -> DataFrame:
    """Registrations with no row in ``child`` (anti join on the family key)."""
    keys = _distinct_keys(child, child_key)
    return main.join(keys, _key(main, MainCols.ID) == keys.family_id, "left_anti")


def families_with(main: DataFrame, child: DataFrame, child_key: str) -> DataFrame:
    """Registrations with at least one row in ``child`` (semi join on the family key)."""
    keys = _distinct_keys(child, child_key)
    return main.join(keys, _key(main, MainCols.ID) == keys.family_id, "left_semi")


def _distinct_keys(child: DataFrame, child_key: str) -> DataFrame:
    """Distinct non-null family keys of a child table; deduplicated map-side before the shuffle."""
    return child.select(_key(child, child_key).alias("family_id")).where(F.col("family_id").isNotNull()).distinct()


def top_programs(needs: DataFrame, n: int = 2) -> DataFrame:
    """Per family: the ``n`` most frequent non-null programs joined by ", " (A5, W2)."""
    return need_signals(needs, top=n).select("family_id", "need_type")


def distinct_list(df: DataFrame, key: str, col: str, name: str) -> DataFrame:
    """Per key: sorted distinct non-null values of ``col`` (A6, A7); partial aggregation bounds each map task."""
    k = _key(df, key)
    return (df.where(k.isNotNull()).groupBy(k.alias("family_id"))
            .agg(F.array_sort(F.collect_set(F.col(f"`{col}`"))).alias(name)))
