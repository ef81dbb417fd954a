"""Dashboard aggregates, ranked lists and per-case views.

Single-row summaries are one ``agg`` with ``count_if`` columns unpivoted by an
``inline`` generator (partial + final aggregation, no join against a spine).
Top-k lists use ``orderBy(...).limit(k)``, which plans as TakeOrderedAndProject
(per-partition top-k, then a k-row merge).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseload import schema as S
from caseload.functions.scalars import capitalize, case_label, flag, labels_of, num


def _signal(df: DataFrame, name: str) -> F.Column:
    return flag(F.col(name)) if name in df.columns else F.lit(False)


def headline(df: DataFrame) -> DataFrame:
    """Families, individuals (sum of numeric sizes, truncated) and families per tier."""
    people = F.coalesce(F.sum(num(F.col("family_size"))), F.lit(0.0))
    return df.agg(
        F.count(F.lit(1)).alias("families"),
        people.cast("bigint").alias("individuals"),
        *[F.count_if(F.col("priority_tier") == F.lit(t)).alias(t.lower()) for t in S.TIER_ORDER],
    )


def tier_distribution(df: DataFrame) -> DataFrame:
    """Families per tier over the fixed tier spine, zero-filled."""
    row = df.agg(*[F.count_if(F.col("priority_tier") == F.lit(t)).alias(f"t{i}") for i, t in enumerate(S.TIER_ORDER)])
    structs = [F.struct(F.lit(i).alias("tier_pos"), F.lit(t).alias("priority_tier"),
                        F.col(f"t{i}").cast("bigint").alias("families"))
               for i, t in enumerate(S.TIER_ORDER)]
    return row.select(F.inline(F.array(*structs)))


def avg_by_tier(df: DataFrame, measure: str = "family_size") -> DataFrame:
    """Mean of the numeric measure per tier over the spine; null when a tier has no values."""
    value = num(F.col(measure))
    row = df.agg(*[F.avg(F.when(F.col("priority_tier") == F.lit(t), value)).alias(f"t{i}")
                   for i, t in enumerate(S.TIER_ORDER)])
    structs = [F.struct(F.lit(i).alias("tier_pos"), F.lit(t).alias("priority_tier"), F.col(f"t{i}").alias("avg_value"))
               for i, t in enumerate(S.TIER_ORDER)]
    return row.select(F.inline(F.array(*structs)))


def top_by_count(df: DataFrame, dim: str, n: int = 10, name: str = "families") -> DataFrame:
    """Most frequent non-null values of ``dim`` (A14, O5); ties by value."""
    return (df.where(F.col(dim).isNotNull()).groupBy(dim).agg(F.count(F.lit(1)).alias(name))
            .orderBy(F.desc(name), F.asc(dim)).limit(n))


def top_by_mean(df: DataFrame, dim: str, measure: str, n: int | None = 10, name: str = "avg_value") -> DataFrame:
    """Highest mean of ``measure`` per non-null ``dim`` (A17, O6); ties by value; all of them with ``n=None``."""
    means = (df.where(F.col(dim).isNotNull()).groupBy(dim).agg(F.avg(num(F.col(measure))).alias(name))
             .orderBy(F.desc(name), F.asc(dim)))
    return means if n is None else means.limit(n)


def signal_totals(df: DataFrame, labels=S.SIGNAL_LABELS) -> DataFrame:
    """Families per vulnerability signal, labelled (A15); order ascending by count."""
    present = [(c, lbl) for c, lbl in labels if c in df.columns]
    row = df.agg(*[F.count_if(_signal(df, c)).alias(f"s{i}") for i, (c, _) in enumerate(present)])
    structs = [F.struct(F.lit(lbl).alias("signal"), F.lit(c).alias("column"), F.col(f"s{i}").cast("bigint").alias("families"))
               for i, (c, lbl) in enumerate(present)]
    return row.select(F.inline(F.array(*structs))).orderBy("families", "signal")


def needs_by_category(needs: DataFrame) -> DataFrame:
    """Need instances per category with icon and capitalised label, ascending by count."""
    icon = F.create_map(*[F.lit(x) for pair in S.CATEGORY_ICON for x in pair])
    return (needs.groupBy("category").agg(F.sum("families_count").cast("bigint").alias("families_count"))
            .withColumn("icon", F.coalesce(icon[F.col("category")], F.lit(S.DEFAULT_ICON)))
            .withColumn("label", capitalize(F.col("category"))).orderBy("families_count", "category"))


def needs_by_urgency(needs: DataFrame) -> DataFrame:
    """Need instances per urgency over the fixed spine, zero-filled."""
    row = needs.agg(*[F.coalesce(F.sum(F.when(F.col("urgency") == F.lit(u), F.col("families_count"))), F.lit(0))
                      .cast("bigint").alias(f"u{i}") for i, u in enumerate(S.URGENCY_ORDER)])
    structs = [F.struct(F.lit(i).alias("urgency_pos"), F.lit(u).alias("urgency"), F.col(f"u{i}").alias("families"))
               for i, u in enumerate(S.URGENCY_ORDER)]
    return row.select(F.inline(F.array(*structs)))


def filter_options(df: DataFrame, dims=("city", "displacement_type")) -> DataFrame:
    """Distinct non-null values per filter dimension, ascending.

    One scan: each row yields one (dimension, value) pair per dimension, and
    the distinct is combined map-side before the shuffle.
    """
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims])
    return df.select(F.inline(pairs)).where(F.col("value").isNotNull()).distinct().orderBy("dimension", "value")


def json_records(df: DataFrame, columns: list[str]) -> DataFrame:
    """One JSON object per row with those columns."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("record"))


def column_profile(df: DataFrame, analytics: bool = False) -> DataFrame:
    """Per column: name, type and one non-null example: the smallest value, shown as text.

    The minimum is taken on the native type and only that one value is cast,
    so no row is converted to text. The analytics variant leaves out text and list columns but for
    ``PROFILE_TEXT``.
    """
    types = dict(df.dtypes)
    cols = [c for c in df.columns if not analytics or c in S.PROFILE_TEXT or not types[c].startswith(("string", "array", "map"))]
    row = df.agg(*[F.min(F.col(f"`{c}`")).cast("string").alias(f"c{i}") for i, c in enumerate(cols)])
    structs = [F.struct(F.lit(i).alias("column_pos"), F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"),
                        F.col(f"c{i}").alias("example"))
               for i, c in enumerate(cols)]
    return row.select(F.inline(F.array(*structs)))


def _totals_and_top_cities(df: DataFrame, totals: dict[str, F.Column], top_n: int) -> DataFrame:
    """One row with the totals and ``_top``: the ``top_n`` most frequent cities as (k, city, n), most first.

    One scan: the grouping sets (city) and () are aggregated together, and of the cities only the first
    ``top_n`` of each task reach the final step.
    """
    sets = df.groupingSets([["city"], []], "city").agg(
        F.grouping("city").alias("_all"), F.count(F.lit(1)).alias("_n"), *[c.alias(name) for name, c in totals.items()])
    order = Window.partitionBy("_all").orderBy(F.col("city").isNull(), F.desc("_n"), "city")
    first = sets.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= top_n)
    whole, city = F.col("_all") == 1, (F.col("_all") == 0) & F.col("city").isNotNull()
    entry = F.struct(F.negative("_n").alias("k"), F.col("city"), F.col("_n").alias("n"))
    return first.agg(*[F.coalesce(F.max(F.when(whole, F.col(name))), F.lit(0)).cast("bigint").alias(name) for name in totals],
                     F.array_sort(F.collect_list(F.when(city, entry))).alias("_top"))  # at most top_n entries


def _people(df: DataFrame) -> F.Column:
    return F.coalesce(F.sum(num(F.col("family_size"))), F.lit(0.0)).cast("bigint")


def stats(df: DataFrame, top_n: int = 5) -> DataFrame:
    """Caseload statistics (A24, A25): counts plus the top cities as ``city:n`` text."""
    totals = {
        "total_families": F.count(F.lit(1)),
        "total_individuals": _people(df),
        "critical": F.count_if(F.col("priority_tier") == "CRITICAL"),
        "high_priority": F.count_if(F.col("priority_tier") == "HIGH"),
        **{name: F.count_if(_signal(df, c)) for name, c in S.STAT_SIGNALS},
    }
    as_text = F.array_join(F.transform("_top", lambda s: F.concat(s["city"], F.lit(":"), s["n"].cast("string"))), "|")
    as_map = F.map_from_entries(F.transform("_top", lambda s: F.struct(s["city"], s["n"])))
    out = _totals_and_top_cities(df, totals, top_n)
    return out.select(*totals, as_text.alias("top_cities"), as_map.alias("_top_map"))


def stats_json(df: DataFrame, top_n: int = 5) -> DataFrame:
    """The statistics as one JSON object text."""
    s = stats(df, top_n)
    fields = [c for c in s.columns if c not in ("top_cities", "_top_map")]
    return s.select(F.to_json(F.struct(*fields, F.col("_top_map").alias("top_cities"))).alias("stats_json"))


def display_list(df: DataFrame) -> DataFrame:
    """Display projection: present display columns, boolean signals as a check mark."""
    labelled = {c for c, _ in S.SIGNAL_LABELS}
    out = []
    for c in S.DISPLAY_COLS:
        if c not in df.columns:
            continue
        out.append(F.when(flag(F.col(c)), F.lit("✓")).otherwise(F.lit("")).alias(c) if c in labelled else F.col(c))
    return df.select(*out)


def priority_order(df: DataFrame) -> DataFrame:
    """Score descending, family number as tie-break."""
    tie = "family_num" if "family_num" in df.columns else "family_id"
    return df.orderBy(F.desc("priority_score"), F.asc(tie))


def top_in_tier(df: DataFrame, tier_name: str = "CRITICAL", n: int = 10) -> DataFrame:
    """Top ``n`` families of one tier by score."""
    return priority_order(df.where(F.col("priority_tier") == F.lit(tier_name))).limit(n)


def case_labels(df: DataFrame) -> DataFrame:
    """Picker labels ``Family #nnn  ·  city  ·  TIER  (score n)``."""
    return df.select("family_num", "priority_score",
                     case_label(F.col("family_num"), F.col("city"), F.col("priority_tier"), F.col("priority_score"))
                     .alias("label"))


def signal_labels(df: DataFrame, labels=S.SIGNAL_LABELS) -> DataFrame:
    """Labels of each family's true signals, declared order."""
    return df.select("family_id", labels_of(labels, df.columns).alias("signal_labels"))


def find_case(df: DataFrame, family_num: int | None = None, family_id=None) -> DataFrame:
    """The rows of one case by its number or its id (F10): plain equalities, which the Parquet scan takes over.

    On tables of ``sources.tables.write_cases`` the row groups' bounds and Bloom filters then exclude the others. The
    value is cast to the column's type on the driver, as a cast of the column would keep the filter from the scan; an id
    that is not of that type matches nothing.
    """
    if (family_num is None) == (family_id is None):
        raise ValueError("give either family_num or family_id")
    name, value = ("family_num", family_num) if family_id is None else ("family_id", family_id)
    kind = dict(df.dtypes)[name]
    if kind == "string":
        value = str(value)
    else:
        try:
            value = int(value)
        except ValueError:
            return df.where(F.lit(False))
    return df.where(F.col(name) == F.lit(value).cast(kind))


def case_profile(df: DataFrame, family_num: int | None = None, family_id=None) -> DataFrame:
    """Non-empty fields of one case as (field, value) rows.

    Without ``family_num`` or ``family_id`` the first case of the priority order is shown (the
    picker's default). Identifiers, scores, signals and list fields are skipped.
    """
    if family_num is None and family_id is None:
        case = priority_order(df).limit(1)
    else:
        case = find_case(df, family_num, family_id)
    types = dict(case.dtypes)
    fields = [c for c in case.columns
              if c not in S.PROFILE_SKIP and not c.startswith("is_") and not types[c].startswith(("array", "map"))]
    pos = {c: i for i, c in enumerate(case.columns)}
    structs = [F.struct(F.lit(pos[c]).alias("field_pos"), F.lit(c).alias("field"),
                        F.col(f"`{c}`").cast("string").alias("value")) for c in fields]
    rows = case.select("family_num", F.inline(F.array(*structs)))
    return rows.where(F.col("value").isNotNull() & (F.trim(F.col("value")) != "") & (F.col("value") != "nan"))


def needs_display(needs) -> DataFrame:
    """The needs table as shown: icon by category (default icon), six columns."""
    icon = F.create_map(*[F.lit(x) for pair in S.CATEGORY_ICON for x in pair])
    return needs.select(
        F.coalesce(icon[F.col("category")], F.lit(S.DEFAULT_ICON)).alias("icon"),
        F.col("need_item").alias("need"), "category", "urgency",
        F.col("families_count").alias("families"), F.col("pct_of_total").alias("pct_of_total"),
    )


def thousands(c: F.Column) -> F.Column:
    """Whole number with thousands separators, e.g. 1,234,567."""
    return F.format_number(c.cast("bigint"), 0)


def headline_cards(df: DataFrame, budget: DataFrame) -> DataFrame:
    """Overview and budget numbers formatted for display.

    ``budget`` is the financial totals table; its grand total is attached as a
    scalar subquery (one value), not joined.
    """
    grand = budget.where(F.col("category") == F.lit(S.GRAND_TOTAL)).select("total_usd").scalar()
    h = headline(df)
    return h.select(
        thousands(F.col("families")).alias("families"),
        thousands(F.col("individuals")).alias("individuals"),
        *[thousands(F.col(t.lower())).alias(t.lower()) for t in S.TIER_ORDER],
        F.concat(F.lit("$"), thousands(grand)).alias("monthly_budget"),
    )


def fallback_stats(df: DataFrame, top_n: int = 5) -> DataFrame:
    """Short statistics: families, members, displaced / medical / homeless and the top city names."""
    totals = {
        "families": F.count(F.lit(1)),
        "members": _people(df),
        "displaced": F.count_if(_signal(df, "is_displaced")),
        "with_medical_needs": F.count_if(_signal(df, "has_medical")),
        "homeless": F.count_if(_signal(df, "is_homeless")),
    }
    out = _totals_and_top_cities(df, totals, top_n)
    return out.select(*totals, F.array_join(F.transform("_top", lambda s: s["city"]), ", ").alias("top_cities"))


def queue_headline(df: DataFrame) -> DataFrame:
    """Priority-queue cards over the (filtered) list: shown, critical, high, individuals."""
    return df.agg(
        F.count(F.lit(1)).alias("shown"),
        F.count_if(F.col("priority_tier") == "CRITICAL").alias("critical"),
        F.count_if(F.col("priority_tier") == "HIGH").alias("high"),
        F.coalesce(F.sum(num(F.col("family_size"))), F.lit(0.0)).alias("individuals"),
    )


def top_cities(df: DataFrame, n: int = 10) -> DataFrame:
    """Families per city, most first."""
    return top_by_count(df, "city", n)


def avg_by(df: DataFrame, dim: str, measure: str, n: int | None = None, spine=None) -> DataFrame:
    """Mean of ``measure`` per ``dim``.

    With ``spine`` the result has exactly those values of ``dim`` in order (null
    when a value has no rows); otherwise the top ``n`` by mean (all with None), ties by value.
    """
    if spine is None:
        return top_by_mean(df, dim, measure, n)
    value = num(F.col(measure))
    row = df.agg(*[F.avg(F.when(F.col(dim) == F.lit(v), value)).alias(f"v{i}") for i, v in enumerate(spine)])
    structs = [F.struct(F.lit(i).alias("pos"), F.lit(v).alias(dim), F.col(f"v{i}").alias("avg_value"))
               for i, v in enumerate(spine)]
    return row.select(F.inline(F.array(*structs)))
