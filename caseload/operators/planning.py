"""Caseload-wide planning: needs, rations, medical supplies, budgets.

All caseload totals come from ONE single-row aggregate over the case table
(``needs_summary``): every rule becomes a ``count_if`` / ``sum`` column, so the
whole needs report is a single scan with partial aggregation, no join and no
explode. The long-format tables are then unpivoted from that one row with an
``inline`` generator over literal rule structs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseload import schema as S
from caseload.functions.scalars import clipped_size, flag, inline_rows, sql_literal, truncated


def _sig(df: DataFrame, signal: str | None) -> F.Column:
    if signal is None:
        return F.lit(True)
    return flag(F.col(signal)) if signal in df.columns else F.lit(False)


def need_items(rules=S.NEED_RULES) -> list[tuple[str, str, str, list]]:
    """Distinct items in first-seen rule order with all their signals (an item counts once per family)."""
    items: dict[str, tuple[str, str, list]] = {}
    for signal, item, cat, urg in rules:
        if item not in items:
            items[item] = (cat, urg, [])
        items[item][2].append(signal)
    return [(item, cat, urg, sigs) for item, (cat, urg, sigs) in items.items()]


def _item_pred(df: DataFrame, signals: list) -> F.Column:
    if any(s is None for s in signals):
        return F.lit(True)
    out = _sig(df, signals[0])
    for s in signals[1:]:
        out = out | _sig(df, s)
    return out


def _size(df: DataFrame, base_people: int) -> F.Column:
    return clipped_size(F.col("family_size") if "family_size" in df.columns else F.lit(None), base_people)


def _cost_columns(df: DataFrame, rates=S.FINANCIAL_RATES) -> list[tuple[str, str, F.Column]]:
    rate = dict(rates)
    size_int = truncated(_size(df, S.RATION_BASE_PEOPLE))
    out = []
    for label, col_name, rate_name, signal in S.COST_LINES:
        amount = F.lit(rate[rate_name])
        if signal is None and "person" in rate_name:
            value = size_int * amount
        elif signal is None:
            value = amount.cast("bigint")
        else:
            value = F.when(_sig(df, signal), amount).otherwise(F.lit(0)).cast("bigint")
        out.append((label, col_name, value.cast("bigint")))
    return out


def _sig_sql(df: DataFrame, signal: str | None) -> str:
    if signal is None:
        return "true"
    return f"coalesce(`{signal}`, false)" if signal in df.columns else "false"


def _size_sql(df: DataFrame, base_people: int) -> str:
    """SQL twin of ``clipped_size``: numeric size, NaN/unparseable → default, at least 1."""
    if "family_size" not in df.columns:
        return f"CAST({base_people} AS DOUBLE)"
    d = "try_cast(family_size AS DOUBLE)"
    return (f"greatest(coalesce(CASE WHEN isnan({d}) THEN NULL ELSE {d} END, CAST({base_people} AS DOUBLE)), "
            "CAST(1 AS DOUBLE))")


def needs_summary(df: DataFrame, need_rules=S.NEED_RULES, medical_rules=S.MEDICAL_RULES,
                  rates=S.FINANCIAL_RATES, base_people: int = S.RATION_BASE_PEOPLE) -> DataFrame:
    """The fused needs report: one row holding every caseload total of A8-A11, A20-A22.

    One global aggregate (partial per task, one row per task merged), written
    as SQL aggregate expressions so the ~35 rule columns cost one plan call.
    """
    return df.selectExpr(*summary_aggregates(df, need_rules, medical_rules, rates, base_people))


def summary_aggregates(df: DataFrame, need_rules=S.NEED_RULES, medical_rules=S.MEDICAL_RULES,
                       rates=S.FINANCIAL_RATES, base_people: int = S.RATION_BASE_PEOPLE) -> list[str]:
    """The aggregate expressions of ``needs_summary``: counts and sums, so rows of parts of a table add up."""
    size = _size_sql(df, base_people)
    size_int = f"try_cast({size} AS BIGINT)"
    aggs = ["count(1) AS families"]
    for i, (_, _, _, sigs) in enumerate(need_items(need_rules)):
        pred = "true" if any(x is None for x in sigs) else " OR ".join(_sig_sql(df, x) for x in sigs)
        aggs.append(f"count_if({pred}) AS need_{i}")
    for sig in dict.fromkeys(x for x, _, _, _ in medical_rules):
        aggs.append(f"count_if({_sig_sql(df, sig)}) AS med_{sig}")
    aggs += [
        f"coalesce(sum({size} / CAST({base_people} AS DOUBLE)), CAST(0 AS DOUBLE)) AS ration_scale",
        f"CAST(coalesce(sum(ceil({size_int} / {base_people})), 0) AS BIGINT) AS ration_packs",
        f"CAST(coalesce(sum({size_int}), 0) AS BIGINT) AS ration_people",
    ]
    rate = dict(rates)
    for _, col_name, rate_name, signal in S.COST_LINES:
        amount = rate[rate_name]
        if signal is None and "person" in rate_name:
            value = f"{size_int} * {amount}"
        elif signal is None:
            value = str(amount)
        else:
            value = f"CASE WHEN {_sig_sql(df, signal)} THEN {amount} ELSE 0 END"
        aggs.append(f"CAST(coalesce(sum({value}), 0) AS BIGINT) AS sum_{col_name}")
    return aggs


def aggregate_needs(df: DataFrame, rules=S.NEED_RULES, summary: DataFrame | None = None) -> DataFrame:
    """Per need item: families needing it and their share (A8, O3); zero-count items absent."""
    row = summary if summary is not None else needs_summary(df, need_rules=rules)
    rank = dict(S.URGENCY_RANK)
    total = "CAST(greatest(families, 1) AS DOUBLE)"
    rows = [
        [("need_item", sql_literal(item)), ("category", sql_literal(cat)), ("urgency", sql_literal(urg)),
         ("families_count", f"CAST(need_{i} AS BIGINT)"),
         ("pct_of_total", f"round(CAST(need_{i} AS DOUBLE) / {total} * CAST(100 AS DOUBLE), 1)"),
         ("urgency_rank", str(rank.get(urg, len(rank))))]
        for i, (item, cat, urg, _) in enumerate(need_items(rules))
    ]
    return inline_rows(row, rows).where(F.col("families_count") > 0)


def ordered_needs(needs: DataFrame) -> DataFrame:
    """Urgency rank ascending, family count descending, item text as tie-break (O3)."""
    return needs.orderBy("urgency_rank", F.desc("families_count"), "need_item")


def family_need_items(df: DataFrame, rules=S.NEED_RULES) -> DataFrame:
    """One row per (family, need item) that applies to it."""
    structs = [
        F.when(_item_pred(df, sigs), F.struct(
            F.lit(pos).alias("item_pos"), F.lit(item).alias("need_item"),
            F.lit(cat).alias("category"), F.lit(urg).alias("urgency")))
        for pos, (item, cat, urg, sigs) in enumerate(need_items(rules))
    ]
    keep = [c for c in ("family_num", "family_id") if c in df.columns]
    items = F.filter(F.array(*structs), lambda s: s.isNotNull())
    return df.select(*keep, F.inline(items))


def ration_packs(df: DataFrame, base_people: int = S.RATION_BASE_PEOPLE) -> DataFrame:
    """Per family: truncated planning size and ceil(size / base) ration packs."""
    size_int = truncated(_size(df, base_people))
    keep = [c for c in ("family_num", "family_id") if c in df.columns]
    return df.select(*keep, size_int.alias("family_size"),
                     F.ceil(size_int / F.lit(base_people)).cast("bigint").alias("ration_packs"))


def ration_totals(df: DataFrame, basket=S.RATION_BASKET, base_people: int = S.RATION_BASE_PEOPLE,
                  summary: DataFrame | None = None) -> DataFrame:
    """Per basket item: total quantity for the caseload from the untruncated sizes."""
    row = summary if summary is not None else needs_summary(df, base_people=base_people)
    rows = [
        [("item_pos", str(pos)), ("item", sql_literal(item)), ("unit", sql_literal(unit)),
         ("qty_per_basket", sql_literal(float(qty))),
         ("total_needed", f"round({sql_literal(float(qty))} * ration_scale, 1)")]
        for pos, (item, qty, unit) in enumerate(basket)
    ]
    return inline_rows(row, rows)


def ration_headline(df: DataFrame, basket=S.RATION_BASKET, summary: DataFrame | None = None) -> DataFrame:
    """Total packs, people covered, basket size."""
    row = summary if summary is not None else needs_summary(df)
    return row.select(F.col("ration_packs").alias("total_packs"), F.col("ration_people").alias("total_people"),
                      F.lit(len(basket)).cast("bigint").alias("basket_items"))


def medical_supplies(df: DataFrame, rules=S.MEDICAL_RULES, summary: DataFrame | None = None) -> DataFrame:
    """Per supply item: qualifying families and total quantity, rule order (A10, O4); zero items absent."""
    row = summary if summary is not None else needs_summary(df, medical_rules=rules)
    rows = [
        [("item_pos", str(pos)), ("item", sql_literal(item)), ("unit", sql_literal(unit)),
         ("families", f"CAST(med_{sig} AS BIGINT)"), ("total_qty", f"CAST(med_{sig} * {int(qty)} AS BIGINT)")]
        for pos, (sig, item, qty, unit) in enumerate(rules)
    ]
    return inline_rows(row, rows).where(F.col("families") > 0)


def medical_headline(df: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """Item types needed and the largest family count of any item."""
    med = medical_supplies(df, summary=summary)
    return med.agg(F.count(F.lit(1)).alias("item_types"),
                   F.coalesce(F.max("families"), F.lit(0)).cast("bigint").alias("max_families"))


def needs_headline(df: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """Item types, critical and high types, total need instances."""
    needs = aggregate_needs(df, summary=summary)
    return needs.agg(
        F.count(F.lit(1)).alias("item_types"),
        F.count_if(F.col("urgency") == "critical").alias("critical_types"),
        F.count_if(F.col("urgency") == "high").alias("high_types"),
        F.coalesce(F.sum("families_count"), F.lit(0)).cast("bigint").alias("total_instances"),
    )


def family_costs(df: DataFrame, rates=S.FINANCIAL_RATES) -> DataFrame:
    """Per family monthly cost lines and total in USD."""
    costs = _cost_columns(df, rates)
    total = costs[0][2]
    for _, _, value in costs[1:]:
        total = total + value
    keep = [c for c in ("family_num", "family_id") if c in df.columns]
    return df.select(*keep, truncated(_size(df, S.RATION_BASE_PEOPLE)).alias("size"),
                     *[v.alias(name) for _, name, v in costs], total.alias("monthly_total_usd"))


def financial_totals(df: DataFrame, rates=S.FINANCIAL_RATES, summary: DataFrame | None = None) -> DataFrame:
    """Caseload totals per cost line plus the grand total, in line order."""
    row = summary if summary is not None else needs_summary(df, rates=rates)
    lines = [(label, f"sum_{col_name}") for label, col_name, _, _ in S.COST_LINES]
    lines.append((S.GRAND_TOTAL, " + ".join(expr for _, expr in lines)))
    rows = [[("line_pos", str(pos)), ("category", sql_literal(label)), ("total_usd", f"CAST({expr} AS BIGINT)")]
            for pos, (label, expr) in enumerate(lines)]
    return inline_rows(row, rows)


def budget_breakdown(df: DataFrame, rates=S.FINANCIAL_RATES, summary: DataFrame | None = None) -> DataFrame:
    """Positive cost lines without the grand total."""
    return financial_totals(df, rates, summary).where(
        (F.col("category") != F.lit(S.GRAND_TOTAL)) & (F.col("total_usd") > 0))


def rate_usage(df: DataFrame, rates=S.FINANCIAL_RATES, summary: DataFrame | None = None) -> DataFrame:
    """The rate assumptions (S7) with the caseload units each applies to and the resulting line total.

    Per-person rates apply to the truncated planning sizes, the others to the
    qualifying families; ``units * rate_usd`` equals the matching cost line.
    """
    row = summary if summary is not None else needs_summary(df, rates=rates)
    rate = dict(rates)
    rows = []
    for pos, (_, col_name, rate_name, signal) in enumerate(S.COST_LINES):
        per_person = "person" in rate_name
        units = "ration_people" if per_person else "families" if signal is None else f"sum_{col_name} DIV {rate[rate_name]}"
        rows.append([
            ("rate_pos", str(pos)), ("category", sql_literal(rate_name)),
            ("rate_usd", f"CAST({rate[rate_name]} AS BIGINT)"),
            ("applied_to", sql_literal("per person" if per_person else "per qualifying family")),
            ("units", f"CAST({units} AS BIGINT)"), ("total_usd", f"CAST(sum_{col_name} AS BIGINT)"),
        ])
    return inline_rows(row, rows)


REPORT_COLUMNS = ("section", "pos", "item", "category", "urgency", "unit", "families", "amount", "share")


def needs_report_table(df: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """The whole needs report as one long table, from one scan and one generator (§3.2).

    Sections: ``needs`` (families, share in %), ``rations`` (amount = total
    quantity), ``medical`` (families, amount = total quantity) and ``budget``
    (amount = USD, last line the grand total). Zero-count need and medical
    items are absent, as in the separate tables.
    """
    row = summary if summary is not None else needs_summary(df)
    rank = dict(S.URGENCY_RANK)
    total = "CAST(greatest(families, 1) AS DOUBLE)"
    no_s, no_l, no_d = "CAST(NULL AS STRING)", "CAST(NULL AS BIGINT)", "CAST(NULL AS DOUBLE)"

    def line(section, pos, item, category, urgency, unit, families, amount, share):
        return [("section", sql_literal(section)), ("pos", str(pos)), ("item", sql_literal(item)),
                ("category", category), ("urgency", urgency), ("unit", unit),
                ("families", f"CAST({families} AS BIGINT)"), ("amount", f"CAST({amount} AS DOUBLE)"),
                ("share", f"CAST({share} AS DOUBLE)")]

    lines = []
    for i, (item, cat, urg, _) in enumerate(need_items()):
        share = f"round(CAST(need_{i} AS DOUBLE) / {total} * CAST(100 AS DOUBLE), 1)"
        lines.append(line("needs", rank.get(urg, len(rank)), item, sql_literal(cat), sql_literal(urg), no_s,
                          f"need_{i}", no_d, share))
    for pos, (item, qty, unit) in enumerate(S.RATION_BASKET):
        lines.append(line("rations", pos, item, no_s, no_s, sql_literal(unit), no_l,
                          f"round({sql_literal(float(qty))} * ration_scale, 1)", no_d))
    for pos, (sig, item, qty, unit) in enumerate(S.MEDICAL_RULES):
        lines.append(line("medical", pos, item, no_s, no_s, sql_literal(unit), f"med_{sig}",
                          f"med_{sig} * {int(qty)}", no_d))
    costs = [f"sum_{col_name}" for _, col_name, _, _ in S.COST_LINES]
    for pos, (label, _, _, _) in enumerate(S.COST_LINES):
        lines.append(line("budget", pos, label, no_s, no_s, "'USD'", no_l, costs[pos], no_d))
    lines.append(line("budget", len(S.COST_LINES), S.GRAND_TOTAL, no_s, no_s, "'USD'", no_l, " + ".join(costs), no_d))
    out = inline_rows(row, lines)
    zero = F.col("section").isin("needs", "medical") & (F.col("families") == 0)
    return out.where(~zero)


def _basket_quantity() -> F.Column:
    """What one basket holds of the item in ``pos``."""
    return F.get(F.array(*[F.lit(float(qty)) for _, qty, _ in S.RATION_BASKET]), F.col("pos"))


def needs_report(df: DataFrame) -> dict[str, DataFrame]:
    """The needs report: the long table (one scan, cached; it is a few dozen rows) and per-section views."""
    table = needs_report_table(df).cache()
    needs = table.where(F.col("section") == "needs").select(
        F.col("item").alias("need_item"), "category", "urgency", F.col("families").alias("families_count"),
        F.col("share").alias("pct_of_total"), F.col("pos").alias("urgency_rank"))
    return {
        "table": table,
        "aggregate_needs": ordered_needs(needs),
        "ration_totals": table.where(F.col("section") == "rations").select(
            F.col("pos").alias("item_pos"), "item", _basket_quantity().alias("qty_per_basket"), "unit",
            F.col("amount").alias("total_needed")),
        "medical_supplies": table.where(F.col("section") == "medical").select(
            F.col("pos").alias("item_pos"), "item", "unit", "families", F.col("amount").cast("bigint").alias("total_qty")),
        "financial_totals": table.where(F.col("section") == "budget").select(
            F.col("pos").alias("line_pos"), F.col("item").alias("category"), F.col("amount").cast("bigint").alias("total_usd")),
    }
