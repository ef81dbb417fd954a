"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator key.

Every query reads the benchmark tables of ``sf_dir`` through the survey
adapters, so its work grows with the data. Output columns carry the same
names and types as the DuckDB statements in ``caseload.plans.oracle``;
integer outputs are BIGINT, list outputs are ``|``-joined text.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseload import schema as S
from caseload.functions import scalars
from caseload.operators import cases as C
from caseload.operators import intake, partials, planning, privacy, reports, search
from caseload.plans import context
from caseload.schema import DamageCols, MemberCols, NeedsCols
from caseload.sources import adapters
from caseload.streaming.intake_stream import parts_path

Query = Callable[[SparkSession, str], DataFrame]


def _joined(c: str) -> F.Column:
    return F.array_join(F.col(c), "|").alias(c)


def _big(*names: str) -> list[F.Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]


# --- case table (J*, A1-A7, X1-X3, W1) -----------------------------------------

SIGNAL_COLS = list(S.SIGNALS)


def case_flags(spark, d):
    c = C.build_cases(context.tables(spark, d))
    return c.select("family_id", "city", "governorate", "displacement_type", "housing_type", "family_size",
                    *SIGNAL_COLS)


def member_counts(spark, d):
    c = C.build_cases(context.tables(spark, d))
    return c.select("family_id", "chronic_disease_members", "disability_members", "school_dropout_children",
                    "member_count")


def priority_scores(spark, d):
    return context.built_cases(spark, d).select("family_id", *_big("priority_score"), "priority_tier")


def family_numbering(spark, d):
    return context.cases(spark, d).select("family_id", "family_num")


def priority_list(spark, d):
    c = reports.priority_order(context.cases(spark, d))
    return c.select("family_num", "family_id", *_big("priority_score"), "priority_tier", "city", "family_size")


def top_critical(spark, d):
    top = reports.top_in_tier(context.cases(spark, d), "CRITICAL", 10)
    return reports.display_list(top).withColumn("priority_score", F.col("priority_score").cast("bigint"))


def tier_distribution(spark, d):
    return reports.tier_distribution(context.cases(spark, d))


def need_type(spark, d):
    return C.build_cases(context.tables(spark, d)).select("family_id", "need_type")


def needs_programs(spark, d):
    return C.build_cases(context.tables(spark, d)).select("family_id", _joined("needs_programs"))


def damage_categories(spark, d):
    return C.build_cases(context.tables(spark, d)).select("family_id", _joined("damage_categories"))


def damage_semi(spark, d):
    t = context.tables(spark, d)
    rows = C.families_with(t.main, t.damage, DamageCols.FAMILY_ID)
    return rows.select(F.col(f"`{S.MainCols.ID}`").alias("family_id"),
                       F.col(f"`{S.MainCols.GOVERNORATE}`").alias("governorate"))


def unserved_families(spark, d):
    t = context.tables(spark, d)
    rows = C.families_without(t.main, t.needs, NeedsCols.FAMILY_ID)
    return rows.select(F.col(f"`{S.MainCols.ID}`").alias("family_id"),
                       F.col(f"`{S.MainCols.GOVERNORATE}`").alias("governorate"))


def city_fallback(spark, d):
    return C.build_cases(context.tables(spark, d)).select("family_id", "city")


# --- planning (A8-A11, N1-N2, A20-A22) -----------------------------------------


def aggregate_needs(spark, d):
    return planning.ordered_needs(planning.aggregate_needs(context.cases(spark, d)))


def family_need_items(spark, d):
    return planning.family_need_items(context.cases(spark, d))


def ration_packs(spark, d):
    return planning.ration_packs(context.cases(spark, d))


def ration_totals(spark, d):
    return planning.ration_totals(context.cases(spark, d))


def ration_headline(spark, d):
    return planning.ration_headline(context.cases(spark, d))


def medical_supplies(spark, d):
    return planning.medical_supplies(context.cases(spark, d))


def medical_headline(spark, d):
    return planning.medical_headline(context.cases(spark, d))


def needs_headline(spark, d):
    return planning.needs_headline(context.cases(spark, d))


def family_costs(spark, d):
    return planning.family_costs(context.cases(spark, d))


def financial_totals(spark, d):
    return planning.financial_totals(context.cases(spark, d))


def budget_breakdown(spark, d):
    return planning.budget_breakdown(context.cases(spark, d))


def needs_report(spark, d):
    return planning.needs_report_table(context.cases(spark, d))


def rate_table(spark, d):
    return planning.rate_usage(context.cases(spark, d))


def needs_summary(spark, d):
    return planning.needs_summary(context.cases(spark, d))


# --- reports (A12-A28, O*, P11, X18, X19, F10-F11) -----------------------------


def overview_headline(spark, d):
    return reports.headline(context.cases(spark, d))


def top_cities(spark, d):
    return reports.top_by_count(context.cases(spark, d), "city", 10)


def signal_totals(spark, d):
    return reports.signal_totals(context.cases(spark, d))


def avg_size_by_tier(spark, d):
    return reports.avg_by_tier(context.cases(spark, d), "family_size")


def avg_score_by_city(spark, d):
    return reports.top_by_mean(context.cases(spark, d), "city", "priority_score", 10)


def needs_by_category(spark, d):
    return reports.needs_by_category(planning.aggregate_needs(context.cases(spark, d)))


def needs_by_urgency(spark, d):
    return reports.needs_by_urgency(planning.aggregate_needs(context.cases(spark, d)))


def filter_options(spark, d):
    return reports.filter_options(context.cases(spark, d))


def column_profile(spark, d):
    return reports.column_profile(context.cases(spark, d))


def caseload_stats(spark, d):
    return reports.stats(context.cases(spark, d), 5).drop("_top_map")


def stats_json(spark, d):
    return reports.stats_json(context.cases(spark, d), 5)


def display_list(spark, d):
    out = reports.display_list(reports.priority_order(context.cases(spark, d)))
    return out.withColumn("priority_score", F.col("priority_score").cast("bigint"))


def case_labels(spark, d):
    out = reports.case_labels(reports.priority_order(context.cases(spark, d)))
    return out.withColumn("priority_score", F.col("priority_score").cast("bigint"))


def signal_labels(spark, d):
    return reports.signal_labels(context.cases(spark, d))


def case_profile(spark, d):
    return reports.case_profile(context.cases(spark, d)).drop("field_pos")


def needs_display(spark, d):
    return reports.needs_display(planning.ordered_needs(planning.aggregate_needs(context.cases(spark, d))))


def headline_cards(spark, d):
    c = context.cases(spark, d)
    return reports.headline_cards(c, planning.financial_totals(c))


def fallback_stats(spark, d):
    return reports.fallback_stats(context.cases(spark, d))


def queue_headline(spark, d):
    return reports.queue_headline(search.by_options(context.cases(spark, d), tiers=["CRITICAL", "HIGH"]))


# --- search (F1, F8, F9, Q1-Q9) -------------------------------------------------

SEARCHES = {
    "search_homeless": {"col": "is_homeless", "op": "is_true"},
    "search_medical": {"col": "has_medical", "op": "is_true"},
    "search_widow_gt4": {"and": [{"col": "is_widow", "op": "is_true"}, {"col": "family_size", "op": "gt", "value": 4}]},
    "search_displaced_noincome": {"and": [{"col": "is_displaced", "op": "is_true"},
                                          {"col": "is_unemployed", "op": "is_true"}]},
    "search_critical": {"col": "priority_tier", "op": "eq", "value": "CRITICAL"},
    "search_ne_null": {"col": "family_size", "op": "ne", "value": 4},
}

ANALYSES = {
    "analyse_rations_region": ({"col": "governorate", "op": "icontains", "value": "asia"}, "rations"),
    "analyse_budget_homeless": ({"col": "is_homeless", "op": "is_true"}, "financial"),
    "analyse_blankets": ({"col": "is_displaced", "op": "is_true"}, "needs"),
    "analyse_count": ({"col": "is_homeless", "op": "is_true"}, "count"),
    "analyse_sum": ({"col": "priority_tier", "op": "eq", "value": "HIGH"}, "sum", "family_size"),
    "analyse_medical_region": ({"col": "governorate", "op": "icontains", "value": "america"}, "medical"),
}


def _search(spec: dict) -> Query:
    def run(spark, d):
        rows = reports.priority_order(search.where(context.cases(spark, d), spec))
        return reports.display_list(rows).withColumn("priority_score", F.col("priority_score").cast("bigint"))
    return run


def _analyse(spec: dict, measure: str, column: str | None = None) -> Query:
    def run(spark, d):
        out = search.analyse(context.cases(spark, d), spec, measure, column)
        if measure == "needs":
            out = out.where(F.col("need_item") == "Blankets & bedding")
        return out
    return run


def caseload_filter(spark, d):
    rows = search.by_options(context.cases(spark, d), tiers=["CRITICAL", "HIGH"])
    return rows.select("family_num", "family_id", "priority_tier", "city", "displacement_type")


def caseload_filter_lists(spark, d):
    rows = search.by_options(context.cases(spark, d), tiers=["HIGH", "MEDIUM"], cities=["FRANCE-1", "FRANCE-2", "CHINA-3", "INDIA-0"],
                             displacement=[S.DISPLACED_TYPES[0], S.HOST_COMMUNITY])
    return rows.select("family_num", "family_id", "priority_tier", "city", "displacement_type")


FILTER_CITIES = [f"{nation}{part}" for nation in ("FRANCE", "CHINA", "INDIA", "PERU", "KENYA") for part in ("", "-0", "-1", "-2", "-3")]


def caseload_filter_all_lists(spark, d):
    rows = search.by_options(context.cases(spark, d), tiers=["CRITICAL", "HIGH", "MEDIUM"], cities=FILTER_CITIES,
                             displacement=[*S.DISPLACED_TYPES[:2], S.HOST_COMMUNITY])
    return rows.select("family_num", "family_id", "priority_tier", "city", "displacement_type")


def case_profile_by_number(spark, d):
    return reports.case_profile(context.cases(spark, d), family_num=7).select("family_num", "field", "value")


def column_profile_analytics(spark, d):
    return reports.column_profile(context.cases(spark, d), analytics=True)


def needs_json(spark, d):
    return reports.json_records(planning.aggregate_needs(context.cases(spark, d)), ["need_item", "category", "urgency", "families_count"])


def filtered_counts(spark, d):
    return search.filtered_counts(context.cases(spark, d), tiers=["CRITICAL", "HIGH"])


# --- privacy (P1-P4) -------------------------------------------------------------


def anonymize_main(spark, d):
    return privacy.assert_no_pii(privacy.anonymize(adapters.raw_main(spark, d), "main"), "main")


def anonymize_members(spark, d):
    out = privacy.anonymize(adapters.raw_members(spark, d), "members")
    return privacy.assert_no_pii(out, "members").select(
        F.col(f"`{MemberCols.FAMILY_ID}`").alias("family_id"), F.col("_index").alias("member_key"),
        F.col(MemberCols.OCCUPATION).alias("occupation_bucket"), F.col(MemberCols.BIRTH_YEAR).alias("birth_year"))


def anonymize_damage(spark, d):
    out = privacy.assert_no_pii(privacy.anonymize(adapters.raw_damage(spark, d), "damage"), "damage")
    return out.select(*[F.col(f"`{c}`").alias(a) for c, a in (
        (DamageCols.FAMILY_ID, "family_id"), (DamageCols.CATEGORY, "category"), (DamageCols.QUANTITY, "quantity"))],
        F.lit(len(out.columns)).cast("bigint").alias("n_columns"))


def anonymize_needs(spark, d):
    out = privacy.assert_no_pii(privacy.anonymize(adapters.raw_needs(spark, d), "needs"), "needs")
    return out.select(*[F.col(f"`{c}`").alias(a) for c, a in (
        (NeedsCols.FAMILY_ID, "family_id"), (NeedsCols.PROGRAM, "program"), (NeedsCols.CLASSIFICATION, "classification"),
        (NeedsCols.QUANTITY, "quantity"), (NeedsCols.SERVICE_RECEIVED, "served"))],
        F.lit(len(out.columns)).cast("bigint").alias("n_columns"))


def birth_year_forms(spark, d):
    return adapters.date_texts(spark, d).withColumn("birth_year", scalars.birth_year(F.col("dob_text")))


def occupation_sentences(spark, d):
    return adapters.occupation_texts(spark, d).withColumn("occupation_bucket", scalars.occupation_bucket(F.col("occupation_text")))


def occupation_bucket(spark, d):
    m = adapters.raw_members(spark, d)
    text = F.col(f"`{MemberCols.OCCUPATION_TEXT}`")
    return m.select(F.col("_index").alias("member_key"), text.alias("occupation_text"),
                    scalars.occupation_bucket(text).alias("occupation_bucket"))


def birth_year(spark, d):
    m = adapters.raw_members(spark, d)
    text = F.col(f"`{MemberCols.DATE_OF_BIRTH}`")
    return m.select(F.col("_index").alias("member_key"), text.alias("dob_text"), scalars.birth_year(text).alias("birth_year"))


# --- intake (T1-T3, X15-X17) -------------------------------------------------------

INTAKE_OUT = ["family_num", "family_id", "source_file", "city", "governorate", "displacement_type", "housing_type",
              "family_size", "breadwinners", "need_type", "is_displaced", "is_homeless", "is_renting", "is_unemployed",
              "priority_score", "priority_tier"]


def intake_parse(spark, d):
    parsed = intake.parse_responses(adapters.intake_texts(spark, d, resent=True))
    return parsed.drop("response")


def need_array_parse(spark, d):
    return intake.parse_need_items(adapters.need_item_texts(spark, d)).withColumn(
        "item_pos", F.col("item_pos").cast("bigint"))


def intake_append(spark, d):
    existing = context.cases(spark, d)
    parsed = intake.parse_responses(adapters.intake_texts(spark, d, resent=True))
    new = context.scratch(intake.score_intake(intake.first_records(parsed)))
    out = intake.append(existing, new)
    return out.select(*INTAKE_OUT).withColumn("priority_score", F.col("priority_score").cast("bigint"))


def intake_stream(spark, d):
    """The table of the streaming intake over the responses."""
    out = spark.read.parquet(os.path.join(context.intake_stream(spark, d), "table"))
    return out.select(*INTAKE_OUT).withColumn("priority_score", F.col("priority_score").cast("bigint"))


def _after_intake(report) -> Query:
    """A report over caseload and streamed intake, from the parts that the stream stored."""
    def run(spark, d):
        return report(spark, parts_path(os.path.join(context.intake_stream(spark, d), "table")))
    return run


# -------------------------------------------------------------------------------------

QUERIES: dict[str, Query] = {
    "case_flags": case_flags,
    "member_counts": member_counts,
    "priority_scores": priority_scores,
    "family_numbering": family_numbering,
    "priority_list": priority_list,
    "top_critical": top_critical,
    "tier_distribution": tier_distribution,
    "need_type": need_type,
    "needs_programs": needs_programs,
    "damage_categories": damage_categories,
    "damage_semi": damage_semi,
    "unserved_families": unserved_families,
    "city_fallback": city_fallback,
    "aggregate_needs": aggregate_needs,
    "family_need_items": family_need_items,
    "ration_packs": ration_packs,
    "ration_totals": ration_totals,
    "ration_headline": ration_headline,
    "medical_supplies": medical_supplies,
    "medical_headline": medical_headline,
    "needs_headline": needs_headline,
    "family_costs": family_costs,
    "financial_totals": financial_totals,
    "budget_breakdown": budget_breakdown,
    "needs_report": needs_report,
    "rate_table": rate_table,
    "needs_summary": needs_summary,
    "overview_headline": overview_headline,
    "top_cities": top_cities,
    "signal_totals": signal_totals,
    "avg_size_by_tier": avg_size_by_tier,
    "avg_score_by_city": avg_score_by_city,
    "needs_by_category": needs_by_category,
    "needs_by_urgency": needs_by_urgency,
    "filter_options": filter_options,
    "column_profile": column_profile,
    "caseload_stats": caseload_stats,
    "stats_json": stats_json,
    "display_list": display_list,
    "case_labels": case_labels,
    "signal_labels": signal_labels,
    "case_profile": case_profile,
    "needs_display": needs_display,
    "headline_cards": headline_cards,
    "fallback_stats": fallback_stats,
    "queue_headline": queue_headline,
    "caseload_filter": caseload_filter,
    "caseload_filter_lists": caseload_filter_lists,
    "caseload_filter_all_lists": caseload_filter_all_lists,
    "case_profile_by_number": case_profile_by_number,
    "column_profile_analytics": column_profile_analytics,
    "needs_json": needs_json,
    "filtered_counts": filtered_counts,
    **{k: _search(v) for k, v in SEARCHES.items()},
    **{k: _analyse(*v) for k, v in ANALYSES.items()},
    "anonymize_main": anonymize_main,
    "anonymize_members": anonymize_members,
    "anonymize_damage": anonymize_damage,
    "anonymize_needs": anonymize_needs,
    "birth_year_forms": birth_year_forms,
    "occupation_sentences": occupation_sentences,
    "occupation_bucket": occupation_bucket,
    "birth_year": birth_year,
    "intake_parse": intake_parse,
    "need_array_parse": need_array_parse,
    "intake_append": intake_append,
    "intake_stream": intake_stream,
    "report_after_intake": _after_intake(partials.needs_report),
    "headline_after_intake": _after_intake(partials.headline),
    "signals_after_intake": _after_intake(partials.signal_totals),
    "top_cities_after_intake": _after_intake(partials.top_cities),
    "mean_scores_after_intake": _after_intake(partials.mean_scores),
}
