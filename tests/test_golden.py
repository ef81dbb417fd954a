"""Six-family golden fixture: expected flags, scores, needs and budgets (FIXTURES.md §4.2-4.3)."""

from __future__ import annotations

import pytest

from caseload import schema as S
from caseload.operators import planning, reports, search
from conftest import EDU, FIN, FOOD, MED

SIGNALS = list(S.SIGNALS)

EXPECTED = {
    # id: (city, true signals, chronic, disabled, dropout, members, need_type, score, tier, packs, monthly)
    1: ("S1", {"is_widow", "is_displaced", "is_homeless", "is_unemployed", "has_medical", "is_pregnant", "has_damage"},
        1, None, 1, 2, f"{MED}, {FOOD}", 165, "CRITICAL", 2, 450),
    2: ("S1", set(), None, None, None, None, "", 5, "LOW", 1, 90),
    3: ("D2", {"is_renting", "is_unemployed", "service_received"}, None, None, None, 1, FIN, 35, "MEDIUM", 1, 240),
    4: ("S4", {"is_orphan_family", "is_displaced", "has_disability"}, None, 1, 2, 3, f"{FOOD}, {EDU}", 75, "HIGH", 2, 165),
    5: ("G2", {"is_widow"}, None, None, None, 1, "", 30, "MEDIUM", 1, 90),
    6: ("S4", {"is_displaced", "has_medical", "is_pregnant", "has_damage"}, None, None, None, 1, "", 60, "HIGH", 1, 145),
}


@pytest.fixture(scope="module")
def rows(golden_cases):
    return {r["family_id"]: r for r in golden_cases.collect()}


@pytest.mark.parametrize("fid", sorted(EXPECTED))
def test_case_row(rows, fid):
    city, signals, ch, dc, dr, members, need_type, score, tier, _, _ = EXPECTED[fid]
    r = rows[fid]
    assert r["city"] == city
    assert {s for s in SIGNALS if r[s]} == signals
    assert (r["chronic_disease_members"], r["disability_members"], r["school_dropout_children"], r["member_count"]) == (
        ch, dc, dr, members)
    assert r["need_type"] == need_type
    assert (r["priority_score"], r["priority_tier"]) == (score, tier)
    assert r["family_num"] == fid  # numbered in family-id order


def test_row_count_and_numbering(golden_cases):
    assert golden_cases.count() == 6
    assert sorted(r[0] for r in golden_cases.select("family_num").collect()) == [1, 2, 3, 4, 5, 6]


def test_program_lists(rows):
    assert rows[6]["needs_programs"] == []  # need rows, all programs null
    assert rows[2]["needs_programs"] is None  # no need rows
    assert rows[1]["needs_programs"] == sorted([MED, FOOD, S.PROGRAM_LEGAL])
    assert rows[1]["damage_categories"] == sorted(S.DAMAGE_CATEGORIES[:2])


def test_packs_and_costs(golden_cases):
    packs = {r["family_id"]: r["ration_packs"] for r in planning.ration_packs(golden_cases).collect()}
    costs = {r["family_id"]: r["monthly_total_usd"] for r in planning.family_costs(golden_cases).collect()}
    for fid, exp in EXPECTED.items():
        assert packs[fid] == exp[9]
        assert costs[fid] == exp[10]


EXPECTED_NEEDS = [
    ("Blankets & bedding", "shelter", "critical", 3, 50.0),
    ("Medication & treatment support", "medical", "critical", 2, 33.3),
    ("Prenatal care & supplies", "medical", "critical", 2, 33.3),
    ("Emergency shelter referral", "shelter", "critical", 1, 16.7),
    ("Monthly food basket", "food", "high", 6, 100.0),
    ("Household essentials kit", "other", "high", 3, 50.0),
    ("Women's hygiene kit", "hygiene", "high", 3, 50.0),
    ("Livelihood / income support", "financial", "high", 2, 33.3),
    ("Disability aid & rehab", "medical", "high", 1, 16.7),
    ("Rental financial assistance", "financial", "high", 1, 16.7),
    ("Psychosocial support", "psychosocial", "medium", 2, 33.3),
    ("School supplies for orphans", "education", "medium", 1, 16.7),
]


def test_aggregate_needs(golden_cases):
    got = [tuple(r[c] for c in ("need_item", "category", "urgency", "families_count", "pct_of_total"))
           for r in planning.ordered_needs(planning.aggregate_needs(golden_cases)).collect()]
    assert got == EXPECTED_NEEDS
    head = planning.needs_headline(golden_cases).first()
    assert head["total_instances"] == 27 and head["item_types"] == 12
    urg = {r["urgency"]: r["families"] for r in reports.needs_by_urgency(planning.aggregate_needs(golden_cases)).collect()}
    assert urg == {"critical": 8, "high": 16, "medium": 3}


def test_rations(golden_cases):
    got = {r["item"]: r["total_needed"] for r in planning.ration_totals(golden_cases).collect()}
    assert got == {"Rice": 13.2, "Bulgur": 6.6, "Pasta": 6.6, "Lentils": 6.6, "Tomato paste": 3.3,
                   "Sunflower oil": 6.6, "Canned tuna": 13.2, "Sugar": 6.6, "Tea": 6.6, "Salt": 3.3}
    head = planning.ration_headline(golden_cases).first()
    assert (head["total_packs"], head["total_people"], head["basket_items"]) == (8, 26, 10)


def test_medical(golden_cases):
    got = [(r["item"], r["families"], r["total_qty"])
           for r in planning.medical_supplies(golden_cases).orderBy("item_pos").collect()]
    assert got == [("Paracetamol 500mg", 2, 4), ("Ibuprofen 400mg", 2, 2), ("Bandage roll", 2, 4),
                   ("Antiseptic solution", 2, 2), ("Disposable gloves", 2, 2), ("Prenatal vitamins", 2, 2),
                   ("Iron & folic acid tabs", 2, 2), ("Sterile delivery kit", 2, 2), ("Wound dressing kit", 1, 1),
                   ("Pressure-relief cushion", 1, 1), ("Mobility aid voucher", 1, 1)]


def test_financial(golden_cases):
    got = {r["category"]: r["total_usd"] for r in planning.financial_totals(golden_cases).collect()}
    assert got == {"Food": 390, "Utilities": 180, "Rent": 150, "Medical": 200, "Disability": 60,
                   "Emergency Shelter": 200, "Grand Total": 1180}
    per_family = sum(r[0] for r in planning.family_costs(golden_cases).select("monthly_total_usd").collect())
    assert per_family == got["Grand Total"]


def test_fused_report_matches_parts(golden_cases):
    rep = planning.needs_report(golden_cases)
    assert [r["need_item"] for r in rep["aggregate_needs"].collect()] == [x[0] for x in EXPECTED_NEEDS]
    assert rep["financial_totals"].orderBy("line_pos").collect()[-1]["total_usd"] == 1180
    assert [r["total_qty"] for r in rep["medical_supplies"].orderBy("item_pos").collect()][:3] == [4, 2, 4]
    assert rep["ration_totals"].where("item = 'Rice'").first()["total_needed"] == 13.2


def test_tiers_and_means(golden_cases):
    tiers = {r["priority_tier"]: r["families"] for r in reports.tier_distribution(golden_cases).collect()}
    assert tiers == {"CRITICAL": 1, "HIGH": 2, "MEDIUM": 2, "LOW": 1}
    means = {r["priority_tier"]: r["avg_value"] for r in reports.avg_by_tier(golden_cases).collect()}
    assert means == {"CRITICAL": 8.0, "HIGH": 2.5, "MEDIUM": 4.4, "LOW": 4.0}


def test_cities(golden_cases):
    by_count = [(r["city"], r["families"]) for r in reports.top_by_count(golden_cases, "city", 10).collect()]
    assert by_count == [("S1", 2), ("S4", 2), ("D2", 1), ("G2", 1)]
    by_mean = [(r["city"], r["avg_value"]) for r in reports.top_by_mean(golden_cases, "city", "priority_score").collect()]
    assert by_mean == [("S1", 85.0), ("S4", 67.5), ("D2", 35.0), ("G2", 30.0)]


def test_option_filter_drops_null_displacement(golden_cases):
    assert search.by_options(golden_cases).count() == 5
    counts = search.filtered_counts(golden_cases).first()
    assert (counts["shown"], counts["total"]) == (5, 6)


def test_labels_and_profile(golden_cases):
    labels = {r["family_num"]: r["label"] for r in reports.case_labels(golden_cases).collect()}
    assert labels[1] == "Family #001  ·  S1  ·  CRITICAL  (score 165)"
    sig = {r["family_id"]: r["signal_labels"] for r in reports.signal_labels(golden_cases).collect()}
    assert sig[5] == "Widow" and sig[2] == ""
    prof = {r["field"]: r["value"] for r in reports.case_profile(golden_cases).collect()}
    assert prof["family_size"] == "8.0" and prof["need_type"] == f"{MED}, {FOOD}"
    assert "family_id" not in prof and "is_widow" not in prof and "has_medical" not in prof
    disp = reports.display_list(golden_cases.where("family_id = 1")).first()
    assert disp["is_widow"] == "✓" and disp["is_orphan_family"] == ""


def test_search_specs(golden_cases):
    spec = {"and": [{"col": "is_widow", "op": "is_true"}, {"col": "family_size", "op": "gt", "value": 4}]}
    assert sorted(r[0] for r in search.where(golden_cases, spec).select("family_id").collect()) == [1, 5]
    neg = {"not": {"col": "family_size", "op": "gt", "value": 4}}  # null size reads as false, so NOT gives true
    assert sorted(r[0] for r in search.where(golden_cases, neg).select("family_id").collect()) == [2, 3, 6]
    with pytest.raises(ValueError):
        search.where(golden_cases, {"col": "no_such_column", "op": "eq", "value": 1})
    blankets = search.analyse(golden_cases, {"col": "is_displaced", "op": "is_true"}, "needs")
    assert {r["need_item"]: r["families_count"] for r in blankets.collect()}["Blankets & bedding"] == 3


@pytest.mark.parametrize("spec,expected", [
    ({"col": "city", "op": "eq", "value": "S4"}, [4, 6]),
    ({"col": "city", "op": "ne", "value": "S1"}, [3, 4, 5, 6]),
    ({"col": "family_size", "op": "lt", "value": 4.4}, [2, 6]),
    ({"col": "family_size", "op": "le", "value": 4.4}, [2, 5, 6]),
    ({"col": "family_size", "op": "ge", "value": 5}, [1, 4]),
    ({"col": "priority_tier", "op": "in", "value": ["HIGH", "LOW"]}, [2, 4, 6]),
    ({"col": "governorate", "op": "contains", "value": "2"}, [4, 5, 6]),
    ({"col": "governorate", "op": "icontains", "value": "g1"}, [1, 2, 3]),
    ({"col": "displacement_type", "op": "is_null"}, [3]),
    ({"or": [{"col": "is_homeless", "op": "is_true"}, {"col": "is_renting", "op": "is_true"}]}, [1, 3]),
    ({"not": {"col": "city", "op": "eq", "value": "S1"}}, [3, 4, 5, 6]),
    ({"and": []}, [1, 2, 3, 4, 5, 6]),
])
def test_predicate_ops(golden_cases, spec, expected):
    got = sorted(r[0] for r in search.where(golden_cases, spec).select("family_id").collect())
    assert got == expected


def test_analyse_measures(golden_cases):
    assert search.analyse(golden_cases, None, "count").first()["families"] == 6
    assert search.analyse(golden_cases, {"col": "city", "op": "eq", "value": "S1"}, "sum", "family_size").first()[0] == 12.0
    rations = search.analyse(golden_cases, None, "rations").first()
    assert (rations["families"], rations["total_packs"], rations["total_people"]) == (6, 8, 26)
    with pytest.raises(ValueError):
        search.analyse(golden_cases, None, "no_such_measure")


def test_empty_caseload(spark):
    """No families gives typed empty / zero results, not errors."""
    from caseload.operators.cases import build_cases
    from caseload.operators.scoring import number_cases, score
    from conftest import make_tables
    empty = number_cases(score(build_cases(make_tables(spark, [], [], [], []))))
    assert empty.count() == 0
    assert planning.aggregate_needs(empty).count() == 0
    assert planning.medical_supplies(empty).count() == 0
    assert {r["total_needed"] for r in planning.ration_totals(empty).collect()} == {0.0}
    assert {r["total_usd"] for r in planning.financial_totals(empty).collect()} == {0}
    head = reports.headline(empty).first()
    assert (head["families"], head["individuals"], head["critical"]) == (0, 0, 0)
    assert [r["families"] for r in reports.tier_distribution(empty).collect()] == [0, 0, 0, 0]
    assert reports.stats(empty).first()["top_cities"] == ""
    assert planning.needs_report_table(empty).where("section = 'budget'").count() == 7


def test_planned_api_names(golden_tables, golden_cases):
    from caseload.operators import cases
    top = {r["family_id"]: r["need_type"] for r in cases.top_programs(golden_tables.needs).collect()}
    assert top[1].startswith(MED) and top[6] == ""
    lst = {r["family_id"]: r["cats"] for r in cases.distinct_list(
        golden_tables.damage, S.DamageCols.FAMILY_ID, S.DamageCols.CATEGORY, "cats").collect()}
    assert lst[1] == sorted(S.DAMAGE_CATEGORIES[:2]) and lst[6] == [S.DAMAGE_CATEGORIES[0]]
    spine = {r["priority_tier"]: r["avg_value"] for r in
             reports.avg_by(golden_cases, "priority_tier", "family_size", spine=S.TIER_ORDER).collect()}
    assert spine == {"CRITICAL": 8.0, "HIGH": 2.5, "MEDIUM": 4.4, "LOW": 4.0}
    assert [r["city"] for r in reports.top_cities(golden_cases, 2).collect()] == ["S1", "S4"]


def test_custom_rule_tables(golden_tables, golden_cases):
    from caseload.operators.cases import build_cases
    from caseload.operators.scoring import score
    weights = [(sig, 35 if sig == "is_widow" else w) for sig, w in S.WEIGHTS]
    rescored = {r["family_id"]: r["priority_score"] for r in score(build_cases(golden_tables), weights=weights).collect()}
    assert rescored[5] == 30 + 10 and rescored[2] == 5  # widow weight 25 → 35; no-signal family unchanged
    rates = [(name, 20 if name == "Food (per person)" else v) for name, v in S.FINANCIAL_RATES]
    food = planning.financial_totals(golden_cases, rates=rates).where("category = 'Food'").first()["total_usd"]
    assert food == 26 * 20
    rules = S.NEED_RULES + (("is_renting", "Winter clothing", "clothing", "high"),)
    got = {r["need_item"]: r["families_count"] for r in planning.aggregate_needs(golden_cases, rules=rules).collect()}
    assert got["Winter clothing"] == 1 and got["Monthly food basket"] == 6


def test_rows_without_a_key_are_numbered_last(spark):
    from caseload.operators.scoring import number_cases
    df = spark.createDataFrame([(5,), (None,), (2,), (None,), (9,)], "family_id bigint")
    got = sorted((r["family_num"], r["family_id"]) for r in number_cases(df, num_partitions=2).collect())
    assert [fid for _, fid in got] == [2, 5, 9, None, None]
