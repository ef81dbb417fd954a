"""The expected totals of FIXTURES.md §2 (computed independently of this code) at sf0.001, sf0.01 and sf0.1."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from caseload.operators import intake, planning, reports
from caseload.plans import catalog, context
from caseload.sources import adapters

EXPECTED = {
    "0.001": {"families": 150, "members": 1500, "needs": 4785, "damage": 1215,
              "tiers": (42, 54, 42, 12), "is_widow": 25, "is_orphan_family": 10, "is_displaced": 104,
              "is_homeless": 30, "is_renting": 30, "is_unemployed": 64, "has_medical": 63, "has_disability": 38,
              "is_pregnant": 15, "has_damage": 39, "service_received": 46, "score": 9125, "packs": 209,
              "clipped": 606, "monthly": 32670},
    "0.01": {"families": 1500, "members": 15000, "needs": 47937, "damage": 12063,
             "tiers": (415, 536, 397, 152), "is_widow": 275, "is_orphan_family": 156, "is_displaced": 913,
             "is_homeless": 300, "is_renting": 300, "is_unemployed": 633, "has_medical": 636, "has_disability": 358,
             "is_pregnant": 154, "has_damage": 392, "service_received": 460, "score": 90890, "packs": 2105,
             "clipped": 6148, "monthly": 327300},
    "0.1": {"families": 15000, "members": 150000, "needs": 480599, "damage": 119401,
            "tiers": (4195, 5277, 3944, 1584), "is_widow": 2830, "is_orphan_family": 1541, "is_displaced": 8920,
            "is_homeless": 3000, "is_renting": 3000, "is_unemployed": 6311, "has_medical": 6300, "has_disability": 3652,
            "is_pregnant": 1537, "has_damage": 3922, "service_received": 4604, "score": 905565, "packs": 21059,
            "clipped": 61506, "monthly": 3271710},
}
SIGNALS = ["is_widow", "is_orphan_family", "is_displaced", "is_homeless", "is_renting", "is_unemployed",
           "has_medical", "has_disability", "is_pregnant", "has_damage", "service_received"]


@pytest.mark.parametrize("sf", sorted(EXPECTED))
def test_totals(spark, sf):
    d, exp = f"/root/testdata/sf{sf}", EXPECTED[sf]
    t = adapters.case_tables(spark, d)
    assert (t.main.count(), t.members.count(), t.needs.count(), t.damage.count()) == (
        exp["families"], exp["members"], exp["needs"], exp["damage"])
    c = context.cases(spark, d)
    row = c.agg(*[F.count_if(s).alias(s) for s in SIGNALS], F.sum("priority_score").alias("score")).first()
    assert {s: row[s] for s in SIGNALS} == {s: exp[s] for s in SIGNALS}
    assert row["score"] == exp["score"]
    tiers = {r["priority_tier"]: r["families"] for r in reports.tier_distribution(c).collect()}
    assert tuple(tiers[k] for k in ("CRITICAL", "HIGH", "MEDIUM", "LOW")) == exp["tiers"]
    packs = planning.ration_packs(c).agg(F.sum("ration_packs"), F.sum("family_size")).first()
    assert tuple(packs) == (exp["packs"], exp["clipped"])
    grand = planning.financial_totals(c).where("category = 'Grand Total'").first()["total_usd"]
    assert grand == exp["monthly"]


def test_sf001_extras(spark):
    d = "/root/testdata/sf0.01"
    c = context.cases(spark, d)
    r = c.agg(F.count_if(F.col("is_widow") | F.col("is_orphan_family")).alias("wo"),
              F.count_if(F.col("is_displaced") | F.col("is_homeless")).alias("dh"),
              F.min("priority_score").alias("lo"), F.max("priority_score").alias("hi"),
              F.count_distinct("city").alias("cities"), F.count_if(F.col("need_type") == "").alias("empty")).first()
    assert (r["wo"], r["dh"], r["lo"], r["hi"], r["cities"], r["empty"]) == (382, 1041, 0, 165, 125, 116)
    means = {x["priority_tier"]: x["avg_value"] for x in reports.avg_by_tier(c).collect()}
    assert means == {"CRITICAL": 4.044386422976501, "HIGH": 4.225806451612903,
                     "MEDIUM": 3.893854748603352, "LOW": 3.253968253968254}
    occ = catalog.QUERIES["occupation_bucket"](spark, d).groupBy("occupation_text").count()
    assert {x["count"] for x in occ.collect()} == {1250}
    assert catalog.QUERIES["birth_year"](spark, d).where(F.col("birth_year").isNotNull()).count() == 10_000
    parsed = intake.parse_responses(adapters.intake_texts(spark, d)).agg(F.count_if("parse_ok"), F.sum("family_size"))
    assert tuple(parsed.first()) == (7644, 34104)
