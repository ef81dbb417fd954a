"""Occupation buckets (P3) against a direct Python model of the first-match substring rule."""

from __future__ import annotations

from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st

from caseload import schema as S
from caseload.functions.scalars import occupation_bucket
from pyspark.sql import functions as F

WORDS = [w for _, ws in S.OCCUPATION_BUCKETS for w in ws]
piece = st.one_of(st.sampled_from(WORDS), st.sampled_from([" ", "  ", "\t", "Driver", "TEACHER", "سائق", "ة", "-", ""]))
text = st.one_of(st.none(), st.lists(piece, max_size=4).map("".join))


def model(occ):
    if occ is None:
        return S.UNKNOWN_BUCKET
    occ = str(occ).strip().lower()
    if not occ:
        return S.UNKNOWN_BUCKET
    for bucket, keywords in S.OCCUPATION_BUCKETS:
        if any(k.lower() in occ for k in keywords):
            return bucket
    return S.OTHER_BUCKET


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck),
          phases=[Phase.explicit, Phase.reuse, Phase.generate])
@given(st.lists(text, min_size=1, max_size=80))
def test_bucket_matches_model(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, occ string")
    got = {r["i"]: r["b"] for r in df.select("i", occupation_bucket(F.col("occ")).alias("b")).collect()}
    assert [got[i] for i in range(len(texts))] == [model(t) for t in texts]
