"""Strict JSON extraction (X15, D17) against a brute-force Python model on random response texts."""

from __future__ import annotations

import json
import re

from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st

from caseload.operators import intake

FIELDS = ["family_size", "city", "breadwinners"]
value = st.one_of(st.none(), st.integers(-5, 50), st.sampled_from(["", "3", "4.7", "x", "C1", "نعم"]))
record = st.dictionaries(st.sampled_from(FIELDS + ["other"]), value, max_size=4)
junk = st.sampled_from(["", "note: ", "x ", " end", "} ", " {", "[1]", "{bad", "'", "{'a': 1}"])


@st.composite
def response(draw):
    parts = [draw(junk)]
    for _ in range(draw(st.integers(0, 2))):
        parts.append(json.dumps(draw(record), ensure_ascii=draw(st.booleans())))
        parts.append(draw(junk))
    return "".join(parts)


def model(text: str):
    """The reference's rule: greedy first-{ to last-} span, json.loads, must be an object."""
    m = re.search(r"\{[\s\S]*\}", text)
    if not m:
        return None
    try:
        obj = json.loads(m.group())
    except json.JSONDecodeError:
        return None
    return obj if isinstance(obj, dict) else None


def as_int(v):
    if v is None:
        return None
    try:
        f = float(str(v).strip())
    except ValueError:
        return None
    return None if f != f else int(f)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck),
          phases=[Phase.explicit, Phase.reuse, Phase.generate])
@given(st.lists(response(), min_size=1, max_size=60))
def test_parse_matches_python_json(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "intake_id int, response string")
    got = {r["intake_id"]: r for r in intake.parse_responses(df).collect()}
    for i, text in enumerate(texts):
        expect = model(text)
        r = got[i]
        assert r["parse_ok"] == (expect is not None), text
        if expect is None:
            continue
        city = expect.get("city")
        assert r["city"] == (None if city is None else (city if isinstance(city, str) else json.dumps(city))), text
        assert r["family_size"] == as_int(expect.get("family_size")), text
        assert r["breadwinners"] == as_int(expect.get("breadwinners")), text
