"""Operator 10 against grouping in Python."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from caseload.llm import exact_dedup


def brute(rows):
    groups = {}
    for i, t in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        groups.setdefault(norm, []).append((-len(t or ""), i))
    out = {}
    for norm, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            out[i] = (keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest())
    return out


def result(frame):
    return {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in frame.collect()}


CASES = [(1, "a b"), (2, "ab"), (3, "a\tb "), (4, None), (5, ""), (6, " \n\x0b"), (7, "é" * 3), (8, "é éé"), (9, "x" * 100_000),
         (10, "x" * 100_000), (11, "a b"), (12, "A B"), *((100 + i, "same text") for i in range(300)), *((500 + i, f"only {i}") for i in range(300))]


def test_groups(docs_of):
    assert result(exact_dedup.exact_dedup(docs_of(CASES))) == brute(CASES)


def test_several_filter_ranges(docs_of):
    assert result(exact_dedup.exact_dedup(docs_of(CASES), max_bits=4096)) == brute(CASES)


def test_a_full_filter_is_exact_and_keeps_the_plan(docs_of):
    full = exact_dedup.exact_dedup(docs_of(CASES), max_bits=64)
    assert result(full) == brute(CASES)
    shape = lambda frame: [line.strip(" :+-").split("(")[0].split(" ")[0] for line in frame._jdf.queryExecution().analyzed().toString().splitlines()]
    assert shape(full) == shape(exact_dedup.exact_dedup(docs_of(CASES)))


def test_first_pass_moves_one_number_a_row(docs_of):
    thin = docs_of(CASES).selectExpr("doc_id AS id", "unhex(sha2(text, 256)) AS sha")
    plan = exact_dedup.repeated_slots(thin, 1 << 18)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # cells, then repeated cells; no bitmaps


def test_unrepeated_rows_pass_straight_through(spark, docs_of):
    from pyspark.sql import functions as F

    thin = docs_of(CASES).select(F.col("doc_id").alias("id"), F.unhex(F.sha2(exact_dedup.normalised(F.col("text")), 256)).alias("sha"), F.lit(0).alias("range"))
    bits = 1 << 18
    probed = exact_dedup.probe(thin, exact_dedup.repeated_slots(thin, bits), bits).select("id", "maybe").collect()
    repeated = {i for i, (_, n, _, _) in brute(CASES).items() if n > 1}
    maybe = {r.id for r in probed if r.maybe}
    assert repeated <= maybe and len(maybe) <= len(repeated) + 3


def test_empty_table_null_and_repeated_ids(docs_of):
    assert exact_dedup.exact_dedup(docs_of([])).count() == 0
    rows = exact_dedup.exact_dedup(docs_of([(None, "a"), (2, "a"), (2, "a"), (None, "b")])).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in rows if r.group_size > 1) == [(0, 2, 3, False), (2, 2, 3, False), (2, 2, 3, True)]
    assert [(r.doc_id, r.keep_id, r.kept) for r in rows if r.group_size == 1] == [(None, None, True)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\n", max_size=4), min_size=1, max_size=30))
def test_any_texts(spark, texts):
    rows = list(enumerate(texts))
    assert result(exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
