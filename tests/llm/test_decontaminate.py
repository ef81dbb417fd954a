"""Operator 9 against sets in Python."""

import random

import pytest

from caseload.llm import common, decontaminate

from .conftest import SF


def shingles(text):
    words = (text or "").lower().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def brute(docs, items):
    out = {}
    sets = {i: shingles(t) for i, t in items}
    for d, text in docs:
        own = shingles(text)
        for i, s in sets.items():
            both = len(s & own)
            if s and 100 * both >= 75 * len(s):
                out[d, i] = (len(s), both, both / len(s))
    return out


def result(frame):
    return {(r.doc_id, r.item_id): (r.n_item, r.n_shared, r.containment) for r in frame.collect()}


def test_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert result(decontaminate.op9_decontamination(spark, SF)) == brute(docs, items)


@pytest.mark.parametrize("small", [1 << 20, 0])
def test_partial_items_in_long_documents(spark, docs_of, monkeypatch, small):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", small)
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(3, 60)))) for i in range(40)] + [(90, None), (91, " "), (92, "one two")]
    docs = []
    for d in range(60):
        words = [word() for _ in range(rng.randrange(0, 3000))]
        text = (items[rng.randrange(40)][1]).split()
        for _ in range(rng.randrange(0, 6)):
            text[rng.randrange(len(text))] = "changed"
        docs.append((d, " ".join(words[:50] + text + words[50:]).upper()))
    docs += [(70, None), (71, ""), (72, "One  TWO"), (73, " ".join(t for _, t in items[:40]))]
    frame = spark.createDataFrame(items + items[:2], "item_id long, text string")
    expected = brute(docs, items)
    assert len(expected) > 60
    assert result(decontaminate.contaminated(docs_of(docs), frame)) == expected
    kept = {r.doc_id for r in decontaminate.drop_contaminated(docs_of(docs), frame).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in expected}


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.contaminated(docs_of([(1, "a b c d e f")]), none).count() == 0
    assert decontaminate.contaminated(docs_of([]), one).count() == 0
    assert decontaminate.contaminated(docs_of([(None, "a b c d e f")]), one).count() == 0


def test_without_keeps_rows_without_id(docs_of, spark):
    ids = spark.createDataFrame([(1,), (None,)], "x long")
    assert sorted(str(r.doc_id) for r in common.without(docs_of([(None, "a"), (1, "b"), (2, "c")]), ids, "doc_id").collect()) == ["2", "None"]
