"""Operator 7 against a plain search over line runs."""

import random

import pytest
from pyspark.sql import functions as F

from caseload.llm import line_dedup


def brute(rows, least=10):
    seqs = {}
    for i, text in rows:
        if i is not None and text is not None:
            lines = [(n, x.strip(" \t\n\x0b\x0c\r")) for n, x in enumerate(text.split("\n"))]
            seqs[i] = [(n, x) for n, x in lines if x]
    first = {}
    for i in sorted(seqs):
        lines = [x for _, x in seqs[i]]
        for a in range(len(lines)):
            for n in range(1, min(least, len(lines) - a) + 1):
                first.setdefault(tuple(lines[a:a + n]), (i, a))
    out = {}
    for i, text in rows:
        gone = set()
        lines = [x for _, x in seqs.get(i, [])]
        for a in range(len(lines)):
            for n in range(1, min(least, len(lines) - a) + 1):
                run = tuple(lines[a:a + n])
                if sum(len(x.split()) for x in run) >= least and first[run] < (i, a):
                    gone |= {seqs[i][k][0] for k in range(a, a + n)}
        kept = None if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone)
        out[i] = (kept, len(gone))
    return out


def result(frame):
    return {r.doc_id: (r.text, r._removed) for r in frame.collect()}


def cases():
    rng = random.Random(4)
    pool = [" ".join(f"w{rng.randrange(50)}" for _ in range(n)) for n in (1, 1, 2, 3, 4, 5, 8, 12, 20, 60)]
    rows = []
    for i in range(60):
        lines = [rng.choice(pool) if rng.random() < 0.7 else f"line {i} {j}" for j in range(rng.randrange(0, 25))]
        rows.append((i, "\n".join(x + rng.choice(["", " ", "\r"]) for x in lines)))
    long = [f"unique line number {j} of a long passage that comes back later" for j in range(30)]
    rows += [(100, "\n".join(long)), (101, "head\n" + "\n".join(long) + "\n\ntail"), (102, "\n".join(long[3:9] + ["x"] + long[9:20])),
             (103, None), (104, ""), (105, "\n\n \n"), (106, "z " * 50_000), (107, "z " * 50_000), (108, "a\nb\nc\n" * 30), (109, "é ü " * 9)]
    return rows


@pytest.mark.parametrize("most", [1 << 22, 0])
def test_runs(docs_of, monkeypatch, most):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", most)
    rows = cases()
    out = line_dedup.drop_repeated_lines(docs_of(rows))
    assert {"kept", "id", "lang"} <= set(out.columns)
    got = result(out)
    assert got == brute(rows)
    assert sum(n for _, n in got.values()) > 100


def test_empty_table_missing_and_repeated_ids(docs_of):
    text = "one two three four five six seven eight nine ten eleven"
    assert line_dedup.drop_repeated_lines(docs_of([])).count() == 0
    rows = line_dedup.drop_repeated_lines(docs_of([(None, text), (None, text), (1, text), (1, text), (2, text)])).collect()
    assert sorted((r.doc_id or 0, r._removed) for r in rows) == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 1)]


def test_plan_is_native(docs_of):
    plan = line_dedup.drop_repeated_lines(docs_of(cases()[:5]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_many_deleted_lines(spark):
    text = "\n".join(f"this is line {i} with enough words to count as ten" for i in range(20_000))
    docs = spark.createDataFrame([(1, text), (2, text + "\nlast")], "doc_id long, text string")
    rows = {r.doc_id: r for r in line_dedup.drop_repeated_lines(docs).withColumn("n", F.length("text")).collect()}
    assert rows[2].text == "last" and rows[2]._removed == 20_000 and rows[1].n == len(text)
