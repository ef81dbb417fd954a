"""Operator 11 against slices of the units, and the exact round trip."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caseload.llm import fill_middle

from .conftest import SF

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    digest = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in range(0, 32, 8))
    units = UNITS.findall(text)
    assert "".join(units) == text
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, c = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if h4 % 100 < spm:
        return n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


def test_table(spark):
    texts = dict(tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    rows = fill_middle.op11_fill_middle(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        n, form, prefix, middle, output = expected(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (
            n, form, prefix, middle, sha(output), sha(texts[r.doc_id] or ""))
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_edge_cases_and_clashing_columns(spark, docs_of):
    rng = random.Random(2)
    texts = [None, "", " ", "\n\t ", "a", " a", "a ", "é漢🙂 ü x", "x" * 300_000, "ab " * 100_000, "<P> in text", "a <M> b",
             "<S>", "<P", "P>", "<", "a <", "< a", "<P <S <M", " em space"]
    rows = [(k, rng.choice(texts)) for k in range(300)] + [(None, "one two three"), (7, "one two three"), (7, "one two three")]
    docs = docs_of(rows)
    for name in ("n", "form", "output", "restored", "prefix_chars"):  # the operator's own names as extra columns
        docs = docs.withColumn(name, docs.kept)
    out = fill_middle.restored(fill_middle.fill_in_middle(docs, rate=100))
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in out.collect()), key=repr)
    assert got == sorted(((i, *expected(i, t, rate=100), t or "") for i, t in rows), key=repr)
    assert fill_middle.fill_in_middle(docs_of([])).collect() == []


@settings(deadline=None, max_examples=300)
@given(st.text(alphabet="ab <>PSM\n\té漢🙂", max_size=40), st.data(), st.sampled_from(["psm", "spm"]), st.sampled_from([1, 3, 1 << 16]))
def test_rotations_are_inverted(text, data, form, block):
    raw = text.encode()
    cuts = sorted(data.draw(st.integers(0, len(raw))) for _ in range(2))
    kept, fill_middle.BLOCK = fill_middle.BLOCK, block
    try:
        if not any(s in raw for s in fill_middle.SENTINELS):
            out = fill_middle.rearrange(raw, *cuts, form)
            assert len(out) == len(raw) + 9
            assert fill_middle.restore(bytes(out), form) == raw
    finally:
        fill_middle.BLOCK = kept


@pytest.mark.parametrize("sizes", [(0, 0), (0, 5), (5, 0), (3, 4), (70_000, 200_001), (200_001, 3)])
def test_rotate_exchanges_blocks(sizes):
    buffer = np.random.default_rng(1).integers(0, 256, 10 + sum(sizes)).astype(np.uint8)
    before = buffer.copy()
    fill_middle.rotate(buffer, 5, 5 + sizes[0], 5 + sum(sizes))
    a, b = before[5:5 + sizes[0]], before[5 + sizes[0]:5 + sum(sizes)]
    assert np.array_equal(buffer, np.concatenate([before[:5], b, a, before[5 + sum(sizes):]]))
