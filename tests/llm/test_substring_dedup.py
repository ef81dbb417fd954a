"""Operator 1: the transform against a plain suffix sort, the query against a plain search."""

import hashlib
import random

import numpy as np
import pytest

from caseload.llm import bwt, substring_dedup

from .conftest import SF


@pytest.mark.parametrize("chunk", [1 << 20, 7])
@pytest.mark.parametrize("seed", range(4))
def test_table_equals_sorted_suffixes(monkeypatch, seed, chunk):
    monkeypatch.setattr(bwt, "CHUNK", chunk)
    monkeypatch.setattr(bwt, "SPOOL", 16)
    rng = random.Random(seed)
    strings = [bytes(rng.choice(b"ab\x00c"[:2 + seed % 3]) for _ in range(rng.randrange(1, 12))) for _ in range(20)]
    sizes = np.array([len(s) for s in strings])
    table = bwt.build(np.frombuffer(b"".join(strings), np.uint8), np.cumsum(sizes) - sizes, sizes)
    table.rewind()
    got = {c: table.read(c, table.rows).tolist() for c in bwt.TYPES}
    seen = [s.replace(b"\x00", b"\xff") for s in strings]
    place = {row: (w, z) for z, words, rows in bwt.locate(table, sizes) for w, row in zip(words.tolist(), rows.tolist())}
    assert sorted(place.values()) == [(i, z) for i, s in enumerate(strings) for z in range(len(s) + 1)]
    rows = [seen[w][len(seen[w]) - z:] for w, z in (place[r] for r in range(table.rows))]
    assert rows == sorted(rows)
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert got["lcp"][1:] == [common(a, b) for a, b in zip(rows, rows[1:])]
    before = [seen[w][len(seen[w]) - z - 1] if z < len(seen[w]) else 0 for w, z in (place[r] for r in range(table.rows))]
    assert got["symbol"] == before


def brute(rows, length=50):
    first = {}
    texts = {i: (t or "").encode() for i, t in rows}
    for i in sorted(texts):
        t = texts[i]
        for a in range(len(t) - length + 1):
            first.setdefault(t[a:a + length], i)
    out = {}
    for i, t in texts.items():
        gone = bytearray(len(t))
        for a in range(len(t) - length + 1):
            if first[t[a:a + length]] < i:
                gone[a:a + length] = b"\x01" * length
        spans = sum(1 for a in range(len(t)) if gone[a] and (a == 0 or not gone[a - 1]))
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out[i] = (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def result(frame):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in frame.collect()}


def rows_of_cases():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(3, 9)))
    texts = [" ".join(word() for _ in range(rng.randrange(1, 120))) for _ in range(30)]
    passage = " ".join(word() for _ in range(20))
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(50 + i, t[rng.randrange(9):]) for i, t in enumerate(texts)]
    rows += [(100 + i, word() + passage[: rng.randrange(40, 120)] + word() + passage) for i in range(20)]
    rows += [(130, None), (131, ""), (132, "x" * 49), (133, "x" * 50), (134, "x" * 5000), (135, "ab" * 700 + "x" * 60), (136, "ba" * 300)]
    rows += [(137, "nul\x00" * 30), (138, "nul\x00" * 15), (140, "y" * 49 + "é" * 60), (141, "é" * 70)]
    return rows


@pytest.mark.parametrize("way", ["bits", "join", "pieces"])
def test_against_plain_search(docs_of, monkeypatch, way):
    if way == "join":
        monkeypatch.setattr(substring_dedup, "BITS", 64)
    if way == "pieces":
        monkeypatch.setattr(substring_dedup, "PIECE", 300)
        monkeypatch.setattr(substring_dedup, "BROADCAST_SPANS", 0)
        monkeypatch.setattr(substring_dedup, "PACK", 64)
    rows = rows_of_cases()
    assert result(substring_dedup.substring_dedup(docs_of(rows))) == brute(rows)


def test_table_against_plain_search(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert result(substring_dedup.op1_substring_dedup(spark, SF)) == brute(rows)


def test_empty_table_missing_and_repeated_ids(docs_of):
    assert substring_dedup.substring_dedup(docs_of([])).count() == 0
    out = substring_dedup.substring_dedup(docs_of([(None, "x" * 60), (1, "x" * 60), (1, "x" * 60), (2, "x" * 60)])).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in out)) == [(False, 1, 0), (False, 1, 0), (False, 2, 60), (True, 0, 0)]


@pytest.mark.parametrize("length", [134, 200])
def test_lengths_beyond_a_byte_are_refused(docs_of, length):
    with pytest.raises(ValueError, match=f"length {length}"):
        substring_dedup.substring_dedup(docs_of([(1, "x" * 500), (2, "x" * 500)]), length=length)
