"""Operator 13 against all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from caseload.llm import simhash

from .conftest import SF


def plain_print(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def groups(prints):
    """Smallest id reachable, from (id, fingerprint) pairs; equal ids are one node."""
    up = {i: i for i, _ in prints if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    rows = [(i, p) for i, p in prints if i is not None]
    for n, (a, p) in enumerate(rows):
        for b, q in rows[n + 1:]:
            if bin(p ^ q).count("1") <= 2:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return root


def brute(rows):
    prints = [(i, plain_print(t)) for i, t in rows]
    root = groups(prints)
    own = {p: root(i) for i, p in prints if i is not None}
    return sorted(((i, f"{p:016x}", own.get(p)) for i, p in prints), key=repr)


def result(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "fingerprint", "component_id").collect()), key=repr)


def test_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert result(simhash.op13_simhash(spark, SF)) == brute(rows)


def test_edge_cases_and_clashing_columns(docs_of):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    rows = [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "ONE  two"), (905, "one two"), (906, "Zwölf ÄÖ"), (907, "zwölf äö"),
            (908, "x" * 200_000), (909, "y " * 50_000), (None, "one two"), (None, "alone here now"), (910, "a b c"), (910, "d e f"),
            (910, "a b c"), (3, "d e f"), (2, "a b c")]
    for i in range(10, 150):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(300)] = f"n{rng.randrange(50)}"
        rows.append((i, " ".join(words)))
    docs = docs_of(rows)
    for name in ("print", "rep", "anchor", "home", "label", "node", "component_id", "tiles"):
        docs = docs.withColumn(name, docs.kept)
    got = result(simhash.simhash_groups(docs))
    assert got == brute(rows)
    assert result(simhash.simhash_groups(docs_of([]))) == []


def near_prints(rng, n):
    """Fingerprints in tight bunches, some of them chains."""
    out = []
    while len(out) < n:
        at = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 40)):
            out.append(at)
            for _ in range(rng.randrange(5)):
                at ^= 1 << rng.randrange(64)
    return out[:n]


@pytest.mark.parametrize("tile", [8192, 4])
def test_links_of_fingerprints(spark, monkeypatch, tile):
    """All links are found and joined, also where an anchor's rows are split into a grid."""
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(4)
    prints = near_prints(rng, 1500) + [0] + [1 << k for k in range(64)] + [3 << k for k in range(0, 62, 2)]
    ids = list(range(len(prints)))
    rng.shuffle(ids)

    def as_given(batches):
        for batch in batches:
            given = np.array([int(t) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(given.view(np.int64))], names=["id", "print"])

    monkeypatch.setattr(simhash, "_fingerprints", lambda words, seed: as_given)
    docs = spark.createDataFrame([(i, str(p)) for i, p in zip(ids, prints)], "doc_id long, text string").repartition(5)
    root = groups(list(zip(ids, prints)))
    got = simhash.simhash_groups(docs).collect()
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in got} == {i: (p, root(i)) for i, p in zip(ids, prints)}


def test_golay_code_is_perfect():
    errors, sizes = simhash.coset_table(2)[0]
    assert sizes.tolist() == [1] * 2048  # one error of weight 3 or less for every remainder
    rng = np.random.default_rng(5)
    prints = rng.integers(-(1 << 63), 1 << 63, 4000)
    row, anchor = simhash.anchors_in_range(prints, 2)
    assert len(set(zip(row.tolist(), anchor.tolist()))) == len(row)
    own = [set() for _ in prints]
    for r, a in zip(row.tolist(), anchor.tolist()):
        own[r].add(a)
    flips = prints ^ (np.int64(1) << rng.integers(0, 63, 4000)) ^ (np.int64(1) << rng.integers(0, 63, 4000))
    assert all(a in own[i] for i, a in enumerate(simhash.nearest(flips, 2).tolist()))


def test_links_are_fewer_than_rows():
    rng = np.random.default_rng(6)
    prints = np.uint64(rng.integers(0, 1 << 63)) ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64))  # all within two bits
    links = simhash.joining_links(prints, np.arange(3000), np.ones(3000, bool), 2)
    assert len(links) == 2999


def test_shingles_cross_chunks(monkeypatch):
    text = " ".join(f"Word{i}" for i in range(500))
    chunks = simhash.chunks
    monkeypatch.setattr(simhash, "chunks", lambda data, table: chunks(data, table, 13))
    monkeypatch.setattr(simhash, "HELD", 7)
    assert simhash.fingerprint(text.encode(), 3, 42) == plain_print(text)
