"""Operator 12 against words found by pattern and n-grams joined as text."""

import hashlib
import math
import re
import zlib

import pytest

from caseload.llm import resampling

from .conftest import SF


def grams(text, n):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i:i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def brute(docs, target, n=1, buckets=10_000, least=20, percent=10, seed=2024):
    def counted(texts):
        out = [0] * buckets
        for text in texts:
            for gram in grams(text, n)[1]:
                out[zlib.crc32(gram.encode()) % buckets] += 1
        return out

    s, t = counted(x for _, x in docs), counted(target)
    big_s, big_t = sum(s), sum(t)
    gains = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    rows, eligible = [], []
    for k, (i, text) in enumerate(docs):
        words, own = grams(text, n)
        weight = sum(gains[zlib.crc32(g.encode()) % buckets] for g in own)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(own), weight, score, None])
        if len(words) >= least:
            eligible.append((-score, i is None, i or 0, k))
    for rank, (*_, k) in enumerate(sorted(eligible)[:percent * len(eligible) // 100], 1):
        rows[k][4] = rank
    return sorted(map(tuple, rows), key=repr)


def result(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    got = resampling.op12_resampling(spark, SF)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint"] * 5
    assert result(got) == brute(docs, target)


@pytest.mark.parametrize("ngrams", [1, 3])
def test_edge_cases_and_runs_of_words(spark, docs_of, ngrams):
    rows = [(1, None), (2, ""), (3, " .,!\n"), (4, "ÄÖ straße漢字"), (5, "A_b-C d'e \x7f f g"), (6, "word " * 30_000),
            (7, "x" * 100_000), (None, "one two three four"), (8, "same " * 3), (8, "same " * 3)]
    rows += [(100 + i, " ".join(f"w{(i * j) % 37}" for j in range(18 + i % 7))) for i in range(200)]
    rows += [(50, rows[-1][1])] * 3  # equal ids, texts and scores
    target = ["w1 w2 W3", "w1 one two", None, ""]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id int, text string")
    docs = docs_of(rows)
    for name in ("row", "weight", "score", "rank", "_at", "_part", "n_words", "_drawn_id"):
        docs = docs.withColumn(name, docs.kept)
    out = resampling.resample(docs, bench, ngrams=ngrams, buckets=64, percent=30)
    assert result(out) == brute(rows, target, ngrams, 64, percent=30)
    drawn = {r.doc_id for r in out.collect() if r["rank"]}
    kept = resampling.draw(docs, bench, ngrams=ngrams, buckets=64, percent=30)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == drawn


def test_runs_cross_chunks(monkeypatch):
    text = " ".join(f"Word{i}" for i in range(500)).encode()
    whole = sorted(c for crcs in resampling.features(text, 3) for c in crcs)
    chunks = resampling.chunks
    monkeypatch.setattr(resampling, "chunks", lambda data, table: chunks(data, table, 11))
    assert sorted(c for crcs in resampling.features(text, 3) for c in crcs) == whole
    assert whole == sorted(zlib.crc32(g.encode()) for g in grams(text.decode(), 3)[1])


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id int, text string")
    assert result(resampling.resample(docs_of([]), none)) == []
    rows = [(i, "a b c " * 10) for i in range(20)]
    assert result(resampling.resample(docs_of(rows), none)) == brute(rows, [])
