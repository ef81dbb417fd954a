"""Operator 3: the pieces put together again are the token ids; sequences are full or powers of two."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from caseload.llm import packing

from .conftest import SF


def plain_ids(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [np.array([*e.ids, 1], "<u4") for e in t.encode_batch(texts, add_special_tokens=False)]


def check(rows, texts, max_tokens=2048):
    ids = dict(zip(texts, plain_ids([t or "" for t in texts.values()])))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.length > 0
        assert r.ids_crc32 == zlib.crc32(own[r.start:r.start + r.length].tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for doc, parts in pieces.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == len(ids[doc])
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == max_tokens or at & (at - 1) == 0 and at < max_tokens
    return sequences


def test_table(spark):
    texts = dict(tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    check(packing.op3_packing(spark, SF).collect(), texts)


def test_edge_cases(docs_of):
    texts = {1: None, 2: "", 3: "x" * 100_000, 4: " " * 50_000, 5: "<|endoftext|> é 漢字 🙂", 6: "a b c " * 9000, 7: "\n\n", 8: "same", 9: "same",
             10: "ends with <|endoftext|>", 11: "a<|endoftext|>b <|endoftext|><|endoftext|> c", 12: "<|endoftext|>", 13: "<|endoftext|",
             14: " <|endoftext|> " * 3000}
    rows = packing.pack_documents(docs_of(list(texts.items())), window_docs=3).collect()
    check(rows, texts)
    assert packing.pack_documents(docs_of([])).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(docs_of([]), max_tokens=1000)


def test_costs_are_balanced():
    lengths = np.sort(np.random.default_rng(3).integers(1, 2048, 2000))[::-1]
    cost, full = defaultdict(float), packing.capacities(int(lengths.sum()), 2048) == 2048
    for _, _, n, sequence, _ in packing.balance(lengths, 2048, 1.0, 1 / 2048):
        cost[sequence] += n + n * n / 2048
    balanced = np.array([cost[s] for s in np.flatnonzero(full)])
    cost, room, s = defaultdict(float), 2048, 0  # next fit, for comparison
    for n in lengths:
        if n > room:
            s, room = s + 1, 2048
        cost[s] += n + n * n / 2048
        room -= n
    assert balanced.std() < 0.5 * np.array(list(cost.values())).std()
    assert balanced.max() < 1.25 * balanced.mean() + 2048
