"""Operator 3, packing: cost-balanced packing of tokenised documents into fixed-length sequences.

The cost of a piece of n tokens is ``linear * n + quadratic * n^2`` (projections, and attention
within the document). Each task takes its own documents in windows of bounded size. In a window

* every full ``max_tokens`` of a document is a sequence of its own;
* the rests, in descending length, go whole to the lowest-cost sequence with enough remaining
  token capacity;
* a rest that fits nowhere whole is cut: the lowest-cost sequence with room takes what it can,
  until the document is placed.

The capacities of a window sum up to its tokens: sequences of ``max_tokens``, and for what is left
one sequence for each bit of its length. A power of two needs no padding, so nothing is padded.

No shuffle: a window never leaves its task, memory is bounded by the window (documents and tokens),
and sequence ids are unique because each task numbers within its partition id.

Ids are those of tokenizers with the byte-level BPE vocabulary as it is loaded, and then ``eos_id``.
tiktoken computes them from the same vocabulary (about four times as fast, with equal ids); a text that holds
the string of an added token, which tokenizers gives an id of its own, and what tiktoken refuses are
left to tokenizers.

Defined results: null and empty texts have the one token ``eos_id``; repeated rows are packed each;
an empty table gives no pieces. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, task_cache

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, cost double")
#: A rest is cut into pieces of at least so many tokens while any sequence has room for that.
LEAST_CUT = 64


class Tokens:
    """Token ids of a text with the vocabulary ``name`` (byte-level BPE)."""

    def __init__(self, name: str):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(name + ".tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.plain = Tokenizer.from_file(public_tokenizers.path(name + ".json"))
        self.added = [token.content for token in self.plain.get_added_tokens_decoder().values()]

    def ids(self, text: str, eos_id: int) -> np.ndarray:
        ids = None
        if not any(string in text for string in self.added):
            try:
                ids = self.fast.encode_ordinary(text)
            except BaseException as e:
                if not (isinstance(e, ValueError) or type(e).__name__ == "PanicException"):  # how the Rust code gives up
                    raise
        if ids is None:
            ids = self.plain.encode(text, add_special_tokens=False).ids
        ids.append(eos_id)
        return np.array(ids, dtype="<u4")


def tokens(name: str) -> Tokens:
    cache = task_cache()
    if name not in cache:
        cache[name] = Tokens(name)
    return cache[name]


def capacities(total: int, max_tokens: int) -> np.ndarray:
    """Sequence lengths that sum up to ``total`` with no padding: full ones, then one for each bit."""
    rest = total % max_tokens
    return np.array([max_tokens] * (total // max_tokens) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1],
                    dtype=np.int64)


def balance(lengths: np.ndarray, max_tokens: int, linear: float, quadratic: float) -> Iterator[tuple[int, int, int, int, int]]:
    """(item, start, length, sequence, offset) of each piece; ``lengths`` descend."""
    room = capacities(int(lengths.sum()), max_tokens)
    full = room.copy()
    cost = np.zeros(len(room))
    for item, left in enumerate(lengths.tolist()):
        start = 0
        while left:
            fits = np.flatnonzero(room >= left)
            if not len(fits):
                fits = np.flatnonzero(room >= min(left, LEAST_CUT))
            if not len(fits):
                fits = np.flatnonzero(room)
            best = int(fits[np.argmin(cost[fits])])
            n = min(left, int(room[best]))
            yield item, start, n, best, int(full[best] - room[best])
            room[best] -= n
            cost[best] += linear * n + quadratic * n * n
            start, left = start + n, left - n


def pack_window(docs: list[tuple[int | None, np.ndarray]], first: int, max_tokens: int, linear: float,
                quadratic: float) -> tuple[list[tuple], int]:
    """Rows of one window and the next free sequence number."""
    rows, rests = [], []

    def row(doc, ids, start, n, sequence, offset):
        rows.append((doc, start, n, zlib.crc32(ids[start:start + n].tobytes()), len(ids), sequence, offset,
                     linear * n + quadratic * n * n))

    for doc, ids in docs:
        whole = len(ids) // max_tokens * max_tokens
        for start in range(0, whole, max_tokens):
            row(doc, ids, start, max_tokens, first, 0)
            first += 1
        if whole < len(ids):
            rests.append((doc, ids, whole))
    rests.sort(key=lambda r: (r[2] - len(r[1]), r[0] is None, r[0]))
    lengths = np.array([len(ids) - whole for _, ids, whole in rests], dtype=np.int64)
    most = first
    for item, start, n, sequence, offset in balance(lengths, max_tokens, linear, quadratic):
        doc, ids, whole = rests[item]
        row(doc, ids, whole + start, n, first + sequence, offset)
        most = max(most, first + sequence + 1)
    return rows, most


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, max_tokens: int = 2048,
                   linear: float = 1.0, quadratic: float = 1 / 2048, window_docs: int = 4096,
                   window_tokens: int = 1 << 22, vocabulary: str = "byte_bpe_50k", eos_id: int = 1) -> DataFrame:
    """One row per piece; within a sequence, ``offset`` runs gapless from zero."""
    if max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        following = (context.partitionId() if context else 0) << 33
        encode = tokens(vocabulary).ids
        window, size = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal following, window, size
            rows, following = pack_window(window, following, max_tokens, linear, quadratic)
            window, size = [], 0
            kinds = [pa.float64() if n == "cost" else pa.int64() for n in names]
            columns = list(zip(*rows)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                ids = encode(text.as_py() or "", eos_id)
                window.append((doc.as_py(), ids))
                size += len(ids)
                if len(window) >= window_docs or size >= window_tokens:
                    yield flush()
        if window:
            yield flush()

    out = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(pack, SCHEMA)
    return out.withColumnRenamed("doc_id", id_col)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
