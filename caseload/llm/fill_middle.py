"""Operator 11, fill-in-middle: in-place block rotation of a document's segments.

A text is a sequence of units (a word with the white space before it; white space at the end is a
unit of its own). Two cuts between units split it into prefix, middle and suffix. Of the texts
that hold no sentinel, ``rate`` percent are rearranged, the others stay as they are:

1. one scan of the UTF-8 bytes finds the ends of all units; white space bytes never occur inside
   another character;
2. the three sentinels are inserted at the cuts, in a bytearray: ``<P>prefix<M>middle<S>suffix``;
3. the blocks of middle and suffix are exchanged by a rotation, which is three reversals in place:
   ``<P>prefix<S>suffix<M>middle`` (form psm); a second rotation, of the blocks of prefix and suffix,
   gives ``<S>suffix<P>prefix<M>middle`` (form spm);
4. ``restore`` finds the sentinels in an output, applies the inverse rotations in reverse order and
   deletes the sentinels, which gives the text back byte by byte.

Cuts, choice and form depend on the seed and the document's id alone, so a lost task repeats them.
Nothing is shuffled. A task holds one Arrow batch and the buffer of one text; a reversal swaps ``BLOCK``
bytes at a time.

Defined results: null texts count as empty; an empty text is plain with no units; a null id hashes as the
empty string; ids that repeat get the same choices, each row its own result; an empty table gives
an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .shingles import blocks, utf8

#: Bytes that a reversal swaps at a time.
BLOCK = 1 << 16
PREFIX, MIDDLE, SUFFIX = b"<P>", b"<M>", b"<S>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def unit_ends(text: np.ndarray) -> np.ndarray:
    """Where each unit ends, of a text given as bytes."""
    if not len(text):
        return np.empty(0, np.int64)
    space = _SPACE[text]
    return np.append(np.flatnonzero(~space[:-1] & space[1:]) + 1, len(text))


def code_points(text: np.ndarray) -> int:
    """How many characters some UTF-8 bytes hold."""
    return int(np.count_nonzero((text & 0xC0) != 0x80))


def reverse(buffer: np.ndarray, first: int, end: int) -> None:
    """Reverse ``buffer[first:end]`` in place, a block from either side at a time."""
    while end - first > 1:
        n = min(BLOCK, (end - first) // 2)
        left, right = buffer[first:first + n], buffer[end - n:end]
        kept = left.copy()
        left[:] = right[::-1]
        right[:] = kept[::-1]
        first, end = first + n, end - n


def rotate(buffer: np.ndarray, first: int, cut: int, end: int) -> None:
    """Exchange the neighbouring blocks ``[first:cut]`` and ``[cut:end]``: three reversals."""
    reverse(buffer, first, cut)
    reverse(buffer, cut, end)
    reverse(buffer, first, end)


def rearrange(text: bytes, first: int, second: int, form: str) -> bytearray:
    """The text cut at two byte positions, in the order of ``form``, with its sentinels."""
    out = bytearray(text)
    out[second:second] = SUFFIX
    out[first:first] = MIDDLE
    out[0:0] = PREFIX
    middle, suffix = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    view = np.frombuffer(out, np.uint8)
    rotate(view, middle, suffix, len(out))
    if form == "spm":
        rotate(view, 0, middle, middle + len(out) - suffix)
    return out


def restore(output: bytes, form: str) -> bytes:
    """The text that an output of this form was made from."""
    if form == "plain":
        return bytes(output)
    text = bytearray(output)
    view = np.frombuffer(text, np.uint8)
    if form == "spm":
        rotate(view, 0, text.index(PREFIX), text.index(MIDDLE))
    suffix, middle = text.index(SUFFIX), text.index(MIDDLE)
    rotate(view, suffix, middle, len(text))
    del view  # a bytearray with a view cannot shrink
    middle, suffix = text.index(MIDDLE), text.index(SUFFIX)
    del text[suffix:suffix + len(SUFFIX)]
    del text[middle:middle + len(MIDDLE)]
    del text[:len(PREFIX)]
    return bytes(text)


def choices(doc_id: int | None, seed: int) -> list[int]:
    """The first four 32-bit numbers of the hash of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i:i + 4], "big") for i in range(0, 16, 4)]


def _transform(seed: int, rate: int, spm_rate: int):
    def one(doc_id: int | None, text: np.ndarray) -> tuple:
        h1, h2, h3, h4 = choices(doc_id, seed)
        ends = unit_ends(text)
        n = len(ends)
        data = text.tobytes()
        if not data or h3 % 100 >= rate or any(s in data for s in SENTINELS):
            return n, "plain", None, None, data
        low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
        first, second = (int(ends[i - 1]) if i else 0 for i in (low, high))
        form = "spm" if h4 % 100 < spm_rate else "psm"
        return n, form, code_points(text[:first]), code_points(text[first:second]), bytes(rearrange(data, first, second, form))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for first, end in blocks(offsets):
                ids = batch.column(0).slice(first, end - first)
                rows = [one(i, data[offsets[k]:offsets[k + 1]]) for k, i in enumerate(ids.to_pylist(), first)]
                n, form, prefix, middle, output = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
                     pa.array(output, pa.binary()).cast(pa.string())],
                    names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])
    return run


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, seed: int = 42, rate: int = 50,
                   spm_rate: int = 80) -> DataFrame:
    """One row per document: ``id_col``, n (units), form, prefix_chars, middle_chars, output (the text rearranged)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_transform(seed, rate, spm_rate),
                          "id long, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("id", id_col)


def restored(frame: DataFrame, output_col: str = "output", form_col: str = "form", name: str = "restored") -> DataFrame:
    """``frame`` with the texts that its outputs were made from, in the column ``name``."""
    names = [c for c in frame.columns if c != name]
    out_at, form_at = names.index(output_col), names.index(form_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(out_at))
            for first, end in blocks(offsets):
                part = batch.slice(first, end - first)
                texts = [restore(data[offsets[k]:offsets[k + 1]].tobytes(), form)
                         for k, form in enumerate(part.column(form_at).to_pylist(), first)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary()).cast(pa.string())],
                                                 names=[*names, name])

    frame = frame.select(*names)
    return frame.mapInArrow(run, frame.withColumn(name, F.lit("")).schema)


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = restored(fill_in_middle(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2("restored", 256).alias("restored_sha256"))


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM t),
c AS (SELECT *, len(units) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
             ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM u),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50
                  THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM c),
p AS (SELECT *, array_to_string(units[1:i], '') AS prefix, array_to_string(units[i + 1:j], '') AS middle,
             array_to_string(units[j + 1:n], '') AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
