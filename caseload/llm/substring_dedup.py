"""Operator 1, suffix-array dedup: column-wise multi-document BWT and common prefixes in external files.

Every byte covered by a ``length``-byte string (a window) that also starts in a document with a
smaller id is removed; windows are judged on the input.

1. Selection. A window's anchor is the least hash of its ``ANCHOR``-byte strings, so equal windows have
   equal anchors. Tasks send the anchors of their documents, packed by hash bucket; those seen in two
   documents may belong to repeated windows, all others cannot.
2. Segments. Consecutive windows with one anchor form a segment of at most ``2 * length - ANCHOR`` bytes;
   each window is in exactly one. Segments with a repeated anchor are packed by anchor, equal
   ones once per task with their smallest and largest document, and shuffled: all copies of
   a window meet in one part, and a part is a share of the hash space.
3. Construction. A part's distinct segments are one collection: its Burrows-Wheeler transform and common
   prefixes are built by column-wise insertion in sequential files (``bwt``). Rows whose common
   prefixes reach ``length`` are the occurrences of one window; their smallest document is what
   counts. Segments get it for every window, in runs. An anchor with one distinct segment needs no
   construction: all its windows occur in that segment's documents only.
4. The runs are joined to the segments' occurrences, also those of a hot segment, which adaptive
   execution splits; covered bytes are united per document and cut out of the texts.

The repeated anchors select segments through a bit table of ``BITS`` bits that is broadcast: a proven
bound of 16 MB. Beyond ``BITS / 16`` repeated anchors they are joined to the documents by anchor
instead. Both ways are exact in the end, as a false hit only sends a segment in vain.

Defined results: null text counts as empty; a row without id keeps its text and is no earlier copy; rows
that repeat an id must repeat the text, none is an earlier copy of the other. Texts under
``length`` bytes stay. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bwt
from .common import drop_table, materialize, partitions, table
from .shingles import _BASE, _INVERSE, blocks, mix, utf8

ANCHOR = 24
#: The longest window.
LONGEST = 133
BITS = 1 << 27
#: Rows a task packs before it sends them.
PACK = 1 << 21
PIECE = 1 << 20
#: Merged spans up to this number (24 MB) may be broadcast.
BROADCAST_SPANS = 1 << 20


class Windows:
    """Anchors and segments of the windows of many texts."""

    def __init__(self, length: int):
        self.length = length
        self.wide = length - ANCHOR + 1
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, PIECE + 2 * self.length)
            for name, base in (("powers", _BASE), ("inverses", _INVERSE)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[:len(data)], out=total[1:])
        return total

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """(bytes, offsets, rows, first position) of blocks of rows; a long row comes in overlapping pieces."""
        for first, end in blocks(offsets, PIECE):
            part = offsets[first:end + 1]
            size = int(part[-1] - part[0])
            rows = np.arange(first, end)
            if size <= PIECE:
                yield data[part[0]:part[-1]], part - part[0], rows, 0
                continue
            for at in range(0, size, PIECE):
                own = data[part[0] + at:min(part[0] + at + PIECE + self.length - 1, part[-1])]
                yield own, np.array([0, len(own)]), rows, at

    def segments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """(anchor, row, start, bytes, sums) of each segment; ``sums`` are for hashing the texts."""
        none = np.empty(0, np.int64)
        n, length = len(data), self.length
        if n < length:
            return np.empty(0, np.uint64), none, none, none, np.zeros(1, np.uint64)
        total = self.sums(data)
        least = mix((total[ANCHOR:] - total[:-ANCHOR]) * self.inverses[:n - ANCHOR + 1])
        span = 1
        while 2 * span <= self.wide:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        rest = self.wide - span
        least = np.minimum(least[:len(least) - rest], least[rest:]) if rest else least
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n - length + 1]
        inside = np.flatnonzero(np.arange(n - length + 1) + length <= offsets[1:][row])
        if not len(inside):
            return np.empty(0, np.uint64), none, none, none, total
        value, row = least[inside], row[inside]
        fresh = np.ones(len(inside), bool)
        fresh[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
        begin = np.flatnonzero(fresh)
        count = np.diff(np.append(begin, len(inside)))
        parts = -(-count // self.wide)  # a periodic text can have one anchor for long
        if parts.max() > 1:
            piece = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            count = np.minimum(np.repeat(count, parts) - piece * self.wide, self.wide)
            begin = np.repeat(begin, parts) + piece * self.wide
        return mix(value[begin] ^ np.uint64(0xD1B54A32D192ED03)), row[begin], inside[begin], count + length - 1, total

    def hashes(self, total: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return mix((total[start + size] - total[start]) * self.inverses[start] + size.astype(np.uint64))


def _pack_anchors(length: int, shift: int):
    """(bucket, anchors) of this task's documents: distinct, the last bit set if two documents have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, held, size = Windows(length), [], 0
        last = np.uint64(1)

        def flush() -> pa.RecordBatch:
            joined = np.sort(np.concatenate(held))
            fresh = np.ones(len(joined), bool)
            fresh[1:] = (joined[1:] | last) != (joined[:-1] | last)
            first = np.flatnonzero(fresh)
            many = (np.diff(np.append(first, len(joined))) > 1) | (np.bitwise_or.reduceat(joined, first) & last > 0)
            anchors = joined[first] & ~last | many.astype(np.uint64)
            buckets, at = np.unique(anchors >> np.uint64(shift), return_index=True)
            return pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int64)), pa.array([x.tobytes() for x in np.split(anchors, at[1:])], pa.binary())],
                                              names=["bucket", "anchors"])

        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for own, at, _, _ in windows.pieces(data, offsets):
                anchor, row, *_ = windows.segments(own, at)
                if not len(anchor):
                    continue
                order = np.lexsort((row, anchor))
                a, r = anchor[order], row[order]
                fresh = np.ones(len(a), bool)
                fresh[1:] = a[1:] != a[:-1]
                first = np.flatnonzero(fresh)
                two = r[np.append(first[1:], len(a)) - 1] != r[first]
                held.append(a[first] & ~last | two.astype(np.uint64))
                size += len(first)
                if size >= PACK:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()
    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of this partition's buckets that two documents have (last bit cleared)."""
    last = np.uint64(1)
    blobs = [np.frombuffer(x, np.uint64) for batch in batches for x in batch.column(1).to_pylist()]
    if blobs:
        joined = np.sort(np.concatenate(blobs))
        fresh = np.ones(len(joined), bool)
        fresh[1:] = (joined[1:] | last) != (joined[:-1] | last)
        first = np.flatnonzero(fresh)
        many = (np.diff(np.append(first, len(joined))) > 1) | (np.bitwise_or.reduceat(joined, first) & last > 0)
        found = (joined[first] & ~last)[many].view(np.int64)
        for at in range(0, len(found), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(found[at:at + (1 << 16)])], names=["anchor"])


def _slots(anchors: np.ndarray) -> np.ndarray:
    return (anchors >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)


def _bit_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, bits): the 64-bit words of the bit table that this task sets."""
    slots = [_slots(batch.column(0).to_numpy().view(np.uint64)) for batch in batches]
    if slots:
        slots = np.unique(np.concatenate(slots))
        words, first = np.unique(slots >> 6, return_index=True)
        bits = np.bitwise_or.reduceat(np.uint64(1) << (slots & 63).astype(np.uint64), first)
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(bits.view(np.int64))], names=["word", "bits"])


def _bit_table(anchors: DataFrame) -> np.ndarray:
    """The bit table: BITS / 8 bytes, whatever the number of anchors."""
    out = np.zeros(BITS // 64, np.uint64)
    rows = anchors.mapInArrow(_bit_words, "word long, bits long").toArrow()  # at most a word per anchor, checked by the caller
    np.bitwise_or.at(out, rows.column(0).to_numpy(), rows.column(1).to_numpy().view(np.uint64))
    return out


class _Chosen:
    """Picks the segments with a repeated anchor: by the bit table, or by each document's own list."""

    def __init__(self, bits):
        self.bits = bits

    def mask(self, anchor: np.ndarray, row: np.ndarray, own: list | None) -> np.ndarray:
        anchor = anchor & ~np.uint64(1)
        if own is None:
            slot = _slots(anchor)
            return (self.bits.value[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) > 0
        out = np.zeros(len(anchor), bool)
        for r in np.unique(row).tolist():
            here = row == r
            out[here] = np.isin(anchor[here], np.array(own[r] or [], np.int64).view(np.uint64))
        return out


def _rows(batches: Iterator[pa.RecordBatch], length: int, chosen: _Chosen):
    """(windows, bytes, sums, anchors, ids, starts in the piece, positions in the text, sizes) of the chosen segments of each piece."""
    windows = Windows(length)
    for batch in batches:
        ids = batch.column(0).to_numpy()
        data, offsets = utf8(batch.column(1))
        lists = batch.column(2).to_pylist() if batch.num_columns > 2 else None
        for own, at, rows, base in windows.pieces(data, offsets):
            anchor, row, start, size, total = windows.segments(own, at)
            if len(anchor):
                keep = chosen.mask(anchor, row, None if lists is None else [lists[i] for i in rows.tolist()])
                anchor, row, start, size = anchor[keep], row[keep], start[keep], size[keep]
                yield windows, own, total, anchor, ids[rows[row]], start, start - at[row] + base, size


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    at = np.cumsum(size) - size
    place = np.repeat((start - at).astype(np.int32), size)  # a part or piece has less than 2 GB
    place += np.arange(len(place), dtype=np.int32)
    return data[place]


def _occurrences(length: int, chosen: _Chosen):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for windows, _, total, anchor, ids, start, position, size in _rows(batches, length, chosen):
            key = windows.hashes(total, start, size)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(anchor.view(np.int64)), pa.array(ids), pa.array(position)],
                                             names=["key", "anchor", "id", "position"])
    return run


def _pack_segments(length: int, shift: int, chosen: _Chosen):
    """(part, keys, anchors, low, high, sizes, texts): this task's distinct segments with their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def flush() -> pa.RecordBatch:
            key, anchor, low, high, size = (np.concatenate([h[i] for h in held]) for i in range(5))
            text = np.concatenate([h[5] for h in held])
            start = np.cumsum(size) - size
            order, first, low, high = _distinct(key, anchor, low, high)
            key, anchor, start, size = key[order][first], anchor[order][first], start[order][first], size[order][first]
            parts, at = np.unique(anchor >> np.uint64(shift), return_index=True)  # anchors ascend
            columns = [[x.tobytes() for x in np.split(c, at[1:])] for c in (key, anchor, low, high, size.astype(np.uint8))]
            texts = [_gather(text, s, z).tobytes() for s, z in zip(np.split(start, at[1:]), np.split(size, at[1:]))]
            return pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int64)), *[pa.array(c, pa.binary()) for c in (*columns, texts)]],
                                              names=["part", "keys", "anchors", "low", "high", "sizes", "texts"])

        for windows, own, total, anchor, ids, start, _, size in _rows(batches, length, chosen):
            if not len(anchor):
                continue
            key = windows.hashes(total, start, size)
            order, first, low, high = _distinct(key, anchor, ids, ids)
            pick = order[first]
            held.append((key[pick], anchor[pick], low, high, size[pick], _gather(own, start[pick], size[pick])))
            count += len(pick)
            if count >= PACK // 8:
                yield flush()
                held, count = [], 0
        if held:
            yield flush()
    return run


def _distinct(key: np.ndarray, anchor: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Order by (anchor, key), the first of each pair, and its smallest and largest document."""
    order = np.lexsort((key, anchor))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (key[order][1:] != key[order][:-1]) | (anchor[order][1:] != anchor[order][:-1])
    first = np.flatnonzero(fresh)
    return order, first, np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first)


def earliest(data: np.ndarray, size: np.ndarray, low: np.ndarray, length: int) -> np.ndarray:
    """For every window of the segments, in order, the smallest document that has it."""
    start = np.cumsum(size) - size
    windows = size - length + 1
    at = np.cumsum(windows) - windows
    suffixes = bwt.build(data, start, size)
    number = bwt.intervals(suffixes, length)
    interval = np.empty(windows.sum(), np.int32)
    first = np.full(int(number[-1]) + 1, np.iinfo(np.int64).max)
    for suffix, strings, rows in bwt.locate(suffixes, size):
        if suffix >= length:
            interval[at[strings] + size[strings] - suffix] = number[rows]
            np.minimum.at(first, number[rows], low[strings])
    suffixes.close()
    return first[interval]


def _covers(length: int):
    """(key, anchor, a, b, low): windows a to b of a segment, first seen in document ``low``."""

    def solve(blobs: list[tuple[bytes, ...]]) -> pa.RecordBatch | None:
        kinds = (np.uint64, np.uint64, np.int64, np.int64, np.uint8)
        key, anchor, low, high, size = (np.concatenate([np.frombuffer(b[i], k) for b in blobs]) for i, k in enumerate(kinds))
        size = size.astype(np.int64)
        text = np.concatenate([np.frombuffer(b[5], np.uint8) for b in blobs])
        start = np.cumsum(size) - size
        order, first, low, high = _distinct(key, anchor, low, high)
        pick = order[first]
        key, anchor, start, size = key[pick], anchor[pick], start[pick], size[pick]
        fresh = np.ones(len(anchor), bool)
        fresh[1:] = anchor[1:] != anchor[:-1]
        begin = np.flatnonzero(fresh)
        several = np.diff(np.append(begin, len(anchor)))
        alone = np.repeat(several == 1, several) & (low < high)  # its windows occur in copies of this one segment only
        shared = np.minimum.reduceat(low, begin) < np.maximum.reduceat(high, begin)
        shared = np.repeat(shared & (several > 1), several)  # the others were selected in vain
        simple = (key[alone].view(np.int64), anchor[alone].view(np.int64), np.zeros(alone.sum(), np.int64), size[alone] - length, low[alone])
        key, anchor, start, size, low, high = (x[shared] for x in (key, anchor, start, size, low, high))
        if not len(key):
            return covers(simple)
        found = earliest(_gather(text, start, size), size, low, length)
        windows = size - length + 1
        owner = np.repeat(np.arange(len(size)), windows)
        fresh = np.ones(len(found), bool)
        fresh[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
        begin = np.flatnonzero(fresh)
        end = np.append(begin[1:], len(found)) - 1
        who, seen = owner[begin], found[begin]
        useful = seen < high[who]
        begin, end, who, seen = begin[useful], end[useful], who[useful], seen[useful]
        base = (np.cumsum(windows) - windows)[who]
        built = (key[who].view(np.int64), anchor[who].view(np.int64), begin - base, end - base, seen)
        return covers([np.concatenate(both) for both in zip(simple, built)])

    def covers(columns) -> pa.RecordBatch | None:
        if not len(columns[0]):
            return None
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "anchor", "a", "b", "low"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, blobs = None, []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if blobs and row[0] != last:
                    found, blobs = solve(blobs), []
                    if found:
                        yield found
                last = row[0]
                blobs.append(row[1:])
        found = solve(blobs) if blobs else None
        if found:
            yield found
    return run


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, starts, ends) with the union of a document's spans."""
    for batch in batches:
        starts, ends = [], []
        for spans in batch.column(1):
            flat = spans.values
            a, b = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            order = np.argsort(a, kind="stable")
            a, reach = a[order], np.maximum.accumulate(b[order])
            fresh = np.ones(len(a), bool)
            fresh[1:] = a[1:] > reach[:-1]
            first = np.flatnonzero(fresh)
            starts.append(a[first])
            ends.append(reach[np.append(first[1:], len(a)) - 1])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))],
                                         names=["id", "starts", "ends"])


def repeated_spans(docs: DataFrame, length: int) -> DataFrame:
    """(id, starts, ends): the maximal byte spans to remove in each document (id, text) that has any."""
    spark = docs.sparkSession
    docs = docs.where("id is not null")
    parts = 1 << (16 * partitions(spark) - 1).bit_length()  # a share of the hash space each
    shift = 64 - parts.bit_length() + 1
    packed = docs.mapInArrow(_pack_anchors(length, shift), "bucket long, anchors binary")
    anchors = materialize(packed.repartition(partitions(spark), "bucket").mapInArrow(_repeated, "anchor long"))
    if anchors.count() <= BITS // 16:
        chosen = _Chosen(spark.sparkContext.broadcast(_bit_table(anchors)))
    else:
        own = docs.mapInArrow(_document_anchors(length), "id long, anchor long").distinct()
        lists = materialize(own.join(anchors, "anchor", "left_semi").groupBy("id").agg(F.collect_list("anchor").alias("own")))
        docs, chosen = docs.join(lists, "id"), _Chosen(None)
    binary = ", ".join(f"{c} binary" for c in ("keys", "anchors", "low", "high", "sizes", "texts"))
    segments = docs.mapInArrow(_pack_segments(length, shift, chosen), f"part long, {binary}")
    segments = segments.repartition(partitions(spark), "part").sortWithinPartitions("part")
    covers = materialize(segments.mapInArrow(_covers(length), "key long, anchor long, a long, b long, low long"))
    places = docs.mapInArrow(_occurrences(length, chosen), "key long, anchor long, id long, position long")
    spans = places.join(covers, ["key", "anchor"]).where("low < id").select(
        "id", F.struct((F.col("position") + F.col("a")).alias("start"), (F.col("position") + F.col("b") + length).alias("end")).alias("span"))
    spans = spans.groupBy("id").agg(F.collect_list("span").alias("spans"))  # one document's spans
    out = materialize(spans.mapInArrow(_unite, "id long, starts array<long>, ends array<long>"))
    drop_table(anchors)
    drop_table(covers)
    return out


def _document_anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(length)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, offsets = utf8(batch.column(1))
            for own, at, rows, _ in windows.pieces(data, offsets):
                anchor, row, *_ = windows.segments(own, at)
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows[row]]), pa.array((anchor & ~np.uint64(1)).view(np.int64))], names=["id", "anchor"])
    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of texts and their spans."""
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        rows = []
        for i, (starts, ends) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            own = data[offsets[i]:offsets[i + 1]].tobytes()
            digest, at, removed = hashlib.sha256(), 0, 0
            for a, b in zip(starts or (), ends or ()):
                digest.update(own[at:a])
                at, removed = b, removed + b - a
            digest.update(own[at:])
            rows.append((len(own), removed, len(starts or ()), digest.hexdigest()))
        columns = list(zip(*rows)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                                         names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = 50) -> DataFrame:
    """One row per document: ``id_col``, n_bytes, n_removed, n_spans, kept_sha256 (of the remaining bytes)."""
    if length > LONGEST:
        raise ValueError(f"length {length}: at most {LONGEST}, as segments of up to 2 * length - {ANCHOR} bytes have sizes and prefixes of one byte")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    spans = repeated_spans(docs, length)
    few = (spans.agg(F.sum(F.size("starts"))).first()[0] or 0) <= BROADCAST_SPANS
    joined = docs.join(F.broadcast(spans) if few else spans, "id", "left").select("id", "text", "starts", "ends")
    out = joined.mapInArrow(_cut, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))
