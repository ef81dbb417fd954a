"""Operator 13, SimHash near-duplicates: anchor-point covering with a product of two Golay codes.

A document's fingerprint has 64 bits: bit k is 1 if it is set in over half of the XXH64 hashes of its
word shingles. Fingerprints link at ``threshold`` (2) or fewer differing bits.

The anchors are a covering code: bits 0-22 and 23-45 of a fingerprint each lie within ``RADIUS`` = 3
bits of exactly one word of the perfect binary Golay code of length 23, so the pairs of code words
(2^24 anchors) cover all fingerprints. Let x and y link and a be the anchor nearest to x. In each
half the distance of y from a is at most 3 plus the bits in which x and y differ there; over both
halves these excesses add up to at most the threshold. So every fingerprint is replicated to each
anchor within that range (68 for most), and any two that link meet at the nearest anchor of either.
The 18 bits outside the halves play no part in the meeting, only in the comparison. No link is lost.

1. Rows with equal fingerprints are one class, represented by the smallest id (partial aggregation:
   a fingerprint shared by a third of all rows is one row per task).
2. Anchors that are nearest to some class are marked in a bitmap of 2^24 bits (2 MB, whatever the
   data), sent to the tasks. Replicas at unmarked anchors meet nobody and are not written.
3. Replicas are grouped by anchor. Each class at its nearest anchor is compared with all there; only
   links that join parts of the group not joined before are emitted: fewer links than rows.
   An anchor with more than ``TILE`` rows is split by hash into a grid of groups, each of at most about
   ``TILE`` nearest and ``TILE`` other rows, so no task needs the whole of it.
4. Connected components of the links give the smallest id that can be reached.

Defined results: a text without words (null, empty, white space) has fingerprint zero and links like
any other; with fewer words than a shingle the whole sequence is the one shingle. A row without id gets the
component of its fingerprint's other rows and their links, null if there are none. Rows that share an id are
nodes of the same id: what links with either is linked. An empty table gives an empty result.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, materialize, partitions, table, task_cache
from .graph import components
from .words import chunks, lowering

TABLE = lowering(bytes([*range(9, 14)]))
#: Shingles hashed before their bits are counted.
HELD = 1 << 16
TILE = 8192

# The binary Golay code of length 23.
LENGTH, RADIUS = 23, 3
GENERATOR = 0b110001110101
#: Bits of a code word that tell it from all others (any 12 neighbouring bits do).
INFORMATION = 12

ANCHORS = 1 << (2 * INFORMATION)


def fingerprint(text: bytes, words: int, seed: int) -> int:
    """The SimHash of a text, as an unsigned number."""
    from xxhash import xxh64_intdigest as digest

    ones, total = np.zeros(64, np.int64), 0
    held: list[int] = []

    def count() -> None:
        bits = np.unpackbits(np.array(held, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        np.add(ones, bits.sum(axis=0, dtype=np.int64), out=ones)
        held.clear()

    kept: list[bytes] = []  # the last words before this chunk, for shingles that cross its start
    for part in chunks(text, TABLE):
        part = kept + part
        for first in range(0, len(part) - words + 1, HELD):
            run = part[first:first + HELD + words - 1]
            line = b" ".join(run)
            starts = np.cumsum([0, *(len(w) + 1 for w in run)]).tolist()
            held.extend(digest(line[a:b - 1], seed) for a, b in zip(starts, starts[words:]))
            total += len(held)
            count()
        kept = part[-(words - 1):] if words > 1 else []
    if not total and kept:
        held.append(digest(b" ".join(kept), seed))
        total = 1
        count()
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little")


def _fingerprints(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_buffer().to_pybytes(), words, seed) if t.is_valid else 0 for t in batch.column(1)],
                              np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["id", "print"])
    return run


def syndromes(words: np.ndarray) -> np.ndarray:
    """The remainders of 23-bit words modulo the generator: zero for code words."""
    rest = np.asarray(words, np.int64).copy()
    top = GENERATOR.bit_length() - 1
    for bit in range(LENGTH - 1, top - 1, -1):
        rest ^= ((rest >> bit) & 1) * (GENERATOR << (bit - top))
    return rest


def _coset_table(threshold: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """By excess 0 .. threshold: for every syndrome the error words of weight ``RADIUS`` + excess (of at
    most ``RADIUS`` for excess 0) that have it, padded to equal numbers, and how many they are."""
    out = []
    for excess in range(threshold + 1):
        weights = range(RADIUS + 1) if excess == 0 else [RADIUS + excess]
        errors = np.array([sum(1 << b for b in bits) for w in weights for bits in combinations(range(LENGTH), w)], np.int64)
        of = syndromes(errors)
        order = np.argsort(of, kind="stable")
        sizes = np.bincount(of, minlength=1 << (LENGTH - INFORMATION))
        place = np.arange(len(errors)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        padded = np.zeros((len(sizes), int(sizes.max())), np.int64)
        padded[of[order], place] = errors[order]
        out.append((padded, sizes))
    return out


def coset_table(threshold: int) -> list[tuple[np.ndarray, np.ndarray]]:
    cached = task_cache()
    key = ("golay", threshold)
    if key not in cached:
        cached[key] = _coset_table(threshold)
    return cached[key]


def _halves(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = (1 << LENGTH) - 1
    return prints & mask, (prints >> LENGTH) & mask


def _anchor(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    shift = LENGTH - INFORMATION
    return (low >> shift) << INFORMATION | high >> shift


def nearest(prints: np.ndarray, threshold: int) -> np.ndarray:
    """The anchor nearest to each fingerprint (signed 64-bit numbers)."""
    errors, _ = coset_table(threshold)[0]
    low, high = (half ^ errors[syndromes(half), 0] for half in _halves(prints))
    return _anchor(low, high)


def anchors_in_range(prints: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of all anchors in the range of each fingerprint, the nearest included."""
    cosets = coset_table(threshold)
    halves = _halves(prints)
    of = [syndromes(half) for half in halves]
    rows, found = [], []
    for low_excess in range(threshold + 1):
        for high_excess in range(threshold + 1 - low_excess):
            (low_errors, low_sizes), (high_errors, high_sizes) = cosets[low_excess], cosets[high_excess]
            low_n, high_n = low_sizes[of[0]], high_sizes[of[1]]
            n = low_n * high_n
            row = np.repeat(np.arange(len(prints)), n)
            k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            low = halves[0][row] ^ low_errors[of[0][row], k // high_n[row]]
            high = halves[1][row] ^ high_errors[of[1][row], k % high_n[row]]
            rows.append(row)
            found.append(_anchor(low, high))
    return np.concatenate(rows), np.concatenate(found)


def _nearest_of(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(nearest(batch.column(0).to_numpy(), threshold))], names=["anchor"])
    return run


def marked(classes: DataFrame, threshold: int) -> bytes:
    """A bitmap of ``ANCHORS`` bits: which are nearest to some class."""
    anchors = classes.select("print").mapInArrow(_nearest_of(threshold), "anchor long")
    maps = anchors.groupBy(F.expr("bitmap_bucket_number(anchor + 1)").alias("bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(anchor + 1))").alias("bits"))  # both number from one
    out = bytearray(ANCHORS // 8)
    for bucket, bits in maps.collect():  # at most 512 rows of 4 KB
        out[(bucket - 1) * 4096:bucket * 4096] = bits
    return bytes(out)


def _replicas(threshold: int, bitmap: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(bitmap, np.uint8)
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                part = batch.slice(first, 4096)
                prints, reps = part.column(0).to_numpy(), part.column(1).to_numpy()
                row, anchor = anchors_in_range(prints, threshold)
                hit = known[anchor >> 3] >> (anchor & 7) & 1 == 1
                row, anchor = row[hit], anchor[hit]
                home = anchor == nearest(prints, threshold)[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(prints[row]), pa.array(reps[row]), pa.array(home)],
                    names=["anchor", "print", "rep", "home"])
    return run


def joining_links(prints: np.ndarray, reps: np.ndarray, home: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links between a group's nearest rows and all its rows, as few as join all that these links join."""
    part = np.arange(len(prints))
    links = []
    for h in np.flatnonzero(home).tolist():
        near = np.flatnonzero(np.bitwise_count(prints ^ prints[h]) <= threshold)
        if len(near) < 2:
            continue
        others, first = np.unique(part[near], return_index=True)
        own = part[h]
        for p, k in zip(others.tolist(), near[first].tolist()):
            if p != own:
                links.append((int(reps[h]), int(reps[k])))
        if len(others) > 1:
            part[np.isin(part, others)] = own
    return links


def _compare(threshold: int):
    """Links (a, b) from rows sorted by (anchor, i, j)."""
    names = ["anchor", "i", "j", "print", "rep", "home"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts = None, []

        def settle() -> list[tuple[int, int]]:
            rows = {c: np.concatenate([p[c] for p in parts]) for c in ("print", "rep", "home")}
            parts.clear()
            if len(rows["rep"]) < 2:
                return []
            return joining_links(rows["print"].view(np.uint64), rows["rep"], rows["home"], threshold)

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            group = np.stack([columns[c] for c in names[:3]], axis=1)
            cuts = [0, *(np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1).tolist(), len(group)]
            links = []
            for first, end in zip(cuts[:-1], cuts[1:]):
                now = tuple(group[first])
                if parts and now != last:
                    links += settle()
                last = now
                parts.append({c: columns[c][first:end] for c in ("print", "rep", "home")})
            if links:
                yield _links(links)
        if parts and (links := settle()):
            yield _links(links)
    return run


def _links(links: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*links)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _groups(replicas: DataFrame) -> DataFrame:
    """The replicas with their group (anchor, i, j); those of a large anchor once as nearest rows and once as
    others per row or column of its grid."""
    large = materialize(replicas.groupBy("anchor").count().where(F.col("count") > TILE).select(
        "anchor", F.ceil(F.col("count") / TILE).cast("int").alias("tiles")))
    plain = replicas.select("anchor", F.lit(0).alias("i"), F.lit(0).alias("j"), "print", "rep", "home")
    if not large.limit(1).count():
        return plain
    split = replicas.join(large, "anchor").withColumn("own", F.pmod(F.xxhash64("print"), F.col("tiles")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    as_home = split.where("home").select("anchor", F.col("own").alias("i"), F.col("other").alias("j"), "print", "rep", "home")
    as_other = split.select("anchor", F.col("other").alias("i"), F.col("own").alias("j"), "print", "rep", F.lit(False).alias("home"))
    return plain.join(large, "anchor", "left_anti").unionByName(as_home).unionByName(as_other)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 3, threshold: int = 2,
                   seed: int = 42) -> DataFrame:
    """One row per input row: ``id_col``, fingerprint (16 hex digits), component_id."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    prints = materialize(rows.mapInArrow(_fingerprints(words, seed), "id long, print long"))
    classes = materialize(prints.where("id is not null").groupBy("print").agg(F.min("id").alias("rep")))
    replicas = materialize(classes.mapInArrow(_replicas(threshold, marked(classes, threshold)),
                                              "anchor long, print long, rep long, home boolean"))
    groups = _groups(replicas).repartition(partitions(docs.sparkSession), "anchor", "i", "j")
    near = groups.sortWithinPartitions("anchor", "i", "j").mapInArrow(_compare(threshold), "a long, b long")
    # a row whose id is not its class's smallest is linked to it only where that id occurs with another fingerprint
    several = prints.where("id is not null").groupBy("id").agg(F.min("print").alias("low"), F.max("print").alias("high"))
    several = prints.join(several.where("low <> high").select("id"), "id", "left_semi").join(classes, "print").select(
        F.col("id").alias("a"), F.col("rep").alias("b"))
    labels = components(near.unionByName(several))
    drop_table(replicas)
    found = classes.join(labels, classes["rep"] == labels["node"], "left").select(
        "print", F.coalesce("label", "rep").alias("component_id"))
    return prints.join(found, "print", "left").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
