"""Operator 6, near-duplicate groups: multi-index Hamming join of b-bit MinHash signatures.

A document's set is its distinct five-word shingles. Its signature has ``CHUNKS * CHUNK`` symbols,
each the last ``b`` = 16 bits of one MinHash. Two signatures differ in d symbols. Split in
``CHUNKS`` chunks, by the pigeonhole principle one chunk has at most one differing symbol whenever
d <= 2 * CHUNKS - 1. So a row is indexed, for every chunk, under each key that leaves one of its
symbols out: all pairs within that distance share a key, and most pairs beyond it do. At similarity
0.75 the chance to share no key is (1 - 0.75^5 - 5 * 0.75^4 * 0.25)^12, about 6e-6, and smaller above;
this is the only way to lose a link, as the distance itself decides nothing.

1. Rows with equal sets are one class, represented by the smallest id.
2. Keys: 60 rows of 16 bytes per class. A key's smallest id is its lead.
3. Every class is compared with the lead it shares most keys with; links are confirmed by the
   exact sets and give components (a group of thousands of near copies costs a pair a row).
4. Keys whose rows are still in different components are searched in tiles of at most ``TILE`` rows
   (a hot key is split into pairs of tiles). For ``CLOSEST_ROUNDS`` rounds each row proposes the closest
   row of another component, which joins nearly all that can be joined with a pair a row. Then all
   pairs that share a key and are still between components are compared inside their tile, which writes
   only the links that join two of its components. Not compared are pairs inside a component and pairs
   that cannot be linked: by their sizes, or by their shingles' counts in ``BUCKETS`` hash buckets. The
   counts' differences add up to at most the number of shingles that only one of the two sets has, so
   this bound excludes no link. What the bounds leave in doubt gets its sets, in tiles of at most
   ``TILE_GRAMS`` shingles a side on average.

No step writes the pairs of a family: the similar but unlinked ones cost a comparison in a task's memory.
Sets are compared exactly, by 64-bit shingle hashes.

Defined results: a null or empty text has the empty set and is linked with nothing; with fewer
than five words the whole sequence is the one shingle; a row without id is kept, without
component. An id that repeats must repeat its text; each such row gets the same result. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, materialize, partitions, table, without
from .graph import components
from .shingles import SMALL_BLOCK, Hasher, blocks, mix, utf8

CHUNKS, CHUNK = 12, 5
SYMBOLS = CHUNKS * CHUNK
#: Hash buckets whose counts (a byte each, 255 for more, which keeps the bound) a row carries.
BUCKETS = 256
TILE = 1024
#: Shingles (8 bytes each) on a side of a tile that holds sets, and those compared with one row at a time.
TILE_GRAMS = 1 << 22
COMPARED = 1 << 20
CLOSEST_ROUNDS = 3
#: Findings a task holds at most (24 MB).
HELD = 1 << 20
#: Ids up to this number (16 MB) may be broadcast to pick rows of the documents.
BROADCAST_IDS = 1 << 20


def _seeds(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The signature (16-bit symbols) of each non-empty set."""
    joined = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    xor, times = _seeds(SYMBOLS, 1), _seeds(SYMBOLS, 2) | np.uint64(1)
    out = np.empty((len(sets), SYMBOLS), np.uint16)
    for k in range(SYMBOLS):
        least = np.minimum.reduceat((joined ^ xor[k]) * times[k], starts)
        out[:, k] = mix(least) & np.uint64(0xFFFF)
    return out


def bucket_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles of each set are in each of the hash buckets, 255 for more."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bucket = (mix(np.concatenate(sets) ^ np.uint64(0x2545F491)) >> np.uint64(32)).astype(np.int64) % BUCKETS
    counts = np.bincount(owner * BUCKETS + bucket, minlength=len(sets) * BUCKETS)
    return np.minimum(counts, 255).astype(np.uint8).reshape(len(sets), BUCKETS)


def _describe(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(words)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for first, end in blocks(offsets, SMALL_BLOCK):
                part = offsets[first:end + 1]
                sets = list(hasher.shingles_of(data[part[0]:part[-1]], part - part[0]))
                sizes = np.array([len(s) for s in sets], np.int64)
                full = [s for s in sets if len(s)]
                h1, h2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                marks: list[bytes | None] = [None] * len(sets)
                counts: list[bytes | None] = [None] * len(sets)
                if full:
                    at = np.cumsum([0, *map(len, full[:-1])])
                    joined = np.concatenate(full)
                    h1[sizes > 0] = np.add.reduceat(mix(joined ^ np.uint64(0x51ED270B)), at)
                    h2[sizes > 0] = np.add.reduceat(mix(joined ^ np.uint64(0xA5A5F00D)), at)
                    for i, s, c in zip(np.flatnonzero(sizes).tolist(), signatures(full), bucket_counts(full)):
                        marks[i], counts[i] = s.tobytes(), c.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(sizes), pa.array(h1.view(np.int64)),
                     pa.array(h2.view(np.int64)), pa.array(marks, pa.binary()), pa.array(counts, pa.binary())],
                    names=["id", "n", "h1", "h2", "mark", "counts"])
    return run


def index_keys(marks: np.ndarray) -> np.ndarray:
    """The index keys of each signature (rows x SYMBOLS): every chunk with one of its symbols left out."""
    salt = _seeds(CHUNKS * CHUNK, 3).reshape(CHUNKS, CHUNK)
    marks = marks.reshape(-1, CHUNKS, CHUNK).astype(np.uint64)
    keys = np.empty((len(marks), CHUNKS, CHUNK), np.uint64)
    for out in range(CHUNK):
        left = [marks[:, :, i] for i in range(CHUNK) if i != out]
        word = left[0] | left[1] << np.uint64(16) | left[2] << np.uint64(32) | left[3] << np.uint64(48)
        keys[:, :, out] = mix(word ^ salt[:, out])
    return keys.reshape(-1, SYMBOLS).view(np.int64)


def first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of its keys a signature shares first with each of others (SYMBOLS if none)."""
    differs = (b != a).reshape(-1, CHUNKS, CHUNK)
    errors = differs.sum(axis=2)
    chunk = (errors <= 1).argmax(axis=1)
    rows = np.arange(len(b))
    out = chunk * CHUNK + differs[rows, chunk].argmax(axis=1)  # without an error the first key, else the one without that symbol
    return np.where(errors[rows, chunk] <= 1, out, SYMBOLS)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, 4096):
            part = batch.slice(first, 4096)
            keys = index_keys(np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16))
            ids = np.repeat(part.column(0).to_numpy(), SYMBOLS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(ids)], names=["key", "id"])


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(words)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for first, end in blocks(offsets, SMALL_BLOCK):
                part = offsets[first:end + 1]
                sets = list(hasher.shingles_of(data[part[0]:part[-1]], part - part[0]))
                at = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                values = pa.array(np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.ListArray.from_arrays(pa.array(at), values)],
                    names=["id", "grams"])
    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The columns of each tile, from rows sorted by (key, i, j); ``grams``, if there, as a list of sorted sets."""
    last, parts = None, []

    def joined() -> dict:
        return {c: sum((p[c] for p in parts), []) if c == "grams" else np.concatenate([p[c] for p in parts]) for c in parts[0]}

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {c: batch.column(c).to_numpy() for c in ("key", "i", "j", "tile", "id", "n", "comp")}
        columns["mark"] = np.frombuffer(b"".join(batch.column("mark").to_pylist()), np.uint16).reshape(-1, SYMBOLS)
        columns["counts"] = np.frombuffer(b"".join(batch.column("counts").to_pylist()), np.uint8).reshape(-1, BUCKETS)
        if "grams" in batch.schema.names:
            grams = batch.column("grams")
            at = np.cumsum(grams.value_lengths().to_numpy())[:-1]
            columns["grams"] = np.split(grams.flatten().to_numpy().view(np.uint64), at)
        group = np.stack([columns["key"], columns["i"], columns["j"]], axis=1)
        cuts = [0, *(np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1).tolist(), len(group)]
        for first, end in zip(cuts[:-1], cuts[1:]):
            now = tuple(group[first])
            if parts and now != last:
                yield joined()
                parts = []
            last = now
            parts.append({c: v[first:end] for c, v in columns.items()})
    if parts:
        yield joined()


class _Tile:
    """The rows of one tile by size, and which of them may be linked with a row."""

    def __init__(self, rows: dict, percent: int):
        order = np.argsort(rows["n"], kind="stable")
        self.percent = percent
        self.ids, self.n, self.comp, self.tile = (rows[c][order] for c in ("id", "n", "comp", "tile"))
        self.marks, self.counts = rows["mark"][order], rows["counts"][order].astype(np.int16)
        self.grams = [rows["grams"][k] for k in order.tolist()] if "grams" in rows else []
        self.across = rows["i"][0] != rows["j"][0]
        self.key = rows["key"][0]
        self.place = (index_keys(self.marks) == self.key).argmax(axis=1)  # this key's place among each row's keys

    def partners(self, a: int, turn: int | None = None) -> np.ndarray:
        """Rows after ``a``, of another component, that may be linked with it and share no earlier key with it."""
        n, percent = self.n, self.percent
        b = np.arange(a + 1, int(np.searchsorted(n, n[a] * 100 // percent, side="right")))  # sizes further apart cannot be linked
        b = b[(self.comp[b] != self.comp[a]) & ((self.tile[b] != self.tile[a]) if self.across else True)]
        if turn is not None:
            b = b[mix((self.ids[b] * 31 ^ self.ids[a] * 31).astype(np.uint64)) % np.uint64(CLOSEST_ROUNDS) == turn]
        b = b[first_shared(self.marks[a], self.marks[b]) == self.place[a]]
        apart = np.abs(self.counts[b] - self.counts[a]).sum(axis=1, dtype=np.int64)  # at most the shingles that only one has
        return b[apart * (100 + percent) <= (n[a] + n[b]) * (100 - percent)]

    def linked(self, a: int, b: np.ndarray) -> np.ndarray:
        """Those of ``b`` whose sets are linked with that of ``a``."""
        own, out = self.grams[a], []
        step = max(1, COMPARED // max(1, int(self.n[b].max(initial=1))))
        for first in range(0, len(b), step):
            part = b[first:first + step]
            joined = np.concatenate([self.grams[k] for k in part.tolist()])
            hit = own[np.minimum(np.searchsorted(own, joined), len(own) - 1)] == joined
            both = np.add.reduceat(hit, np.cumsum([0, *self.n[part[:-1]]]), dtype=np.int64)
            out.append(part[100 * both >= self.percent * (self.n[a] + self.n[part] - both)])
        return np.concatenate(out) if out else b


def _closest(percent: int, turn: int):
    """(a, b, d): each row's closest partner that may be linked, among the pairs whose hash has this turn.

    A task reports a row once per ``HELD`` findings; every round tries other pairs.
    """
    def once(found: list[np.ndarray]) -> np.ndarray:
        joined = np.concatenate(found)
        joined = joined[np.lexsort((joined[:, 1], joined[:, 2], joined[:, 0]))]
        fresh = np.ones(len(joined), bool)
        fresh[1:] = joined[1:, 0] != joined[:-1, 0]
        return joined[fresh]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [np.empty((0, 3), np.int64)], 0
        for rows in _groups(batches):
            tile = _Tile(rows, percent)
            near, partner = np.full(len(tile.ids), SYMBOLS + 1), np.zeros(len(tile.ids), np.int64)
            for a in range(len(tile.ids) - 1):
                b = tile.partners(a, turn)
                if not len(b):
                    continue
                far = (tile.marks[b] != tile.marks[a]).sum(axis=1)
                best = int(far.argmin())
                if far[best] < near[a]:
                    near[a], partner[a] = far[best], tile.ids[b[best]]
                nearer = far < near[b]
                near[b[nearer]], partner[b[nearer]] = far[nearer], tile.ids[a]
            hit = near <= SYMBOLS
            held.append(np.stack([tile.ids[hit], partner[hit], near[hit]], axis=1))
            size += len(held[-1])
            if size > HELD:
                held = [once(held)]
                size = len(held[0])
                if size > HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0].T], names=["a", "b", "d"])
                    held, size = [np.empty((0, 3), np.int64)], 0
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in once(held).T], names=["a", "b", "d"])
    return run


def _doubtful(percent: int):
    """(key, id) of the rows that may be linked with another row of their tile: at most the tile's rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            tile = _Tile(rows, percent)
            marked = np.zeros(len(tile.ids), bool)
            for a in range(len(tile.ids) - 1):
                b = tile.partners(a)
                marked[b] = True
                marked[a] |= len(b) > 0
            ids = tile.ids[marked]
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), tile.key)), pa.array(ids)], names=["key", "id"])
    return run


def _links(percent: int):
    """Links (a, b) that the exact sets confirm, within each tile: fewer than its rows, as they join its components."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            tile = _Tile(rows, percent)
            found = []
            for a in range(len(tile.ids) - 1):
                for b in tile.linked(a, tile.partners(a)).tolist():
                    if tile.comp[b] != tile.comp[a]:
                        found.append((tile.ids[a], tile.ids[b]))
                        tile.comp[tile.comp == tile.comp[b]] = tile.comp[a]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in zip(*found)], names=["a", "b"])
    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, every: bool = False) -> DataFrame:
    """The rows of ``pairs`` (a, b) with 100 * intersection >= percent * union, as a written table.

    ``every`` says that the pairs name most of the sets, so picking those first saves nothing.
    """
    ids = None
    if not every:
        ids = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
        sets = sets.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")
    sets_of = lambda c: sets.select(F.col("id").alias(c), F.col("grams").alias(f"grams_{c}"))
    both = F.size(F.array_intersect("grams_a", "grams_b"))
    linked = materialize(pairs.join(sets_of("a"), "a").join(sets_of("b"), "b").where(
        100 * both >= percent * (F.size("grams_a") + F.size("grams_b") - both)).select("a", "b").distinct())
    if ids is not None:
        drop_table(ids)
    return linked


def _tiled(rows: DataFrame, reps: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """Rows (key, id, comp) of the keys that are in different components, a hot key's once per pair of tiles.

    A tile has ``TILE`` rows at most on average; with their ``sets``, ``TILE_GRAMS`` shingles.
    """
    rows = rows.join(reps.select("id", "n"), "id")
    load = F.count(F.lit(1)) / TILE
    if sets is not None:
        load = F.greatest(load, F.sum("n") / TILE_GRAMS)
    split = rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.ceil(load).cast("int").alias("tiles"))
    split = materialize(split.where("low <> high").select("key", "tiles"))
    rows = rows.join(split, "key").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "key", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "id", "comp")
    rows = rows.join(reps, "id").select("key", "i", "j", "tile", "id", "n", "comp", "mark", "counts")
    if sets is not None:
        rows = rows.join(sets, "id")
    return rows.repartition(partitions(rows.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")


def links_between(rows: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) that join all components of (key, id, comp) that can be joined, as a written table.

    The first pass finds the rows that sizes and counts leave in doubt; the second compares these, and only
    these, by their sets. Both write fewer rows than they read.
    """
    doubt = materialize(_tiled(rows, reps).mapInArrow(_doubtful(percent), "key long, id long").distinct())
    links = materialize(_tiled(doubt.join(rows, ["key", "id"]), reps, sets).mapInArrow(_links(percent), "a long, b long").distinct())
    drop_table(doubt)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 5,
                    percent: int = 75) -> DataFrame:
    """One row per input row: ``id_col``, n_shingles, component_id, kept."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    described = materialize(docs.mapInArrow(_describe(words), "id long, n long, h1 long, h2 long, mark binary, counts binary"))
    full = described.where("n > 0 and id is not null")
    classes = materialize(full.groupBy("h1", "h2", "n").agg(F.min("id").alias("rep")))
    members = materialize(described.join(classes, ["h1", "h2", "n"], "left").select(
        "id", "n", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep"), F.when(F.col("id") == F.col("rep"), F.col("mark")).alias("mark"),
        F.when(F.col("id") == F.col("rep"), F.col("counts")).alias("counts")))
    drop_table(described)
    drop_table(classes)
    reps = materialize(members.where("mark is not null").select("id", "n", "mark", "counts").dropDuplicates(["id"]))

    keys = reps.select("id", "mark").mapInArrow(_keys, "key long, id long")
    leads = materialize(keys.groupBy("key").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("size")).where("size > 1"))
    hits = materialize(keys.join(leads, "key").select("key", "id", "lead"))
    drop_table(leads)
    best = hits.where("id <> lead").groupBy("id", "lead").count().groupBy("id").agg(
        F.max_by("lead", F.struct("count", F.bitwise_not("lead"))).alias("lead"))
    ids = materialize(hits.select("id").distinct())
    named = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")
    sets = materialize(named.mapInArrow(_sets(words), "id long, grams array<long>"))  # read by every confirmation
    drop_table(ids)
    edges = _confirmed(materialize(best.select(F.col("id").alias("b"), F.col("lead").alias("a"))), sets, percent, every=True)
    labels = components(edges)

    def labelled(frame: DataFrame, column: str, name: str) -> DataFrame:
        side = labels.select(F.col("node").alias(column), F.col("label").alias("_label"))
        return frame.join(side, column, "left").withColumn(name, F.coalesce("_label", column)).drop("_label")

    for turn in (*range(CLOSEST_ROUNDS), None):
        rows = labelled(hits.select("key", "id"), "id", "comp")
        if turn is None:
            more = links_between(rows, reps, sets, percent)
        else:
            found = _tiled(rows, reps).mapInArrow(_closest(percent, turn), "a long, b long, d long")
            found = found.groupBy("a").agg(F.min(F.struct("d", "b")).alias("near")).select("a", "near.b")
            pairs = materialize(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
            more = _confirmed(pairs, sets, percent)
            drop_table(pairs)
        if more.limit(1).count():
            old_edges, old_labels = edges, labels
            edges = materialize(edges.union(more))
            labels = components(edges)
            drop_table(old_edges)
            drop_table(old_labels)
        drop_table(more)
    drop_table(hits)
    drop_table(sets)

    out = labelled(members.select("id", "n", "rep"), "rep", "component_id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
                      F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents, with all their columns, that stay: the smallest id of each group."""
    return without(docs, near_duplicates(docs, id_col, **options).where("not kept").select(id_col), id_col)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
