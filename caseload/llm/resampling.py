"""Operator 12, target-distribution importance resampling: byte translate and split, chained CRC-32.

Documents are drawn by how much more likely their hashed n-grams are under a target corpus than under
the documents themselves, with Gumbel noise: the highest noisy scores are a sample without replacement
whose chances follow the importance weights.

1. Features: a 256-byte table puts A-Z in lower case and blanks the separators in the UTF-8 bytes;
   ``bytes.split`` yields the words. A word's CRC-32 is its feature; continued with a blank and the
   next word it is the CRC-32 of the longer n-gram, so no n-gram is ever joined. A feature's
   bucket is its CRC modulo ``buckets``.
2. Counts: every task counts buckets in one Counter and sends at most ``buckets`` rows; a grouped
   sum adds them. Both corpora are counted whole.
3. Gains: one integer per bucket from the smoothed ratio, computed on the driver and sent to the
   tasks: ``buckets`` numbers, whatever the size of the corpora.
4. Weights: a second pass over the texts adds up each document's gains; its hash gives the noise.
5. Draw: rows that are long enough are range partitioned by (score descending, id) and sorted within
   partitions; a rank is the place within the partition plus the rows of earlier partitions, which
   is a running sum over one row per partition.

Defined results: null and empty texts have no words: weight 0, never drawn. A null id hashes as the empty
string and is last among equal scores. Ids that repeat are ranked each. No target text, or an empty
table, gives gains from the smoothing alone. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_table, materialize, partitions, table
from .words import chunks, lowering

#: Everything below the letters and digits of ASCII, between them and after them.
SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
TABLE = lowering(SEPARATORS)
#: The low part of Spark's monotonically increasing ids: the place of a row in its partition.
PLACE_BITS = 33


def features(text: bytes, ngrams: int, table: bytes = TABLE) -> Iterator[list[int]]:
    """CRC-32 of all runs of 1 to ``ngrams`` words, a chunk of the text at a time."""
    kept: list[bytes] = []  # the last words before this chunk, for runs that cross its start
    for words in chunks(text, table):
        words = kept + words
        crcs = list(map(crc32, words))
        yield crcs[len(kept):]
        for n in range(2, ngrams + 1):
            crcs = [crc32(b" " + word, crc) for crc, word in zip(crcs, words[n - 1:])]
            yield crcs[max(0, len(kept) - n + 1):]
        kept = words[max(0, len(words) - ngrams + 1):]


def _bytes(text: pa.Scalar) -> bytes:
    return text.as_buffer().to_pybytes() if text.is_valid else b""


def _counts(ngrams: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[int] = Counter()
        for batch in batches:
            for text in batch.column(0):
                for crcs in features(_bytes(text), ngrams):
                    counts.update(map(buckets.__rmod__, crcs))
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.int64()), pa.array(counts.values(), pa.int64())],
                                             names=["bucket", "n"])
    return run


def bucket_counts(frame: DataFrame, text_col: str, ngrams: int, buckets: int) -> DataFrame:
    """(bucket, n): the features of all texts of a frame, at most ``buckets`` rows."""
    texts = frame.select(F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_counts(ngrams, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """The gain of every bucket: floor(1000 ln of the smoothed ratio of target to source)."""
    s, t = dict(source.collect()), dict(target.collect())  # at most ``buckets`` rows each
    all_s, all_t = sum(s.values()), sum(t.values())
    return [math.floor(1000 * math.log(float((t.get(b, 0) + 1) * (all_s + buckets)) / ((s.get(b, 0) + 1) * (all_t + buckets))))
            for b in range(buckets)]


def _weights(ngrams: int, gains: list[int]):
    buckets = len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, found, weights = [], [], []
            for text in batch.column(1):
                first = total = weight = 0
                for k, crcs in enumerate(features(_bytes(text), ngrams)):
                    first += len(crcs) if k % ngrams == 0 else 0  # single words come first of each chunk
                    total += len(crcs)
                    weight += sum(map(gains.__getitem__, map(buckets.__rmod__, crcs)))
                words.append(first)
                found.append(total)
                weights.append(weight)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (words, found, weights))],
                                             names=["id", "n_words", "n_features", "weight"])
    return run


def noise(id_col: Column, seed: int) -> Column:
    """Gumbel noise of an id, in thousandths."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` with their ranks (1, 2, 3 ...) in an order, from range partitions and their counts."""
    placed = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    placed = materialize(placed.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", PLACE_BITS)
    sizes = placed.groupBy(part.alias("_part")).count()  # one row per partition
    starts = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_start"))
    place = F.col("_at").bitwiseAND((1 << PLACE_BITS) - 1)
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(
        name, F.col("_start") + place + 1).drop("_at", "_part", "_start")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, target_text: str = "text",
             ngrams: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """One row per document: ``id_col``, n_features, weight, score, rank (null if not drawn)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    gains = bucket_gains(bucket_counts(rows, "text", ngrams, buckets), bucket_counts(target, target_text, ngrams, buckets), buckets)
    weighed = rows.mapInArrow(_weights(ngrams, gains), "id long, n_words long, n_features long, weight long")
    scored = materialize(weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed)).withColumn(
        "row", F.monotonically_increasing_id()))
    long_enough = scored.where(F.col("n_words") >= least_words)
    drawn = percent * long_enough.count() // 100
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row").asc()]
    in_order = ranked(long_enough, order).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    short = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return in_order.unionByName(short).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def draw(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The drawn documents, with all their columns (of rows that share an id, all or none)."""
    picked = materialize(resample(docs, target, id_col, **options).where("rank is not null").select(
        F.col(id_col).alias("_drawn_id")).distinct())
    out = materialize(docs.join(picked, docs[id_col] == picked["_drawn_id"], "left_semi"))
    drop_table(picked)
    return out


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
