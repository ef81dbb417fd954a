"""Operator 10, exact dedup: two-pass Bloom filtering (DataFrame functions only).

Every text is reduced to one thin row (id, length, SHA-256 of the normalised text), written once.

1. The filter consists of blocks of 64 bits. A hash chooses one block and two of its bits: its cell, a single
   number. Cells are counted (the counters of the filter, partially per task); the bits of those hit
   twice or more are set and packed into 4 KB bitmaps of 512 blocks.
2. Each thin row probes the bitmap of its block, both bits in one look-up. A row with an unset bit is certainly unique: it
   passes straight through. The others, and only they, are shuffled and grouped by the full hash.

Filter errors are one-sided, so the result is exact: an unlucky unique row is grouped alone.

The first pass moves one number a row, and the second grouping only cells that repeat. Bitmaps merged from every task
would move tasks x filter instead, which is more as soon as a task holds fewer rows than an eighth of the filter's bytes.
The bitmaps are broadcast, so their size has a bound: the filter has ``bits_per_row`` bits for each row and never more than
``max_bits`` (64 MB). Beyond (33 million rows) it only becomes fuller: more unique rows are
grouped in vain, the plan and the result stay the same. Texts are read once and never shuffled.

A group of copies of any size is counted by partial aggregates; its rows meet the group's one row
in a join of two written tables, where adaptive execution splits a hot key.

Defined results: null text counts as empty; equal texts keep the row with the most code points
in the original text, then the smallest id (null last), then the first row; of rows that repeat an
id, one stays. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, materialize, table

WHITE_SPACE = "[\\x20\\x09-\\x0D]"


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def _place(bits: int) -> tuple[Column, Column]:
    """A row's block of 64 bits and its two bits there, as one number below 4096."""
    return F.pmod(F.xxhash64(F.col("sha"), F.lit(0)), F.lit(max(1, bits // 64))), F.pmod(F.xxhash64(F.col("sha"), F.lit(1)), F.lit(4096))


def _slots(block: Column, pair: Column) -> list[Column]:
    """The numbers of the pair's bits in the whole filter."""
    return [block * 64 + F.floor(pair / 64), block * 64 + pair % 64]


def repeated_slots(thin: DataFrame, bits: int) -> DataFrame:
    """Pass 1: (bucket, bitmap) of the bits of cells that were hit twice or more."""
    block, pair = _place(bits)
    twice = thin.select((block * 4096 + pair).alias("cell")).groupBy("cell").count().where("count > 1")
    # both bits lie in one bucket of 512 blocks, so cells move there and bitmaps never move
    block, pair = F.floor(F.col("cell") / 4096), F.col("cell") % 4096
    placed = twice.select((F.floor(block / 512) + 1).alias("bucket"), "cell").repartition("bucket")
    bits_set = placed.select("bucket", F.explode(F.array(*_slots(block, pair))).alias("slot"))
    # bitmap_bit_position numbers from one; slots start at zero
    return bits_set.groupBy("bucket").agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot + 1))").alias("bitmap"))


def _bit(bitmap: Column, position: Column) -> Column:
    """Bit ``position`` of a bitmap; false without a bitmap."""
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, F.pmod(position, F.lit(8)).cast("int")) == 1, F.lit(False))


def probe(thin: DataFrame, bitmaps: DataFrame, bits: int) -> DataFrame:
    """Pass 2: the thin rows with ``maybe``, false if the row is certainly unique."""
    block, pair = _place(bits)
    # at most bits / 8 bytes of bitmaps: a proven bound
    out = thin.withColumn("bucket", F.floor(block / 512) + 1).join(F.broadcast(bitmaps), "bucket", "left")
    hits = [_bit(F.col("bitmap"), F.pmod(slot, F.lit(32768))) for slot in _slots(block, pair)]
    return out.withColumn("maybe", hits[0] & hits[1]).drop("bucket", "bitmap")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                bits_per_row: int = 16, max_bits: int = 1 << 29) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    thin = docs.select(F.col(id_col).alias("id"), F.char_length(text).alias("points"),
                       F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("sha"))
    stored = materialize(thin.withColumn("row", F.monotonically_increasing_id()))
    rows = stored.count()
    bits = min(max_bits, max(32768, 1 << (rows * bits_per_row - 1).bit_length() if rows else 0))
    bitmaps = materialize(repeated_slots(stored, bits))
    probed = materialize(probe(stored, bitmaps, bits))
    again = probed.where("maybe")
    order = F.struct("points", F.bitwise_not(F.col("id")), F.bitwise_not(F.col("row")))
    groups = materialize(again.groupBy("sha").agg(
        F.count(F.lit(1)).alias("size"), F.max_by(F.struct("id", "row"), order).alias("keep")).where("size > 1"))
    sha = F.lower(F.hex("sha"))
    keep = F.col("keep")
    joined = again.join(groups, "sha", "left").select(
        F.col("id").alias(id_col), F.when(keep.isNull(), F.col("id")).otherwise(keep["id"]).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(keep["row"] == F.col("row"), F.lit(True)).alias("kept"), sha.alias("text_sha256"))
    alone = probed.where("not maybe").select(
        F.col("id").alias(id_col), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), sha.alias("text_sha256"))
    drop_table(stored)
    drop_table(bitmaps)
    return alone.unionByName(joined)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
"""
