"""Operator 9, benchmark decontamination: size-partitioned MinHash containment search (DataFrame functions only).

Items are short, documents long: similarity of the whole sets says nothing, containment of the item
in the document does. Words are runs of characters other than white space, in lower case; a set is
the distinct five-word shingles (a text of fewer words is one shingle). So an item of one to four words is
found only in documents of exactly these words: it is not searched inside longer ones, as in the SQL.

Items are partitioned by the size m of their set (powers of two). Within a partition an item's
MinHash sketch is its k smallest shingle hashes, k = m - ceil(0.75 m) + 1 being what the partition's
sizes ask for: a document that holds 75 % of the item's shingles misses at most m - ceil(0.75 m) of
them, hence holds at least one of any k. So the search loses nothing: a document with n shingles
probes the partitions whose items can be contained in n shingles and takes as candidates the items
with a sketch hash among its shingles (the hits also estimate the containment). Candidates are then
verified by the exact intersection of the full shingle sets.

Sketches are written and counted; up to ``BROADCAST_ROWS`` rows (24 MB) they are broadcast and the
documents are read in one pass without a shuffle, beyond that the shingles are joined by hash
(written tables on both sides, so adaptive execution splits a very common shingle).

Defined results: null and empty texts have no shingles, so neither such documents nor such items
are found; rows without id are not reported; repeated rows of an id or item are reported once;
empty tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, drop_table, materialize, table, without

SPACE = "[\\x20\\x09-\\x0D]+"


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def word_list(text: Column) -> Column:
    """The words of a text in lower case; null for null."""
    return F.filter(F.split(F.lower(text), SPACE), lambda w: w != "")


def shingle_hashes(text: Column, words: int) -> Column:
    """The hashes of a text's shingles, in order and with repeats."""

    def hashes(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(w) - words),
                            lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(words)]))
        few = F.transform(F.filter(F.array(w), lambda x: F.size(x) > 0), lambda x: F.xxhash64(F.array_join(x, " "), F.size(x)))
        return F.when(F.size(w) >= words, grams).otherwise(few)

    return bound(word_list(F.coalesce(text, F.lit(""))), hashes)


def item_sets(items: DataFrame, item_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """(item, m, need, part, grams, sketch) of each item with a word, as a written table."""
    sets = items.where(F.col(item_col).isNotNull()).select(
        F.col(item_col).alias("item"), F.array_sort(F.array_distinct(shingle_hashes(F.col(text_col), words))).alias("grams"))
    sets = sets.dropDuplicates(["item"]).withColumn("m", F.size("grams")).where("m > 0")
    need = F.ceil(F.col("m") * percent / 100).cast("int")
    return materialize(sets.withColumn("need", need).withColumn("part", F.floor(F.log2("m")).cast("int")).withColumn(
        "sketch", F.slice("grams", F.lit(1), F.col("m") - F.col("need") + 1)))


def candidates(docs: DataFrame, sets: DataFrame, words: int) -> DataFrame:
    """(id, item, hits) of the documents that hold part of an item's sketch, as a written table."""
    sketches = materialize(sets.select("item", "part", "need", F.explode("sketch").alias("gram")))
    least = {r.part: r.need for r in sets.groupBy("part").agg(F.min("need").alias("need")).collect()}  # one row per power of two
    hashes = docs.where("id is not null").select("id", shingle_hashes(F.col("text"), words).alias("grams"))
    rows = hashes.select("id", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    rows = rows.where(F.col("n") >= min(least.values(), default=1))
    if sketches.count() <= BROADCAST_ROWS:
        met = rows.join(F.broadcast(sketches), "gram")
    else:
        met = materialize(rows).join(sketches, "gram")
    fits = F.lit(False)
    for part, need in least.items():  # a document probes the partitions that its size admits
        fits = fits | ((F.col("part") == part) & (F.col("n") >= need))
    found = met.where(fits & (F.col("n") >= F.col("need"))).select("id", "item", "gram").distinct()
    out = materialize(found.groupBy("id", "item").agg(F.count(F.lit(1)).alias("hits")))
    drop_table(sketches)
    return out


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", *, words: int = 5,
                 percent: int = 75) -> DataFrame:
    """(``id_col``, ``item_col``, n_item, n_shared, containment) of every item found in a document."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sets = item_sets(items, item_col, item_text_col, words, percent)
    pairs = candidates(docs, sets, words)
    ids = materialize(pairs.select("id").distinct())
    rows = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "id", "left_semi")
    grams = materialize(rows.select("id", F.array_distinct(shingle_hashes(F.col("text"), words)).alias("doc_grams")))
    both = pairs.select("id", "item").join(sets.select("item", "m", "need", "grams"), "item").join(grams, "id").select(
        "id", "item", "m", "need", F.size(F.array_intersect("grams", "doc_grams")).alias("n_shared"))
    out = materialize(both.where("n_shared >= need").groupBy("id", "item", "m").agg(F.max("n_shared").alias("n_shared")))
    for old in (ids, grams, pairs, sets):
        drop_table(old)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("m").cast("long").alias("n_item"),
                      F.col("n_shared").cast("long").alias("n_shared"), (F.col("n_shared") / F.col("m")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents, with all their columns, in which no item is found."""
    return without(docs, contaminated(docs, items, id_col, **options).select(id_col), id_col)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _grams_sql(name: str, key: str) -> str:
    return f"""
  SELECT DISTINCT {key}, unnest(CASE
    WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS gram
  FROM (SELECT {key}, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
        FROM {name} WHERE text IS NOT NULL AND {key} IS NOT NULL)"""


SQL = f"""
WITH d AS ({_grams_sql("documents", "doc_id")}),
b AS ({_grams_sql("benchmark", "item_id")}),
m AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id),
s AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN b USING (gram) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
FROM s JOIN m USING (item_id) WHERE 100 * n_shared >= 75 * n_item
"""
