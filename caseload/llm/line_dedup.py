"""Operator 7, line dedup: suffix array over line-ID sequences by distributed prefix doubling (DataFrame functions only).

A document is the sequence of its non-blank lines, white space at their ends removed. A run of
consecutive lines with at least ``min_words`` words that also begins earlier, in a smaller document
or higher up in the same one, is a later copy and its lines are deleted; the first copy stays. Runs
are judged on the input, so overlapping copies and copies of copies go alike.

1. Line ids: lines that occur once end every run, so only repeated ones go on. Their distinct
   hashes are sorted over the cluster and numbered in that order: rank[1] of every suffix.
2. Prefix doubling: rank[2h] of a suffix numbers the sorted pairs (rank[h] here, rank[h] h lines
   on). Suffixes of equal rank[h] form the interval of the suffix array whose longest common
   prefix is h lines or more; the interval for any other length n between h and 2h is the pair
   (rank[h] at the start, rank[h] at h lines before the end). Intervals of one suffix end there.
3. A maximal repeated run is the union of the shortest sub-runs that reach ``min_words``, taken
   from each first line on and from each last line back. A line has a word at least, so those runs
   have at most ``min_words`` lines, and doubling stops there whatever the length of the copies.
   Every such run looks up its interval; if the interval's first start is an earlier one, its
   lines go. So whole maximal runs go, of any length.

The work is grouped aggregates and joins on written tables; a line in a third of all documents is
pre-aggregated before it is shuffled, and adaptive execution splits it in the joins.

Defined results: null text has no lines and stays null; empty and blank texts stay as they are;
a row without id neither loses lines nor counts as a first copy; rows that repeat an id count as
one document. An empty table gives an empty result. Other columns are kept by
``drop_repeated_lines`` and not read otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, drop_table, free_name, materialize, table
from .decontaminate import bound

ENDS = " \t\n\x0b\x0c\r"
SPACE = "[\\x20\\x09-\\x0D]+"
#: Deleted line numbers up to this number (16 MB) may be broadcast; beyond, the texts are shuffled to them.
BROADCAST_LINES = 1 << 22


def _shortest(counts: Column, least: int) -> Column:
    """How many of the word counts, from the first on, reach ``least``; null if all do not."""
    start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("lines"))

    def step(done: Column, words: Column) -> Column:
        more = F.struct((done["words"] + words).alias("words"), (done["lines"] + 1).alias("lines"))
        return F.when(done["words"] >= least, done).otherwise(more)

    return F.aggregate(counts, start, step, lambda x: F.when(x["words"] >= least, x["lines"]))


def line_rows(docs: DataFrame, min_words: int) -> DataFrame:
    """(id, seq, at, words, ahead, behind, h1, h2) of every non-blank line.

    ``ahead`` and ``behind`` are the lengths of the shortest runs with enough words that begin and
    end here; null if the document does not reach them.
    """
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(
        i.alias("at"), F.btrim(x, F.lit(ENDS)).alias("line"))), lambda s: s["line"] != "")
    counted = F.transform(lines, lambda s: F.struct(s["at"].alias("at"), s["line"].alias("line"), F.size(F.split(s["line"], SPACE)).alias("words")))

    def described(rows: Column) -> Column:
        def line(s: Column, i: Column) -> Column:
            after = F.transform(F.slice(rows, i + 1, F.lit(min_words)), lambda r: r["words"])
            first = F.greatest(F.lit(0), i + 1 - min_words)
            before = F.reverse(F.transform(F.slice(rows, first + 1, i + 1 - first), lambda r: r["words"]))
            enough = s["words"] >= min_words
            return F.struct(s["at"].alias("at"), s["words"].alias("words"),
                            F.when(enough, F.lit(1)).otherwise(_shortest(after, min_words)).alias("ahead"),
                            F.when(enough, F.lit(1)).otherwise(_shortest(before, min_words)).alias("behind"),
                            F.xxhash64(s["line"], F.lit(1)).alias("h1"), F.xxhash64(s["line"], F.lit(2)).alias("h2"))
        return F.transform(rows, line)

    return docs.where("id is not null").select("id", F.posexplode(bound(counted, described)).alias("seq", "s")).select("id", "seq", "s.*")


def _ranked(classes: DataFrame, *by: str) -> DataFrame:
    """The classes numbered in sorted order: ids increase along the range partitions of the sort."""
    return materialize(classes.orderBy(*by).withColumn("rank", F.monotonically_increasing_id()))


def deletions(docs: DataFrame, min_words: int) -> DataFrame:
    """(id, gone): the numbers of the lines to delete in each document (id, text) that has any."""
    lines = materialize(line_rows(docs, min_words))
    classes = _ranked(lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("id", "seq")).alias("first"))
                      .where("size > 1"), "h1", "h2")
    base = materialize(lines.join(classes.drop("size"), ["h1", "h2"]).drop("h1", "h2"))
    drop_table(lines)
    drop_table(classes)
    single = base.where((F.col("words") >= min_words) & (F.col("first") < F.struct("id", "seq"))).select("id", "at")
    ahead = base.where("ahead > 1").select("id", F.col("seq").alias("start"), F.col("ahead").alias("length"))
    behind = base.where("behind > 1").select("id", (F.col("seq") - F.col("behind") + 1).alias("start"), F.col("behind").alias("length"))
    wanted = materialize(ahead.union(behind).distinct())
    longest = wanted.agg(F.max("length")).first()[0] or 1

    ranks, found, h = base.select("id", "seq", "rank"), [], 1
    old = [base, wanted]
    while h <= longest:
        left, right = ranks.withColumnRenamed("rank", "ra"), ranks.withColumnRenamed("rank", "rb")
        runs = wanted.where(F.col("length").between(h, 2 * h - 1))
        runs = runs.join(left.withColumnRenamed("seq", "start"), ["id", "start"]).withColumn("seq", F.col("start") + F.col("length") - h)
        found.append(materialize(runs.join(right, ["id", "seq"]).drop("seq").withColumn("level", F.lit(h))))
        if 2 * h <= longest:
            pairs = materialize(left.join(right.withColumn("seq", F.col("seq") - h), ["id", "seq"]))
            classes = _ranked(pairs.groupBy("ra", "rb").count().where("count > 1"), "ra", "rb")
            ranks = materialize(pairs.join(classes, ["ra", "rb"]).select("id", "seq", "rank"))
            old += [ranks]
            drop_table(pairs)
            drop_table(classes)
        h *= 2
    runs = reduce(DataFrame.unionByName, found)
    keys = ["length", "ra", "rb"]
    firsts = materialize(runs.groupBy(*keys).agg(F.min(F.struct("id", "start")).alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1"))
    later = runs.join(firsts, keys).where(F.col("first") < F.struct("id", "start"))
    covered = later.select("id", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("seq"))
    longer = covered.join(base.select("id", "seq", "at"), ["id", "seq"]).select("id", "at")
    gone = materialize(single.union(longer).groupBy("id").agg(F.collect_set("at").alias("gone")))  # at most one document's lines
    for frame in (*old, *found, firsts):
        drop_table(frame)
    return gone


def without_lines(text: Column, gone: Column) -> Column:
    """The text without the lines of those numbers."""
    return bound(F.split(text, "\n"), lambda lines: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.get(lines, i)), "\n"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_words: int = 10,
                        removed_col: str | None = None) -> DataFrame:
    """The documents with all their columns, later copies of line runs deleted from the text.

    ``removed_col`` is the number of deleted lines: ``_removed``, or with more underscores in front if the
    documents have such a column (``free_name``).
    """
    removed_col = removed_col or free_name(docs, "_removed")
    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    gone = deletions(thin, min_words).withColumnRenamed("id", "_id")
    size = gone.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("gone")).alias("lines")).first()
    if size.rows <= BROADCAST_ROWS and (size.lines or 0) <= BROADCAST_LINES:
        gone = F.broadcast(gone)
    joined = docs.join(gone, docs[id_col] == gone["_id"], "left")
    text = F.when(gone["gone"].isNull(), docs[text_col]).otherwise(without_lines(docs[text_col], gone["gone"]))
    columns = [text.alias(c) if c == text_col else docs[c] for c in docs.columns]
    return joined.select(*columns, F.coalesce(F.size(gone["gone"]), F.lit(0)).cast("long").alias(removed_col))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256): the remaining text is given by its digest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = drop_repeated_lines(docs)
    return out.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_kept"),
                      F.col("_removed").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


_LINES = r"regexp_extract_all(line, '[^\x20\x09-\x0D]+')"
SQL = rf"""
WITH raw AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, seq - 1 AS no, trim(ls[seq], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS seq FROM raw)),
d AS (SELECT doc_id, list(line ORDER BY no) AS lines, list(no ORDER BY no) AS nos, list(len({_LINES}) ORDER BY no) AS words
      FROM l WHERE line <> '' GROUP BY doc_id),
s AS (SELECT *, unnest(range(1, 11)) AS n FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS s FROM d)),
r AS (SELECT doc_id, s, n, array_to_string(lines[s:s + n - 1], chr(10)) AS run, nos[s:s + n - 1] AS nos FROM s
      WHERE s + n - 1 <= len(lines) AND list_sum(words[s:s + n - 1]) >= 10
        AND (n = 1 OR list_sum(words[s:s + n - 2]) < 10 OR list_sum(words[s + 1:s + n - 1]) < 10)),
f AS (SELECT *, first_value((doc_id, s)) OVER (PARTITION BY n, run ORDER BY doc_id, s) AS first FROM r),
g AS (SELECT doc_id, list(DISTINCT no) AS gone FROM (SELECT doc_id, unnest(nos) AS no FROM f WHERE first <> (doc_id, s)) GROUP BY doc_id),
k AS (SELECT doc_id, text, coalesce(len(gone), 0) AS n_removed,
             array_to_string(list_transform(list_filter(range(0, len(ls)), lambda i: NOT list_contains(coalesce(gone, []), i)),
                                            lambda i: ls[i + 1]), chr(10)) AS kept
      FROM raw LEFT JOIN g USING (doc_id))
SELECT doc_id, greatest(1, len(string_split(kept, chr(10)))) AS n_kept, n_removed, sha256(kept) AS kept_sha256 FROM k
"""
