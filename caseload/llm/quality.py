"""Operator 4, quality classifier: hierarchical empirical Bayes over documents, hosts and paths.

Labelled documents are bad if their quality is 0 or they are toxic.

1. Document evidence. Letter words that mark bad documents are learned from document frequencies
   over all labelled rows, in ``TABLES`` hash tables of 2^``BITS`` buckets (a word counts only if all its
   buckets agree, so collisions cancel out). They and the shape of the text (shares of kinds of
   characters, repeated words and lines) are the features of a logistic regression, fitted on at most
   ``max_sample`` labelled rows (by id hash). Less the base rate it gives a log likelihood ratio for every document.
2. Grouped aggregation over all documents: bad ones by path and host, a labelled row by its label, another
   by the classifier's probability. The global prior is shrunk into hosts, hosts into paths: posterior
   mean (bad + m * prior) / (n + m), m from the variance between groups (method of moments), so a
   sparse site stays near its parent.
3. A document's host and path posteriors leave the document itself out, at every level: what it says counts
   once, as evidence. The only document of a path has its host's posterior, that of a host the global prior.
4. A document's log odds are its path's posterior log odds plus its own evidence; it is kept below
   ``threshold``.

In ``documents`` the host is ``source`` and the path within it ``lang``; both are parameters.

What reaches the driver has fixed size: the bucket counts (2^18 rows at most), the sample and one row
of moments. A host with a third of all rows is pre-aggregated in its tasks and split in the join.

Defined results: null text counts as empty; null host or path is a site of its own; without usable
labels every document is kept with probability 0. Repeated rows get each a row; of labels that
repeat an id, the worst counts. An empty table gives an empty result. Other columns are kept by
``drop_bad`` and not read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, drop_table, materialize, sample_of, table, without
from .shingles import SMALL_BLOCK, Hasher, blocks, mix, utf8

TABLES, BITS = 2, 18
SIZE = 1 << BITS
#: Kinds of ASCII bytes whose shares are features; the rest of the printable signs is one kind.
KINDS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\n\r\x0b\x0c", ".,;:'\"()-?", "!", "|", "<>[]{}=/\\_")
N_SHAPE = len(KINDS) + 2 + 4
N_WORDS = 4


def _kind_table() -> np.ndarray:
    kinds = np.full(256, len(KINDS), np.int64)
    kinds[128:] = len(KINDS) + 1
    for k, signs in enumerate(KINDS):
        kinds[list(signs.encode())] = k
    return kinds


class Features:
    """Letter words and text shape of many documents at a time."""

    def __init__(self) -> None:
        self.letters = Hasher()
        self.letters.space = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
        self.words = Hasher()
        self.kinds = _kind_table()
        self.salts = mix(np.arange(1, TABLES + 1, dtype=np.uint64))

    def buckets(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, bucket in each table) of each distinct letter word of each row."""
        hashes, at = self.letters.words_of(data, offsets)
        parts = [np.unique(hashes[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        rows = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        joined = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        return rows, np.stack([(mix(joined ^ s) >> np.uint64(64 - BITS)).astype(np.int64) for s in self.salts])

    def shape(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n, sizes = len(offsets) - 1, np.diff(offsets)
        out = np.zeros((n, N_SHAPE))
        width = len(KINDS) + 2
        rows = np.repeat(np.arange(n) * width, sizes)
        counts = np.bincount(rows + self.kinds[data], minlength=n * width).reshape(n, width)
        out[:, :width] = counts / np.maximum(sizes, 1)[:, None]
        hashes, at = self.words.words_of(data, offsets)
        for r, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
            words = b - a
            distinct = len(np.unique(hashes[a:b]))
            lines = data[offsets[r]:offsets[r + 1]].tobytes().split(b"\n")
            out[r, width:] = (np.log1p(words), 1 - distinct / max(words, 1), sizes[r] / max(words, 1) / 10,
                              1 - len(set(lines)) / len(lines))
        return out


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """(id, bad) of the usable labels, one row per id, as a written table."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(1)).when(
        F.col("quality").isNotNull() | F.col("toxic").isNotNull(), F.lit(0))
    rows = labels.select(F.col(id_col).alias("id"), bad.alias("bad")).where("id is not null and bad is not null")
    return materialize(rows.groupBy("id").agg(F.max("bad").alias("bad")))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of every bucket in this task: at most TABLES * SIZE rows."""
    features = Features()
    counts = np.zeros((2, TABLES, SIZE), np.int64)
    rows_of = np.zeros(2, np.int64)
    for batch in batches:
        data, offsets = utf8(batch.column(0))
        bad = batch.column(1).to_numpy()
        for first, end in blocks(offsets, SMALL_BLOCK):
            part = offsets[first:end + 1]
            rows, buckets = features.buckets(data[part[0]:part[-1]], part - part[0])
            label = bad[first:end]
            rows_of += np.bincount(label, minlength=2)
            for kind in (0, 1):
                here = buckets[:, label[rows] == kind]
                for t in range(TABLES):
                    np.add.at(counts[kind, t], here[t], 1)
    t, bucket = np.nonzero(counts.sum(axis=0))
    yield pa.RecordBatch.from_arrays([
        pa.array(np.append(t * SIZE + bucket, -1)), pa.array(np.append(counts[0, t, bucket], rows_of[0])),
        pa.array(np.append(counts[1, t, bucket], rows_of[1]))], names=["bucket", "good", "bad"])


def word_weights(counts: list[tuple[int, int, int]]) -> np.ndarray:
    """The log ratio of the bucket's frequency in bad and good documents where it is significant, else 0."""
    weights = np.zeros(TABLES * SIZE, np.float32)
    if not counts:
        return weights
    bucket, good, bad = np.array(counts, np.float64).T
    totals = bucket == -1
    n_good, n_bad = good[totals].sum(), bad[totals].sum()
    if not n_good or not n_bad:
        return weights
    bucket, good, bad = bucket[~totals].astype(np.int64), good[~totals], bad[~totals]
    share = (good + bad) / (n_good + n_bad)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n_good + 1 / n_bad))
    z = (bad / n_bad - good / n_good) / spread
    ratio = np.log((bad + 0.5) / (n_bad + 1)) - np.log((good + 0.5) / (n_good + 1))
    weights[bucket] = np.where((z >= 4) & (bad >= 3) & (ratio >= 1), ratio, 0)
    return weights


def _describe(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        tables = weights.reshape(TABLES, SIZE)
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for first, end in blocks(offsets, SMALL_BLOCK):
                part = offsets[first:end + 1]
                own, at = data[part[0]:part[-1]], part - part[0]
                rows, buckets = features.buckets(own, at)
                weight = np.minimum.reduce([tables[t][buckets[t]] for t in range(TABLES)]).astype(np.float64)
                marked = np.flatnonzero(weight)
                n = end - first
                most, total = np.zeros(n), np.bincount(rows[marked], weight[marked], minlength=n)
                np.maximum.at(most, rows[marked], weight[marked])
                kinds = np.bincount(rows[marked], minlength=n)
                distinct = np.bincount(rows, minlength=n)
                words = np.stack([most, np.log1p(total), np.log1p(kinds), total / np.sqrt(np.maximum(distinct, 1))], axis=1)
                x = np.concatenate([features.shape(own, at), words], axis=1).astype(np.float32)
                flat = pa.array(x.reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1]), flat)
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(first, n) for i in range(1, 4)] + [lists],
                                                 names=["id", "host", "path", "x"])
    return run


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights (standardised features folded in) and intercept of a ridge logistic regression, by Newton steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.concatenate([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))], axis=1)
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return np.concatenate([w[:-1] / scale, [w[-1] - (w[:-1] * mean / scale).sum()]])


def prior_weight(groups: DataFrame, prior: str) -> float:
    """How many rows the prior counts for, from all groups' (n, bad, prior) moments."""
    # between-group variance of the shares, less what sampling explains (weights n)
    share = F.col("bad") / F.col("n")
    one = groups.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(share - F.col(prior), F.lit(2))).alias("spread"),
                     F.sum(F.col(prior) * (1 - F.col(prior))).alias("noise"),
                     F.sum(F.col("n") * F.col(prior) * (1 - F.col(prior))).alias("whole")).first()
    n = one.n or 0
    variance = max(((one.spread or 0.0) - (one.noise or 0.0)) / n, 0.0) if n else 0.0
    inside = (one.whole or 0.0) / n if n else 0.0
    return min(max(inside / variance - 1 if variance > 0 else 1e6, 2.0), 1e6)


def shrunk(groups: DataFrame, prior: str, name: str, keys: list[str]) -> DataFrame:
    """Groups (n, bad, prior) with posterior mean ``name``."""
    m = prior_weight(groups, prior)
    return groups.withColumn(name, (F.col("bad") + m * F.col(prior)) / (F.col("n") + m)).select(*keys, name)


def _of_others(n, bad, own, prior, m: float):
    """A group's posterior mean without one of its rows, which counts ``own``."""
    return (F.greatest(bad - own, F.lit(0.0)) + m * prior) / (n - 1 + m)


def assess(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
           path_col: str = "lang", *, max_sample: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """One row per document: ``id_col``, evidence, host_posterior, path_posterior, p_bad, kept."""
    labelled = _labelled(docs, labels, id_col)
    side = F.broadcast(labelled) if labelled.count() <= BROADCAST_ROWS else labelled
    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
                       F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"))
    known = thin.select("id", "text").join(side, "id").select("text", F.col("bad").cast("long").alias("bad"))
    counted = known.mapInArrow(_count_words, "bucket long, good long, bad long").groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    weights = word_weights([tuple(r) for r in counted.where("bad >= 3 or bucket = -1").toLocalIterator()])  # at most 2^19 rows
    described = materialize(thin.select("text", "id", "host", "path").mapInArrow(
        _describe(weights), "id long, host string, path string, x array<float>").join(side, "id", "left"))

    known = described.where("bad is not null")
    sample = sample_of(known, "id", max_sample).orderBy("id", "x").select("x", "bad").collect()
    x, y = np.array([r.x for r in sample], float).reshape(len(sample), N_SHAPE + N_WORDS), np.array([r.bad for r in sample], float)
    usable = 0 < y.sum() < len(y)
    model = fit_logistic(x, y) if usable else np.zeros(N_SHAPE + N_WORDS + 1)
    base = y.mean() if usable else 0.0
    offset = float(np.log(base / (1 - base))) if usable else 0.0
    dot = F.aggregate(F.zip_with("x", F.array(*[F.lit(float(w)) for w in model[:-1]]), lambda a, b: a.cast("double") * b),
                      F.lit(0.0), lambda a, b: a + b)
    evidence = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), dot + float(model[-1]) - offset))
    scored = materialize(described.select("id", "host", "path", "bad", evidence.alias("evidence")))
    soft = F.coalesce(F.col("bad").cast("double"), 1 / (1 + F.exp(-(F.col("evidence") + offset))) if usable else F.lit(0.0))
    paths = materialize(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(soft).alias("bad")))
    whole = paths.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    prior = (whole.bad or 0.0) / whole.n if whole.n else 0.0
    hosts = materialize(paths.groupBy("host").agg(F.sum("n").alias("n_host"), F.sum("bad").alias("bad_host")))
    of_host = hosts.select("host", F.col("n_host").alias("n"), F.col("bad_host").alias("bad"), F.lit(prior).alias("prior"))
    host_weight = prior_weight(of_host, "prior")
    with_hosts = paths.join(shrunk(of_host, "prior", "host_posterior", ["host"]), "host")
    path_weight = prior_weight(with_hosts, "host_posterior")
    sites = materialize(paths.join(hosts, "host"))
    n = F.lit(whole.n or 0)
    out = scored.withColumn("own", soft).join(sites.withColumnRenamed("bad", "bad_path"), ["host", "path"])
    out = out.withColumn("others", F.when(n > 1, _of_others(n, F.lit(whole.bad or 0.0), F.col("own"), F.lit(0.0), 0.0)).otherwise(F.lit(prior)))
    out = out.withColumn("host_posterior", _of_others(F.col("n_host"), F.col("bad_host"), F.col("own"), F.col("others"), host_weight))
    out = out.withColumn("path_posterior", _of_others(F.col("n"), F.col("bad_path"), F.col("own"), F.col("host_posterior"), path_weight))
    odds = F.least(F.greatest(F.col("path_posterior"), F.lit(1e-6)), F.lit(1 - 1e-6))
    out = out.withColumn("p_bad", 1 / (1 + F.exp(-(F.log(odds / (1 - odds)) + F.col("evidence")))) if usable else F.lit(0.0))
    for old in (labelled, described, paths, hosts):
        drop_table(old)
    return out.select(F.col("id").alias(id_col), "evidence", "host_posterior", "path_posterior", "p_bad", (F.col("p_bad") < threshold).alias("kept"))


def drop_bad(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents, with all their columns, that the classifier keeps."""
    judged = assess(docs, labels, id_col, **options)
    return without(docs, judged.where("not kept").select(id_col), id_col)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
