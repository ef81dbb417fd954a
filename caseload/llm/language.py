"""Operator 5, language identification: a linear-chain conditional random field over the words of a text.

Words are runs of letters (all bytes but the ASCII ones that are no letters). A word's features are
its affixes (first and last 1 to 4 bytes) and byte trigrams with word ends, hashed, and its lexicon
entry: the log frequency ratio of the word in each language's learning texts. Transition weights
between the languages of neighbouring words are learned with them. Forward-backward gives every
word's posterior, so passages in other languages inside a text are labelled on their own. A
document's language is the one with the largest expected number of letter words, the score its share.

* The lexicon counts the words of all learning documents: dense counts per task in 2^``BITS`` buckets,
  added up by Spark, so at most that many rows reach the driver.
* The field is fitted on the driver by stochastic gradient ascent of the conditional likelihood, on at
  most ``max_sample`` documents, equally many of each language (smallest id hashes), of at most ``SAMPLE_WORDS`` words each from
  anywhere in the text. Code-switched training sequences are spliced from documents of several languages,
  so the transitions see switches.
* Prediction reads every whole text once, without a shuffle; memory is bounded by blocks of text.

Learning documents are those whose ``crc32(id as text) mod 3`` is not 1 and whose language is known;
no other column is used, and none but the text predicts. The number of languages should be small
(the model has a weight per feature and language).

Defined results: ``und`` with score 0 for null texts, texts without a letter, and whenever nothing could
be learned. Repeated rows get each a row; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table
from .shingles import Hasher, blocks, mix, utf8

BITS = 18
SIZE = 1 << BITS
AFFIXES = 4
SAMPLE_WORDS = 256
_SEED = np.uint64(0x2545F4914F6CDD1D)
_LETTER = re.compile(r"[^\W\d_]")


def held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3)) == 1


class Words:
    """Words of many texts and their hashed features."""

    def __init__(self) -> None:
        self.hasher = Hasher()
        self.hasher.space = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
        self.value = self.hasher.value.copy()

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, hashes) of all words and each row's offsets in them."""
        n = len(data)
        if not n:
            none = np.empty(0, np.int64)
            return none, none, np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
        letter = ~self.hasher.space[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        starts = np.flatnonzero(letter & (~np.append(True, letter[:-1]).astype(bool) | edge[:n] | (np.arange(n) == 0)))
        ends = np.flatnonzero(letter & (~np.append(letter[1:], False) | edge[1:])) + 1
        hashes, at = self.hasher.words_of(data, offsets)
        return starts, ends, hashes, at

    def features(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Affix buckets (words x 2 AFFIXES), trigram buckets of all words and each word's offsets in them."""
        value = self.value[data]
        n = len(data)
        sizes = ends - starts
        affixes = np.empty((len(starts), 2 * AFFIXES), np.int64)
        head, tail = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
        for k in range(AFFIXES):
            inside = sizes > k
            head = np.where(inside, head * np.uint64(257) + value[np.minimum(starts + k, n - 1)], head)
            tail = np.where(inside, tail * np.uint64(257) + value[np.maximum(ends - 1 - k, 0)], tail)
            for column, code, kind in ((k, head, 1), (AFFIXES + k, tail, 2)):
                affixes[:, column] = mix(code * _SEED + np.uint64(8 * kind + k)) >> np.uint64(64 - BITS)
        # trigrams centred on each byte of a word; beyond the word's ends the value is 0
        at = np.concatenate([[0], np.cumsum(sizes)])
        centre = np.arange(at[-1]) - np.repeat(at[:-1] - starts, sizes)
        left = np.where(centre == np.repeat(starts, sizes), np.uint64(0), value[np.maximum(centre - 1, 0)])
        right = np.where(centre == np.repeat(ends - 1, sizes), np.uint64(0), value[np.minimum(centre + 1, n - 1)])
        code = (left * np.uint64(512) + value[centre]) * np.uint64(512) + right
        return affixes, (mix(code * _SEED) >> np.uint64(64 - BITS)).astype(np.int64), at


def lexicon_bucket(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes ^ _SEED) >> np.uint64(64 - BITS)).astype(np.int64)


class Field:
    """The conditional random field; weights are plain arrays."""

    def __init__(self, languages: list[str], lexicon: np.ndarray):
        n = len(languages)
        self.languages, self.lexicon = languages, lexicon
        self.affix = np.zeros((SIZE, n), np.float32)
        self.gram = np.zeros((SIZE, n), np.float32)
        self.scale = np.full(n, 0.5, np.float32)  # of the lexicon entries
        self.bias = np.zeros(n, np.float32)
        self.step = np.zeros((n, n), np.float32)

    def emissions(self, words: Words, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        n = len(self.languages)
        if not len(starts):
            return np.zeros((0, n), np.float32)
        affixes, grams, at = words.features(data, starts, ends)
        out = self.lexicon[lexicon_bucket(hashes)] * self.scale + self.bias
        for k in range(affixes.shape[1]):
            out += self.affix[affixes[:, k]]
        out += np.add.reduceat(self.gram[grams], at[:-1], axis=0) / np.sqrt(at[1:] - at[:-1])[:, None].astype(np.float32)
        return out

    def posteriors(self, scores: np.ndarray, at: np.ndarray, expected: np.ndarray | None = None) -> np.ndarray:
        """Each word's posterior by forward-backward over every row's words; rows run in step.

        ``expected``, if given, receives the expected transition counts.
        """
        e = np.exp(scores - scores.max(axis=1, keepdims=True)) + np.float32(1e-12)
        a = np.exp(self.step - self.step.max())
        sizes = np.diff(at)
        order = np.argsort(-sizes, kind="stable")
        first, sizes = at[:-1][order], sizes[order]
        active = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), side="right")
        forward = np.empty_like(e)
        state = None
        for t, k in enumerate(active.tolist()):
            i = first[:k] + t
            state = e[i] if t == 0 else (state[:k] @ a) * e[i]
            state /= state.sum(axis=1, keepdims=True)
            forward[i] = state
        out = forward
        back = np.ones((len(sizes), e.shape[1]), e.dtype)
        for t in range(len(active) - 1, -1, -1):
            k = int(active[t])
            i = first[:k] + t
            known = int(active[t + 1]) if t + 1 < len(active) else 0
            if known:
                j = i[:known] + 1
                ahead = e[j] * back[:known]
                if expected is not None:
                    pair = forward[i[:known]][:, :, None] * a * ahead[:, None, :]
                    expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                behind = ahead @ a.T
                back[:known] = behind / behind.sum(axis=1, keepdims=True)
            if expected is None:
                post = forward[i] * back[:k]
                out[i] = post / post.sum(axis=1, keepdims=True)
        if expected is not None:
            post = _back_all(e, a, first, sizes, active) * forward
            out = post / post.sum(axis=1, keepdims=True)
        return out


def _back_all(e: np.ndarray, a: np.ndarray, first: np.ndarray, sizes: np.ndarray, active: np.ndarray) -> np.ndarray:
    """The backward messages of every word."""
    out = np.ones_like(e)
    for t in range(len(active) - 2, -1, -1):
        j = first[:int(active[t + 1])] + t + 1
        message = (e[j] * out[j]) @ a.T
        out[j - 1] = message / message.sum(axis=1, keepdims=True)
    return out


def _encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def spliced(samples: list[tuple[str, list[bytes]]], languages: list[str], rng: np.random.Generator, rows: int,
            length: int = 48) -> tuple[list[bytes], np.ndarray]:
    """Sequences of words, half of them code-switched, and their labels."""
    texts, labels = [], []
    number = {lang: i for i, lang in enumerate(languages)}
    for _ in range(rows):
        pieces = 1 if rng.random() < 0.5 else int(rng.integers(2, 5))
        left = length
        for p in range(pieces):
            lang, words = samples[int(rng.integers(len(samples)))]
            take = left if p == pieces - 1 else int(rng.integers(1, max(2, left - (pieces - p - 1))))
            begin = int(rng.integers(max(1, len(words) - take + 1)))
            part = words[begin:begin + take]
            texts += part
            labels += [number[lang]] * len(part)
            left -= take
        texts.append(b"")  # ends the sequence
        labels.append(-1)
    return texts, np.array(labels)


def fit(samples: list[tuple[str, list[bytes]]], languages: list[str], lexicon: np.ndarray, *, rounds: int = 60,
        rows: int = 160, rate: float = 0.3, decay: float = 1e-4) -> Field:
    """Stochastic gradient ascent (per-weight adaptive rates) of the conditional log likelihood."""
    field, words, rng = Field(languages, lexicon), Words(), np.random.default_rng(7)
    n = len(languages)
    eye = np.eye(n, dtype=np.float32)
    squares = {name: np.full_like(getattr(field, name), 1e-2) for name in ("affix", "gram", "scale", "bias", "step")}

    def ascend(name: str, gradient: np.ndarray, where=slice(None)) -> None:
        weight, square = getattr(field, name), squares[name]
        gradient = gradient - decay * weight[where]
        square[where] += gradient ** 2
        weight[where] += rate * gradient / np.sqrt(square[where])

    for _ in range(rounds):
        texts, labels = spliced(samples, languages, rng, rows)
        stops = np.flatnonzero(labels < 0)
        labels = labels[labels >= 0]
        at = np.concatenate([[0], stops - np.arange(len(stops))])
        tokens = [t for t in texts if t]
        data, offsets = _encode([t + b" " for t in tokens])
        starts, ends, hashes, _ = words.spans(data, np.array([0, len(data)]))
        scores = field.emissions(words, data, starts, ends, hashes)
        expected = np.zeros((n, n), np.float32)
        post = field.posteriors(scores, at, expected)
        inner = np.ones(len(labels), bool)
        inner[at[1:-1]] = False
        inner[0] = False
        pairs = np.flatnonzero(inner)
        seen = np.zeros((n, n), np.float32)
        np.add.at(seen, (labels[pairs - 1], labels[pairs]), 1)
        gap = (eye[labels] - post).astype(np.float32)
        affixes, grams, spans = words.features(data, starts, ends)
        share = len(labels)
        flat = affixes.reshape(-1)
        used, inverse = np.unique(flat, return_inverse=True)
        spread = np.repeat(gap, affixes.shape[1], axis=0)
        ascend("affix", np.stack([np.bincount(inverse, spread[:, c], len(used)) for c in range(n)], axis=1).astype(np.float32) / share * 50, used)
        used, inverse = np.unique(grams, return_inverse=True)
        sizes = spans[1:] - spans[:-1]
        spread = np.repeat(gap / np.sqrt(sizes)[:, None], sizes, axis=0)
        ascend("gram", np.stack([np.bincount(inverse, spread[:, c], len(used)) for c in range(n)], axis=1).astype(np.float32) / share * 50, used)
        ascend("scale", (gap * field.lexicon[lexicon_bucket(hashes)]).sum(axis=0) / share)
        ascend("bias", gap.sum(axis=0) / share)
        ascend("step", (seen - expected) / share)
    return field


def _count(languages: list[str]):
    """Word counts of this task by bucket and language: at most SIZE rows."""
    number = {lang: i for i, lang in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = Words(), np.zeros((len(languages), SIZE), np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            langs = np.array([number[x] for x in batch.column(1).to_pylist()], np.int64)
            for first, end in blocks(offsets):
                part = offsets[first:end + 1]
                _, _, hashes, at = words.spans(data[part[0]:part[-1]], part - part[0])
                lang = np.repeat(langs[first:end], np.diff(at))
                flat = np.bincount(lang * SIZE + lexicon_bucket(hashes), minlength=counts.size)
                counts += flat.reshape(counts.shape)
        bucket = np.flatnonzero(counts.sum(axis=0))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bucket) + 1, dtype=np.int32) * len(languages)),
                                         pa.array(counts[:, bucket].T.reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(bucket), lists], names=["bucket", "counts"])
    return run


def _excerpts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, lang, words): at most SAMPLE_WORDS words from a place that the id decides; rows without a word go."""
    for batch in batches:
        rows = []
        for i, text, lang in zip(*[c.to_pylist() for c in batch.columns]):
            found = [w.encode() for w in re.findall(r"[a-zA-Z\x80-\U0010ffff]+", text)]
            if found:
                begin = zlib.crc32(str(i).encode()) % max(1, len(found) - SAMPLE_WORDS + 1)
                rows.append((i, lang, found[begin:begin + SAMPLE_WORDS]))
        columns = list(zip(*rows)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.list_(pa.binary())))],
                                         names=["id", "lang", "words"])


def _sample(learning: DataFrame, most: int) -> DataFrame:
    """(id, lang, words) of each language's ``most`` documents with a word of the smallest id hashes."""
    worded = learning.where(F.col("text").rlike("[a-zA-Z\\x{80}-\\x{10ffff}]"))
    sizes = {r.lang: r["count"] for r in worded.groupBy("lang").count().collect()}
    place, near = F.pmod(F.xxhash64("id"), F.lit(1 << 31)), F.lit(False)
    enough = most + 6 * most ** 0.5 + 30  # on average: below ``most``, or none, with a chance of about 1e-9
    for lang, size in sizes.items():
        near = near | ((F.col("lang") == lang) & (place < int(min(1.0, enough / size) * (1 << 31))))
    rows = worded.where(near).mapInArrow(_excerpts, "id long, lang string, words array<binary>")
    order = Window.partitionBy("lang").orderBy(place, "id", "words")  # at most about ``enough`` rows of a language
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("rank")


def learn(docs: DataFrame, max_sample: int) -> Field | None:
    """The field learned from (text, lang, id); None without learning documents."""
    learning = docs.where("lang is not null and text is not null").where(~held_out(F.col("id")))
    languages = sorted(r.lang for r in learning.select("lang").distinct().collect())
    if not languages:
        return None
    n = len(languages)
    counted = learning.select("text", "lang").mapInArrow(_count(languages), "bucket long, counts array<long>")
    sums = [F.sum(F.get("counts", F.lit(i))).alias(f"n{i}") for i in range(n)]
    counts = np.zeros((SIZE, n))
    for row in counted.groupBy("bucket").agg(*sums).toLocalIterator():  # at most SIZE rows
        counts[row[0]] = row[1:]
    share = counts / np.maximum(counts.sum(axis=0), 1)
    lexicon = np.log(share + 2e-6)
    lexicon = (lexicon - lexicon.mean(axis=1, keepdims=True)).astype(np.float32)

    chosen = _sample(learning.select("id", "text", "lang"), max(1, max_sample // n))
    samples = [(r.lang, [bytes(w) for w in r.words]) for r in sorted(chosen.collect())]
    if not samples:
        return None
    by_lang = {lang: [s for s in samples if s[0] == lang] for lang in languages}
    most = max(map(len, by_lang.values()))
    even = [own[i % len(own)] for own in by_lang.values() if own for i in range(most)]  # languages weigh alike
    return fit(even, languages, lexicon)


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, field = Words(), model.value
        for batch in batches:
            column = batch.column(1)
            data, offsets = utf8(column)
            for first, end in blocks(offsets, 1 << 22):
                part = offsets[first:end + 1]
                langs, shares = ["und"] * (end - first), np.zeros(end - first)
                if field is not None:
                    own = data[part[0]:part[-1]]
                    starts, ends, hashes, at = words.spans(own, part - part[0])
                    scores = [np.zeros((0, len(field.languages)), np.float32)]
                    for i in range(0, len(starts), 65536):  # so many words at a time
                        s, e = starts[i:i + 65536], ends[i:i + 65536]
                        scores.append(field.emissions(words, own[s[0]:e[-1]], s - s[0], e - s[0], hashes[i:i + 65536]))
                    scores = np.concatenate(scores)
                    post = field.posteriors(scores, at) if len(scores) else scores
                    total = np.concatenate([np.zeros((1, post.shape[1])), np.cumsum(post, axis=0, dtype=np.float64)])
                    sums = total[at[1:]] - total[at[:-1]]
                    best = sums.argmax(axis=1)
                    for r in range(end - first):
                        text = column[first + r].as_py()
                        if text and at[r + 1] > at[r] and _LETTER.search(text):
                            langs[r] = field.languages[best[r]]
                            shares[r] = sums[r, best[r]] / sums[r].sum()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(langs, pa.string()),
                                                  pa.array(np.clip(shares, 0, 1))], names=["id", "lang_pred", "score"])
    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *,
             max_sample: int = 3000) -> DataFrame:
    """One row per document: ``id_col``, held_out, lang_pred, score."""
    thin = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(learn(thin, max_sample))  # fixed size: 2 * 2^18 weights and the lexicon per language
    out = thin.select("id", "text").mapInArrow(_predict(model), "id long, lang_pred string, score double")
    return out.select(F.col("id").alias(id_col), F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
