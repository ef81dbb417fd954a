"""Operator 2, personal data: weak-supervision aggregation of regex, gazetteer and context labelers.

1. Base spans: the fixed patterns of ``email``, ``ip``, ``card`` and ``phone`` with their checks.
2. Candidates: the base spans and whatever resembles personal data: near misses of those patterns,
   other long digit groups, long mixed tokens (``secret``) and titled or known names (``person``).
   Six labelers vote on each, for (+), against (-) or not at all (0): base pattern, loose shape,
   gazetteer (top-level domains, country codes, given names, key words), context cue to the left,
   borders, and checksum or composition.
3. Reliabilities: candidates are counted by kind and votes over all documents (grouped aggregation; at most 6 x 3^6
   rows, which go to the driver). For each kind expectation-maximisation estimates how often every labeler that votes is
   right, on personal and on other spans, and the kind's prior, hence a posterior for every combination of votes.
   Abstaining says nothing.
4. Span classifier: a logistic regression for each kind on features of the span and its surroundings (length, digits,
   case, separators, checksum, the signs on both sides, the word before), never on votes. It is fitted to all candidates, grouped by
   features (at most 6 x 96,000 rows) with the sum of their posteriors. Candidates at ``threshold`` or more that
   overlap no base span are added.

Texts are read once, without a shuffle; only spans, not texts, are written in between.

Offsets are code points, ends exclusive. Defined results: null text counts as empty; documents without
spans have counts 0 and an empty list; repeated rows get each a row; an empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, task_cache

#: The base kinds in their order; the added kinds follow.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "person")
#: Gazetteers.
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "it", "nl", "ch", "at", "be", "ca", "us")
COUNTRY_CODES = ("1", "7", "33", "34", "39", "41", "43", "44", "49", "52", "54", "55", "61", "81", "86", "91")
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Señor", "Señora", "Monsieur", "Madame")
GIVEN_NAMES = (
    "James", "John", "Robert", "Michael", "William", "David", "Richard", "Thomas", "Mary", "Patricia", "Jennifer", "Linda",
    "Elizabeth", "Susan", "Jessica", "Sarah", "Hans", "Peter", "Klaus", "Jürgen", "Ursula", "Monika", "Jean", "Pierre", "Michel",
    "François", "Marie", "Nathalie", "Isabelle", "José", "Antonio", "Manuel", "Carmen", "María", "Dolores", "Ahmed", "Mohammed", "Fatima",
)
CUES = {
    "email": ("mail", "e-mail", "contact", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "addr", "from"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta", "account", "iban"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "telefon", "teléfono", "téléphone"),
    "secret": ("token", "key", "secret", "password", "passwd", "pwd", "auth", "bearer"),
    "person": ("name", "by", "from", "contact", "dear", "señor", "herr"),
}
AGAINST = ("version", "license", "isbn", "page", "chapter", "section", "figure", "table", "copyright")

#: How often each labeler is first taken to be right: fixed pattern, shape, gazetteer, context, borders, check.
TRUST = (0.95, 0.8, 0.7, 0.8, 0.6, 0.6)
#: The same for kinds whose check is exact (checksum, value range).
TRUST_EXACT = (*TRUST[:-1], 0.95)
#: Votes that this first estimate counts for.
TRUST_VOTES = 5.0

#: The values of each feature of a span, in the order of its string.
FEATURES = ("01234", "0123", "wqlao", "wqlao", "ulmn", "0123", "+-0", "cnw0")

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9][0-9\x20.()-]*")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
WORD = re.compile(r"[A-Za-z0-9_-]*")
SURNAME = re.compile(r"\.?\x20[A-ZÀ-Þ][a-zß-ÿ]+")
WORD_LIKE = re.compile(r"[a-z]{7}|[A-Z]{7}")
LEFT_WORD = re.compile(r"[^\W\d_]+")

Span = tuple[str, int, int]


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def small_parts(ip: str) -> bool:
    """All parts at most 255."""
    parts = [p.lstrip("0") for p in ip.split(".")]
    return all(len(p) < 4 and int(p or 0) <= 255 for p in parts)


def matches(text: str) -> list[Span]:
    """Matches of the four base patterns, checked or not, leftmost and non-overlapping by kind."""
    found = []
    at, free = text.find("@"), 0
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if domain and start < at:
            free = domain.end()
            found.append(("email", start, free))
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)
    at = text.find("+")
    while at >= 0:
        phone = PHONE.match(text, at)
        if phone:
            found.append(("phone", *phone.span()))
        at = text.find("+", phone.end() if phone else at + 1)
    for chunk in DIGITS.finditer(text):  # holds every ip and card that meets it
        if chunk.end() - chunk.start() > 6:
            first = chunk.start()
            part = chunk.group()
            found += [("ip", first + m.start(), first + m.end()) for m in IP.finditer(part)]
            found += [("card", first + m.start(), first + m.end()) for m in CARD.finditer(part)]
    return found


def passes(kind: str, match: str) -> bool:
    if kind == "ip":
        return small_parts(match)
    if kind == "card":
        digits = digits_of(match)
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits_of(match)) <= 15
    return True


def candidates(text: str, found: list[Span], names) -> list[Span]:
    """Spans that resemble personal data, base matches among them."""
    out = {s for s in found if s[0] != "card" or len(digits_of(text[s[1]:s[2]])) >= 11}
    addressed = {text.index("@", a) for k, a, _ in found if k == "email"}
    at = text.find("@")
    while at >= 0:
        if 0 < at < len(text) - 1 and text[at - 1] in LOCAL and at not in addressed:
            start, stop = at, WORD.match(text, at + 1).end()
            while start and text[start - 1] in LOCAL:
                start -= 1
            if stop > at + 1:
                out.add(("email", start, stop))
        at = text.find("@", at + 1)
    token_end = -1
    for chunk in DIGITS.finditer(text):
        start, stop = chunk.span()
        if start >= token_end:  # a long token around these digits
            begin = start
            while begin and begin > token_end and (text[begin - 1].isascii() and (text[begin - 1].isalnum() or text[begin - 1] in "_-")):
                begin -= 1
            token_end = WORD.match(text, start).end()
            if token_end - begin >= 20 and not text[begin:token_end].isdigit():
                out.add(("secret", begin, token_end))
        part = chunk.group().rstrip(" .()-")
        if 7 <= len(digits_of(part)) <= 12 and len(part) <= 24 and start >= token_end - len(part):
            opened = ")" in part and text[start - 1:start] == "("
            out.add(("phone", start - opened, start + len(part)))
    for end, (name, kind) in names.iter(text) if names is not None else ():
        begin = end - len(name) + 1
        after = SURNAME.match(text, end + 1)
        if after and (not begin or not text[begin - 1].isalnum()):
            out.add(("person", begin, after.end()))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def votes(text: str, span: Span, base: set[Span]) -> tuple[str, str]:
    """The labelers' votes (+, -, 0) and the discrete features of a candidate."""
    kind, start, end = span
    body, left, right = text[start:end], text[max(0, start - 1):start], text[end:end + 1]
    digits = digits_of(body)
    before = [w.lower() for w in LEFT_WORD.findall(text[max(0, start - 32):start])][-3:]
    sign = lambda good, bad=False: "+" if good else "-" if bad else "0"
    pattern = sign(span in base, kind in BASE)
    if kind == "card":
        shape = sign(len(digits) == 16 and len(body) in (16, 19), len(digits) < 13 or len(digits) > 19)
    elif kind == "phone":
        shape = sign(body.startswith("+") or re.fullmatch(r"\(?[0-9]{3,5}\)?[ .-]+[0-9]{3}[ .-]?[0-9]{2,5}", body) is not None, body.isdigit() or "." in body)
    elif kind == "secret":
        shape = sign(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", body) is not None, "-" in body)
    else:
        shape = sign(kind != "person" or body.count(" ") >= 1)
    if kind == "email":
        gazetteer = sign(body.rpartition(".")[2].lower() in DOMAINS, "." not in body.rpartition("@")[2])
    elif kind == "phone":
        gazetteer = sign(body.startswith("+") and any(digits.startswith(c) for c in COUNTRY_CODES))
    elif kind == "person":
        gazetteer = sign(body.split(" ")[0] in GIVEN_NAMES)
    else:
        gazetteer = "0"
    context = sign(any(w in CUES[kind] for w in before), any(w in AGAINST for w in before))
    apart = not (left.isalnum() or right.isalnum())
    border = sign(apart, not apart)
    if kind == "card":
        check = sign(13 <= len(digits) <= 19 and luhn(digits), True)
    elif kind == "ip":
        check = sign(small_parts(body), True)
    elif kind == "secret":
        check = sign(6 <= len(digits) < len(body) - 2 and not WORD_LIKE.search(body), True)
    elif kind == "phone":
        check = sign(9 <= len(digits) <= 15, True)
    else:
        check = "0"
    word = "0" if not before else "c" if context == "+" else "n" if context == "-" else "w"
    case = "u" if body.isupper() else "l" if body.islower() else "m" if body.lower() != body.upper() else "n"
    feature = (f"{min(len(body) // 8, 4)}{min(3, 4 * len(digits) // len(body))}{_side(left)}{_side(right)}{case}"
               f"{min(3, sum(map(body.count, ' .-()')))}{check}{word}")
    return pattern + shape + gazetteer + context + border + check, feature


def _side(sign: str) -> str:
    """Class of the character beside a span: white space or none, quote, label, alphanumeric, other."""
    if not sign or sign.isspace():
        return "w"
    return "q" if sign in "\"'`" else "l" if sign in ":=" else "a" if sign.isalnum() else "o"


def _gazetteer():
    cache = task_cache()
    if "names" not in cache:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for kind, words in (("title", TITLES), ("name", GIVEN_NAMES)):
            for word in words:
                automaton.add_word(word, (word, kind))
        automaton.make_automaton()
        cache["names"] = automaton
    return cache["names"]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("votes", pa.string()), ("feature", pa.string())])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = _gazetteer()
    for batch in batches:
        for first in range(0, batch.num_rows, 1000):
            part = batch.slice(first, 1000)
            base_lists, span_lists = [], []
            for text in part.column(1):
                text = text.as_py() or ""
                found = matches(text)
                base = sorted((s for s in found if passes(s[0], text[s[1]:s[2]])), key=lambda s: (BASE.index(s[0]), s[1]))
                known = set(base)
                spans = []
                for span in candidates(text, found, names):
                    vote, feature = votes(text, span, known)
                    spans.append({"kind": span[0], "start": span[1], "end": span[2], "votes": vote, "feature": feature})
                base_lists.append([{"kind": k, "start": a, "end": b, "votes": None, "feature": None} for k, a, b in base])
                span_lists.append(spans)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(base_lists, pa.list_(_SPAN)), pa.array(span_lists, pa.list_(_SPAN))],
                                             names=["id", "base", "spans"])


def posteriors(patterns: list[tuple[str, str, int]], rounds: int = 100) -> dict[tuple[str, str], float]:
    """Posterior of (kind, votes) by expectation-maximisation over counted patterns (kind, votes, n), kind by kind."""
    out = {}
    for kind in sorted({k for k, _, _ in patterns}):
        rows = [(v, n) for k, v, n in patterns if k == kind]
        yes = np.array([[c == "+" for c in v] for v, _ in rows], float)
        no = np.array([[c == "-" for c in v] for v, _ in rows], float)
        n = np.array([c for _, c in rows], float)
        # chance of + when a labeler votes, for other and for personal spans
        trust = np.array(TRUST_EXACT if kind in ("card", "ip") else TRUST)
        first = plus = np.stack([1 - trust, trust])
        prior, post = 0.5, np.full(len(n), 0.5)
        for _ in range(rounds):
            odds = np.log(prior / (1 - prior)) + yes @ np.log(plus[1] / plus[0]) + no @ np.log((1 - plus[1]) / (1 - plus[0]))
            new = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
            moved, post = np.abs(new - post).max(), new
            weight = np.stack([n * (1 - post), n * post])
            prior = (weight[1].sum() + 1) / (n.sum() + 2)
            good, voted = weight @ yes, weight @ (yes + no)
            good, voted = good + TRUST_VOTES * first, voted + TRUST_VOTES
            plus = good / voted
            # a labeler whose votes point the wrong way counts as saying nothing
            plus = np.where(plus[1] < plus[0], good.sum(0) / voted.sum(0), plus)
            if moved < 1e-6:
                break
        out.update({(kind, v): float(p) for (v, _), p in zip(rows, post)})
    return out


def _vector(feature: str) -> np.ndarray:
    out = np.zeros(sum(map(len, FEATURES)) + 1)
    at = 0
    for value, values in zip(feature, FEATURES):
        out[at + values.index(value)] = 1
        at += len(values)
    out[-1] = 1
    return out


def _chance(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))


def train(patterns: list[tuple[str, str, int, float]], ridge: float = 1.0) -> dict[str, np.ndarray]:
    """The span classifier: weights by kind, from (kind, feature, spans, sum of their posteriors)."""
    out = {}
    for kind in sorted({k for k, *_ in patterns}):
        rows = [r[1:] for r in patterns if r[0] == kind]
        x = np.stack([_vector(f) for f, _, _ in rows])
        n = np.array([c for _, c, _ in rows], float)
        y = np.array([t for *_, t in rows]) / n
        w = np.zeros(x.shape[1])
        for _ in range(30):
            p = _chance(x, w)
            curve = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
            step = np.linalg.solve(curve, x.T @ (n * (y - p)) - ridge * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        out[kind] = w
    return out


def _union(spans) -> list[tuple[int, int]]:
    """Disjoint sorted spans that cover the same."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _decide(weights: dict[str, np.ndarray], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], float] = {}  # at most as many as there are features

        def chance(span) -> float:
            key = span["kind"], span["feature"]
            if key not in known:
                known[key] = float(_chance(_vector(key[1]), weights[key[0]]))
            return known[key]

        listed = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        for batch in batches:
            rows = []
            for base, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                base = [(s["kind"], s["start"], s["end"]) for s in base]
                taken = _union((a, b) for _, a, b in base)
                added = []
                for s in sorted(spans, key=lambda s: -chance(s)):
                    if chance(s) < threshold:
                        break
                    at = bisect.bisect(taken, (s["start"], s["end"]))
                    if (at == 0 or taken[at - 1][1] <= s["start"]) and (at == len(taken) or s["end"] <= taken[at][0]):
                        taken.insert(at, (s["start"], s["end"]))
                        added.append((s["kind"], s["start"], s["end"]))
                every = sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1]))
                rows.append((*[sum(s[0] == k for s in base) for k in BASE], hashlib.sha256(listed(base).encode()).hexdigest(), listed(every), len(added)))
            columns = list(zip(*rows)) or [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                                             names=["id", *[f"n_{k}" for k in BASE], "base_sha256", "spans", "n_added"])
    return run


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = 0.5) -> DataFrame:
    """One row per document: ``id_col``, base counts, base_sha256, spans, n_added."""
    span = "array<struct<kind:string,start:long,end:long,votes:string,feature:string>>"
    found = materialize(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _find, f"id long, base {span}, spans {span}"))
    spans = found.select(F.explode("spans").alias("s")).select("s.kind", "s.votes", "s.feature")
    voted = sorted(map(tuple, spans.groupBy("kind", "votes").count().collect()))  # bounded: see the head of the module
    posterior = docs.sparkSession.createDataFrame([(*k, p) for k, p in posteriors(voted).items()], "kind string, votes string, p double")
    grouped = spans.join(F.broadcast(posterior), ["kind", "votes"]).groupBy("kind", "feature").agg(F.count(F.lit(1)), F.sum("p"))
    out = found.mapInArrow(_decide(train(sorted(map(tuple, grouped.collect()))), threshold),  # bounded likewise
                           "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
    return out.withColumnRenamed("id", id_col)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
