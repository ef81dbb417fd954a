"""Operator 2: base spans against the plain patterns; the label model on small cases."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from caseload.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def ok(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1]))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def plain(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if ok(k, m.group())]


def base(text):
    return sorted((s for s in pii.matches(text) if pii.passes(s[0], text[s[1]:s[2]])), key=lambda s: (pii.BASE.index(s[0]), s[1]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", "@", ".", "1", "25", "255", "0004", "+", " ", "-", "(", ")", "4539578763621486", "x@y.zz", "é", "\n"]), max_size=30))
def test_base_spans_equal_the_patterns(parts):
    text = "".join(parts)
    assert base(text) == plain(text)


def row(frame, doc):
    return frame.where(f"doc_id = {doc}").first()


def test_documents(spark, docs_of):
    text = "héllo a.b@mail.example.com, ip 10.0.0.255 not 10.0.0.256; card 4539 5787 6362 1486, call +1 (017) 555-7713."
    secret = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" here'
    rows = [(1, text), (2, None), (3, ""), (4, secret), (5, text), (6, "licensed under version 2.0. of 1999"), (7, "9" * 50_000), (8, "a" * 50_000 + "@")]
    rows += [(100 + i, f'a token = "{hashlib.sha1(bytes([i])).hexdigest()}" b') for i in range(40)]
    out = pii.personal_data(docs_of(rows)).cache()
    assert out.count() == len(rows)
    one = row(out, 1)
    assert (one.n_email, one.n_ip, one.n_card, one.n_phone) == (1, 1, 1, 1)
    listed = ",".join(f"{k}:{a}:{b}" for k, a, b in plain(text))
    assert one.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
    assert one.spans.startswith(listed.split(",")[0])
    assert set(listed.split(",")) <= set(one.spans.split(","))
    assert row(out, 2).spans == row(out, 3).spans == row(out, 6).spans == ""
    assert row(out, 2).base_sha256 == hashlib.sha256(b"").hexdigest()
    assert row(out, 4).spans == f"secret:{secret.index('04')}:{secret.index('f962') + 4}"
    assert row(out, 5).spans == one.spans
    assert pii.personal_data(docs_of([])).count() == 0


def test_em_prefers_agreeing_labelers():
    found = pii.posteriors([("secret", "0+0+++", 90), ("secret", "0-0---", 60), ("secret", "0+0-+-", 5)])
    assert found["secret", "0+0+++"] > 0.9 and found["secret", "0-0---"] < 0.1


def test_a_labeler_is_judged_by_kind_and_abstaining_says_nothing():
    # the gazetteer contradicts the others on emails and agrees with them on phones
    counts = [("email", "++-+++", 50), ("email", "--+---", 50), ("phone", "++++++", 50), ("phone", "------", 50),
              ("email", "00+000", 1), ("phone", "00+000", 1), ("phone", "000000", 1)]
    found = pii.posteriors(counts)
    assert found["phone", "00+000"] > 0.8 and abs(found["email", "00+000"] - 0.5) < 0.1
    assert abs(found["phone", "000000"] - 0.5) < 0.1


def test_the_classifier_reads_no_votes():
    seen = {pii.votes("my " + body + " x", ("email", 3, 3 + len(body)), known)[1] for body in ["ab@cd"] for known in (set(), {("email", 3, 8)})}
    assert len(seen) == 1


def planted():
    """Documents with the spans that a reader would add to the base spans, and look-alikes."""
    docs, truth = [], set()

    def add(left, body, right, kind):
        docs.append((len(docs) + 1, left + body + right))
        if kind:
            truth.add((len(docs), f"{kind}:{len(left)}:{len(left) + len(body)}"))

    for i in range(120):
        digest = hashlib.sha256(bytes([i])).hexdigest()
        add(f'entry {"api key" if i % 2 else "token"} = "', digest[: 32 + i % 9], '" end', "secret")
        add("see part ", f"{digest[:8]}-chapter-one-of-{digest[9]}-many", " there", None)
        add("please call ", f"(0{20 + i}) {200 + i}-{4000 + 7 * i}", " today", "phone")
        add("on page ", f"{20 + i}.{100 + i}.{1000 + i}", " of it", None)
        add("said by ", ("Mary", "Hans", "José")[i % 3] + " " + ("Keller", "Novak", "Brandt")[i // 3 % 3], " then", "person")
        add("left at ", "noon@" + ("home", "work")[i % 2], " again", None)
        add("written to ", f"user{i}@mail.example.com", " once", None)  # a base span: never added
        add("account ", f"card 4539 5787 6362 {1480 + i % 6}", "", None)
    return docs, truth


def test_precision_and_recall_of_added_spans(docs_of):
    docs, truth = planted()
    added = set()
    for r in pii.personal_data(docs_of(docs)).collect():
        text = dict(docs)[r.doc_id]
        fixed = {f"{k}:{a}:{b}" for k, a, b in plain(text)}
        added |= {(r.doc_id, s) for s in r.spans.split(",") if s and s not in fixed}
    hit = len(added & truth)
    assert hit / len(added) >= 0.95 and hit / len(truth) >= 0.95


def test_near_miss_with_a_long_local_part_is_whole(docs_of):
    text = "x " + "a" * 5000 + "@host"
    assert pii.candidates(text, pii.matches(text), None) == [("email", 2, len(text))]
