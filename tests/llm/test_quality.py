"""Operator 4: planted bad documents, shrinkage, and edge cases."""

import random

import numpy as np
import pyarrow as pa

from caseload.llm import quality


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ba", "co", "di", "fu", "ge", "hi") for b in ("lo", "mi", "na", "pe", "ru", "sta", "ve")]
    bad_words = ["vile", "scumbag"]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(40, 200))]
        kind = rng.random()
        quality_label, toxic = 1, 0
        if kind < 0.15:
            toxic = 1
            for _ in range(4):
                text[rng.randrange(len(text))] = rng.choice(bad_words)
        elif kind < 0.3:
            quality_label = 0
            text = [w.upper() + "!!" for w in text]
        docs.append((i, " ".join(text)))
        labels.append((i, quality_label, toxic))
    return docs, labels


def test_planted_documents(spark, docs_of):
    docs, labels = corpus()
    known = spark.createDataFrame(labels[:400], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality.assess(docs_of(docs), known).collect()}
    assert len(rows) == len(docs)
    for part in (labels[:400], labels[400:]):  # labelled and unseen
        right = [rows[i].kept == (q == 1 and t == 0) for i, q, t in part]
        assert np.mean(right) > 0.97
    kept = quality.drop_bad(docs_of(docs), known)
    assert set(kept.columns) == set(docs_of([]).columns)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.kept}


def test_sparse_sites_stay_near_the_prior(spark):
    rows = [("big", 1000, 500.0, 0.1), ("small", 2, 2.0, 0.1), *[(f"s{i}", 200, 20.0 + i % 5, 0.1) for i in range(50)]]
    groups = spark.createDataFrame(rows, "host string, n long, bad double, prior double")
    post = {r.host: r.p for r in quality.shrunk(groups, "prior", "p", ["host"]).collect()}
    assert post["big"] > 0.4 and 0.1 < post["small"] < 0.5


def plain_posteriors(rows, base):
    """Host and path posterior of each row (host, path, bad or None, evidence), with plain loops over the other rows."""
    offset = np.log(base / (1 - base))
    own = [float(b) if b is not None else 1 / (1 + np.exp(-(e + offset))) for _, _, b, e in rows]

    def weight(groups):  # (n, bad, prior)
        n = sum(g[0] for g in groups)
        between = (sum(g[0] * (g[1] / g[0] - g[2]) ** 2 for g in groups) - sum(g[2] * (1 - g[2]) for g in groups)) / n
        inside = sum(g[0] * g[2] * (1 - g[2]) for g in groups) / n
        return min(max(inside / between - 1 if between > 0 else 1e6, 2.0), 1e6)

    def at(*site):
        picked = [o for r, o in zip(rows, own) if r[:len(site)] == site]
        return len(picked), sum(picked)

    prior = sum(own) / len(own)
    hosts = {h: (*at(h), prior) for h in {r[0] for r in rows}}
    m_host = weight(list(hosts.values()))
    mean = {h: (bad + m_host * prior) / (n + m_host) for h, (n, bad, _) in hosts.items()}
    m_path = weight([(*at(*site), mean[site[0]]) for site in sorted({r[:2] for r in rows})])
    out = []
    for k, (host, path, _, _) in enumerate(rows):
        rest = [(r, o) for j, (r, o) in enumerate(zip(rows, own)) if j != k]
        whole = [o for _, o in rest]
        of_host = [o for r, o in rest if r[0] == host]
        of_path = [o for r, o in rest if r[:2] == (host, path)]
        h = (sum(of_host) + m_host * sum(whole) / len(whole)) / (len(of_host) + m_host)
        out.append((h, (sum(of_path) + m_path * h) / (len(of_path) + m_path)))
    return out


def test_posteriors_of_the_other_rows(spark, docs_of):
    docs, labels = corpus(240, seed=3)
    rng = random.Random(4)
    site = {i: (f"h{min(int(rng.expovariate(0.5)), 9)}", f"p{rng.randrange(4)}") for i, _ in docs}
    site[7] = ("lonely", "only")
    sites = spark.createDataFrame([(i, *s) for i, s in site.items()], "doc_id long, source string, lang string")
    frame = docs_of(docs).drop("source", "lang").join(sites, "doc_id")
    known = spark.createDataFrame(labels[:160], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.assess(frame, known).collect()}
    bad = {i: int(q == 0 or t == 1) for i, q, t in labels[:160]}
    ids = sorted(got)
    expected = plain_posteriors([(*site[i], bad.get(i), got[i].evidence) for i in ids], sum(bad.values()) / len(bad))
    for i, (host, path) in zip(ids, expected):
        p = 1 / (1 + np.exp(-(np.log(path / (1 - path)) + got[i].evidence)))
        assert np.allclose([got[i].host_posterior, got[i].path_posterior, got[i].p_bad], [host, path, p], atol=1e-9)


def test_sample_does_not_depend_on_the_layout(spark):
    rows = spark.range(5000).withColumnRenamed("id", "key")
    one, other = (sorted(r.key for r in quality.sample_of(f, "key", 300).collect()) for f in (rows.coalesce(1), rows.orderBy(quality.F.desc("key")).repartition(7)))
    assert one == other and len(one) == 300
    assert quality.sample_of(rows, "key", 9000).count() == 5000


def test_edge_cases(spark, docs_of):
    docs, labels = corpus(200)
    extra = [(1000, None), (1001, ""), (1002, "x" * 100_000), (1003, "word " * 20_000), (None, docs[0][1]), (0, docs[0][1])]
    known = spark.createDataFrame([*labels[:150], (3, 0, None), (None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    out = quality.assess(docs_of(docs + extra).withColumn("source", quality.F.lit(None).cast("string")), known)
    rows = out.collect()
    assert len(rows) == len(docs + extra)
    assert all(0 <= r.p_bad <= 1 and r.kept is not None for r in rows)
    none = known.where("false")
    assert all(r.kept and r.p_bad == 0 for r in quality.assess(docs_of(docs[:20]), none).collect())
    one_kind = spark.createDataFrame([(1, 1, 0)], known.schema)
    assert all(r.kept for r in quality.assess(docs_of(docs[:20]), one_kind).collect())
    assert quality.assess(docs_of([]), known).count() == 0


def test_memory_of_a_task_is_bounded_by_blocks():
    """A large batch is described in blocks; with blocks of 1 MB this took 98 MB, of which a worker kept 64."""
    import tracemalloc

    text = "a line of several words\n" * 100
    batch = pa.RecordBatch.from_arrays([pa.array([text] * 2000), pa.array(range(2000)), pa.array([""] * 2000), pa.array([""] * 2000)],
                                       names=["text", "id", "host", "path"])
    tracemalloc.start()
    rows = sum(b.num_rows for b in quality._describe(np.zeros(quality.TABLES * quality.SIZE, np.float32))(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 2000 and peak < 48 << 20
