"""Operator 8: parsing and rules against plain Python; the tree on planted hosts."""

import re

import pytest

from caseload.llm import url_filter


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule(host, path):
    fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda f: len(f[0])) if fits else (None, None)


URLS = [None, "", "no scheme", "http://", "http://EXAMPLE.com", "http://example.com/en/1", "https://a.www.Example.com/en/1?x#y", "http://x.net/es/a",
        "http://net/fr/", "http://notnet/fr/", "http://x.net/de/1", "ftp://a.b://c/d", "http://h.com?q=/en/", "http://h.com#/x", "http://example.com:80/en/",
        "http://ÄÖ.com/é", "x://" + "a/" * 20_000, "http://example.com/EN/1", "http://example.com/en"]


def pages_of(spark, urls):
    return spark.createDataFrame([(i, u, "host", "x") for i, u in enumerate(urls)], "page_id long, url string, verdict string, host string").repartition(3)


def test_hosts_paths_and_rules(spark):
    got = {r.page_id: r for r in url_filter.judge_urls(pages_of(spark, URLS)).collect()}
    assert len(got) == len(URLS)
    for i, url in enumerate(URLS):
        host, path = parse(url)
        name, verdict = rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, name)
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")


def test_table(spark):
    sf = "/root/testdata/sf0.001"
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = url_filter.op8_url_filter(spark, sf).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        name, verdict = rule(*parse(pages[r.page_id]))
        assert (r.host, r.path, r.rule) == (*parse(pages[r.page_id]), name)
        assert verdict in (None, r.verdict)


def test_templates(spark):
    rules = [("bad.org", "/ads/old/", "block"), ("bad.org", "/news/old/", "allow"), ("bad.org", "/mixed/x", "block"), ("bad.org", "/mixed/y", "allow")]
    urls = [f"http://bad.org/{kind}/old/{i}" for kind in ("ads", "news") for i in range(60)]
    urls += [f"http://bad.org/{kind}/new/{i}" for kind in ("ads", "news") for i in range(5)]
    urls += [f"http://bad.org/p/user{chr(97 + i % 26)}{chr(97 + i // 26)}/x" for i in range(100)]
    urls += ["http://other.org/ads/old/1"]
    rows = {r.page_id: r for r in url_filter.judge_urls(pages_of(spark, urls), rules=rules).collect()}
    template = lambda url: rows[urls.index(url)].template
    assert template("http://bad.org/ads/old/1") == template("http://bad.org/ads/old/2") == "/ads/old/{n}"
    assert template("http://bad.org/news/old/3") == "/news/old/{n}"
    assert {r.template for i, r in rows.items() if "/p/" in urls[i]} == {"/p/*/x"}  # many branches are one variable
    verdicts = {u: rows[i].verdict for i, u in enumerate(urls)}
    assert all(v == "block" for u, v in verdicts.items() if "/ads/old/" in u and "bad.org" in u)
    assert all(v == "allow" for u, v in verdicts.items() if "/ads/old/" not in u)  # without own labels nothing is rejected
    assert verdicts["http://other.org/ads/old/1"] == "allow"


@pytest.mark.parametrize("others", [10, 38, 39, 60])
def test_verdicts_do_not_depend_on_the_number_of_branches(spark, others):
    names = [f"dir{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(others)]
    urls = [f"http://x.net/{top}/{i}" for top in ("es", "fr") for i in range(8)]  # labels: all blocked
    urls += [f"http://x.net/{top}/{i}" for top in names for i in range(3)]
    rules = [*url_filter.RULES, ("y.org", "/ads/old/", "block")]
    rules += [("y.org", f"/{top}/old/", "allow") for top in names]
    urls += [f"http://y.org/{top}/old/{i}" for top in ("ads", *names) for i in range(8)]  # one bad branch among good ones
    urls += [f"http://y.org/{top}/new" for top in ("ads", *names)]
    rows = url_filter.judge_urls(pages_of(spark, urls), rules=rules).collect()
    blocked = {urls[r.page_id] for r in rows if r.verdict == "block"}
    assert blocked == {u for u in urls if "/es/" in u or "/fr/" in u or "/ads/old/" in u}
    template = {urls[r.page_id]: r.template for r in rows}
    assert template["http://y.org/ads/old/1"].startswith("/ads/") and template["http://y.org/dirba/old/1"].startswith("/*/")


def test_unlabelled_branches_beside_labelled_ones(spark):
    urls = [f"http://x.net/{top}/{i}" for top in ("es", "fr") for i in range(8)]
    urls += [f"http://x.net/user{chr(97 + i % 26)}{chr(97 + i // 26)}/{i}" for i in range(60)] + ["http://x.net/*/7"]
    rows = url_filter.judge_urls(pages_of(spark, urls)).collect()
    assert {(urls[r.page_id].split("/")[3][:2], r.template, r.verdict) for r in rows} == {
        ("es", "/*/{n}", "block"), ("fr", "/*/{n}", "block"), ("us", "/*#/{n}", "allow"), ("*", "/*#/{n}", "allow")}


def test_pages_that_differ_deep_in_the_path(spark):
    for depth in (4, 5, 14):
        top = "http://d.org/" + "/".join("abcdefghijklmn"[:depth])
        fixed = top.removeprefix("http://d.org")
        rules = [("d.org", f"{fixed}/ads/old/", "block"), ("d.org", f"{fixed}/news/old/", "allow")]
        urls = [f"{top}/{kind}/old/{i}" for kind in ("ads", "news") for i in range(20)]
        urls += [f"{top}/{kind}/ne{i}" for kind in ("ads", "news") for i in range(3)]
        rows = url_filter.judge_urls(pages_of(spark, urls), rules=rules).collect()
        template = {urls[r.page_id]: r.template for r in rows}
        assert template[f"{top}/ads/old/1"] == f"{fixed}/ads/old/{{n}}"
        assert template[f"{top}/news/ne1"] == f"{fixed}/news/ne{{n}}"
        assert {urls[r.page_id] for r in rows if r.verdict == "block"} == {u for u in urls if "/ads/old/" in u}


def test_empty_table_and_repeated_rows(spark):
    assert url_filter.judge_urls(pages_of(spark, [])).count() == 0
    twice = pages_of(spark, ["http://x.net/es/1"]).union(pages_of(spark, ["http://x.net/es/1"]))
    assert [r.verdict for r in url_filter.judge_urls(twice).collect()] == ["block", "block"]


def test_plan_is_native(spark):
    plan = url_filter.judge_urls(pages_of(spark, URLS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
