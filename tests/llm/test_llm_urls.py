"""Hosts, paths and rules in plain Python; ranks by dense matrices."""

import random

import numpy as np
import pytest

from gleaner.llm import urls
from gleaner.llm.queries import URL_RULES, op7_url_trust


def parts(url):
    head, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    end = min((rest.find(c) for c in "?#" if c in rest), default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:end]


def rule_of(host, path, rules):
    best = None
    for text in rules:
        verdict, where = text.split(" ")
        at = where.find("/")
        own, prefix = (where, "") if at < 0 else (where[:at], where[at:])
        if (host == own or host.endswith("." + own)) and path.startswith(prefix) and (best is None or len(where) > len(best[0])):
            best = (where, verdict)
    return best or (None, None)


def test_query_on_whole_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: r for r in op7_url_trust(spark, sf).collect()}
    assert got.keys() == {p.page_id for p in pages}
    for p in pages:
        host, path = parts(p.url)
        rule, verdict = rule_of(host, path, URL_RULES)
        r = got[p.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


ODD = ["HTTP://A.B.example.COM/en/7x?q#f", "x://example.com?en/", "x://example.com#/en/", "x://notexample.com/en/7", "x://com/en/", "//example.com/en/", "x://É.com/en/", "a://b://c/d", "x://example.net:80/de/8", "x:///de/", "x://org/es/", "x://sub.example.net/de/81", "", None]


def test_odd_urls(spark):
    pages = spark.createDataFrame([(i, url, None) for i, url in enumerate(ODD)], "page_id bigint, url string, html string")
    for r in urls.judge(pages, URL_RULES).collect():
        host, path = parts(ODD[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule_of(host, path, URL_RULES)[0])


def dense(edges, allowed, blocked, iterations, d=urls.DAMPING):
    hosts = sorted({h for e in edges for h in e} | set(allowed) | set(blocked))
    n = {h: i for i, h in enumerate(hosts)}

    def rank(links, seeds):
        total = sum(seeds.values())
        s = np.array([seeds.get(h, 0) / total if total else 0.0 for h in hosts])
        out = np.zeros((len(hosts), len(hosts)))
        for a, b in links:
            out[n[b], n[a]] = 1
        deg = out.sum(0)
        r = s.copy()
        for _ in range(iterations):
            r = (1 - d) * s + d * (out @ (r / np.maximum(deg, 1)) + r[deg == 0].sum() * s)
        return dict(zip(hosts, r, strict=True))

    return rank(edges, allowed), rank([(b, a) for a, b in edges], blocked)


def test_propagation(spark):
    rng = random.Random(2)
    for iterations in (1, 4):
        edges = sorted({(f"h{a}", f"h{b}") for a, b in ((rng.randrange(12), rng.randrange(15)) for _ in range(40)) if a != b})
        allowed, blocked = {"h1": 3, "h4": 1}, {"h2": 2, "lonely": 5}
        seeds = [(h, allowed.get(h, 0), blocked.get(h, 0)) for h in {*allowed, *blocked}]
        got = urls.propagate(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(seeds, "host string, allowed bigint, blocked bigint"), iterations).collect()
        trust, distrust = dense(edges, allowed, blocked, iterations)
        assert {r.host for r in got} == trust.keys()
        for r in got:
            assert r.trust == pytest.approx(trust[r.host], abs=1e-12) and r.distrust == pytest.approx(distrust[r.host], abs=1e-12)


def test_verdicts_follow_links(spark):
    link = lambda *hosts: "".join(f'<a class="x" HREF = "https://{h}/p">x</a>' for h in hosts)
    rows = [(1, "http://good.org/x", link("friend.net")), (2, "http://friend.net/", link("second.net")), (3, "http://second.net/", ""), (4, "http://bad.com/x", link("good.org")), (5, "http://feeder.net/", link("bad.com")), (6, "http://far.net/", link("feeder.net") + "<a href='//bad.com'>"), (7, "http://alone.net/", "<a href='/local'>")]
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(rows, "page_id bigint, url string, html string"), ["allow good.org", "block bad.com/x"], iterations=3).collect()}
    assert got == {1: ("good.org", "allow"), 2: (None, "allow"), 3: (None, "allow"), 4: ("bad.com/x", "block"), 5: (None, "block"), 6: (None, "block"), 7: (None, "allow")}


def test_links(spark):
    html = '<a href="http://B.example/x"><a href=//c.example><a href="/local"><a href="mailto:x"><a href=\'https://a.example/\'>'
    pages = spark.createDataFrame([("http://a.example/1", html), ("http://a.example/2", html), (None, html), ("x", None)], "url string, html string")
    assert sorted(map(tuple, urls.links(pages).collect())) == [("a.example", "b.example"), ("a.example", "c.example")]


def test_rules():
    assert urls.Rule.of("allow example.com/en/7") == urls.Rule("example.com", "/en/7", True)
    for bad in ("deny x/", "allow", ""):
        with pytest.raises(ValueError):
            urls.Rule.of(bad)


def test_ranks_reach_the_end_of_a_long_chain(spark):
    """20 links before a blocked host: each is suspect, as it leads only there."""
    link = lambda host: f'<a href="http://{host}/">'
    rows = [(i, f"http://h{i}.net/", link(f"h{i + 1}.net")) for i in range(20)] + [(20, "http://h20.net/", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.verdict for r in urls.judge(pages, ["block h20.net", "allow good.org"], damping=0.5).collect()}
    assert got == dict.fromkeys(range(21), "block")
