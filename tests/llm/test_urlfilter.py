"""URL filters against plain string code and a dense propagation."""

import re

import numpy as np
import pytest

from difflens.llm import queries, urlfilter
from difflens.llm.urlfilter import Rule

SCHEMA = "page_id long, url string, html string, host string, path string, rule int"


def _pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "h", "p", 1) for i, (u, h) in enumerate(rows)], SCHEMA).repartition(3)


def _parts(url):
    if url is None or "://" not in url:
        return "", ""
    host, rest = re.match(r"(?s)([^/?#]*)(.*)", url.split("://", 1)[1]).groups()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"(?s)[^?#]*", rest).group()


def _rule(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.host + r.path), default=None)


def _walk(hosts, edges, seed, damping):
    at = {h: i for i, h in enumerate(hosts)}
    m = np.zeros((len(hosts), len(hosts)))
    for (a, b), n in edges.items():
        m[at[b], at[a]] += n
    out = m.sum(axis=0)
    m = damping * np.divide(m, out, out=np.zeros_like(m), where=out > 0)
    return dict(zip(hosts, np.linalg.solve(np.eye(len(hosts)) - m, (1 - damping) * np.array([seed.get(h, 0.0) for h in hosts]))))


def _expected(rows, rules, threshold=0.75, damping=0.85):
    parts = [_parts(u) for u, _ in rows]
    hits = [_rule(*p, rules) for p in parts]
    hosts = sorted({h for h, _ in parts if h})
    edges, seed, against = {}, {}, {}
    for (host, _), (_, html) in zip(parts, rows):
        for name in {x.lower() for x in re.findall(r"(?<![A-Za-z0-9.-])[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]+)?", html or "")}:
            if host and name in hosts and name != host:
                edges[host, name] = edges.get((host, name), 0) + 1
    for h in hosts:
        mine = [r.verdict if r else None for (x, _), r in zip(parts, hits) if x == h]
        seed[h], against[h] = mine.count("allow") / len(mine), mine.count("block") / len(mine)
    trust, distrust = _walk(hosts, edges, seed, damping), _walk(hosts, {(b, a): n for (a, b), n in edges.items()}, against, damping)
    out = []
    for (h, p), r in zip(parts, hits):
        t, d = trust.get(h, 0.0), distrust.get(h, 0.0)
        out.append((h, p, r.text if r else None, r.verdict if r else "block" if d > threshold * (t + d) + 1e-7 else "allow", t, d))
    return out


def test_rules_and_parts(spark):
    urls = [
        None, "", "no scheme/example.org/es/", "HTTP://WWW.Example.ORG/es/a?b#c", "http://example.org/es/1", "x://example.org", "x://example.org?/es/",
        "http://notexample.org/es/", "http://a.b.com/fr/x/de/", "http://a.b.com/de/", "http://com/fr/", "http://ÄÖ.org/Ü", "http://u@v.org:80/es/",
        "http://v.org#://example.org/es/", "http://example.org/en/12\n3?x", "http://example.org/en/2", "a://b://c.org/", "http://x.net/de/",
    ]
    rows = [(u, None) for u in urls]
    got = {r.page_id: r for r in urlfilter.filtered(_pages(spark, rows)).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(len(rows))] == [e[:4] for e in _expected(rows, urlfilter.RULES)]
    assert (got[3].rule, got[14].rule, got[15].rule, got[7].rule) == ("example.org/es/", "example.org/en/1", "org/", "org/")


def test_propagation_through_links_and_mentions(spark):
    rules = (Rule("allow", "good.net", "/"), Rule("block", "bad.net", "/"))
    rows = [
        ("http://good.net/1", '<a href="https://friend.net/x">f</a> see FRIEND.net and friend.net.'),
        ("http://good.net/2", "<p>friend.net, mixed.net"),
        ("http://friend.net/", "<a href=//far.net/>"),
        ("http://far.net/", None),
        ("http://bad.net/", '<a href="http://victim.net">'),
        ("http://farm.net/1", "http://bad.net/ http://bad.net/2 unknown.net"),
        ("http://farm.net/2", "bad.net"),
        ("http://behind.net/", "farm.net"),
        ("http://mixed.net/", "bad.net"),
        ("http://victim.net/", ""),
        ("http://lone.net/", "lone.net"),
        (None, "bad.net"),
    ]
    rows += rows[-3:]
    got = sorted(urlfilter.filtered(_pages(spark, rows), rules).collect(), key=lambda r: r.page_id)
    expected = _expected(rows, rules)
    assert [r.verdict for r in got] == [e[3] for e in expected]
    for r, e in zip(got, expected):
        assert (r.trust, r.distrust) == pytest.approx(e[4:], abs=1e-5)
    by = {r.host: r.verdict for r in got}
    assert by["farm.net"] == by["behind.net"] == "block" and by["far.net"] == by["victim.net"] == by["lone.net"] == by[""] == "allow"


def test_a_ring_settles_and_hubs_are_exact(spark):
    rules = (Rule("allow", "r0.net", "/"), Rule("block", "r5.net", "/"))
    rows = [(f"http://r{i}.net/", f"r{(i + 1) % 9}.net hub.net") for i in range(9)] + [("http://hub.net/", " ".join(f"r{i}.net" for i in range(9)))] * 30
    got = sorted(urlfilter.filtered(_pages(spark, rows), rules, damping=0.5).collect(), key=lambda r: r.page_id)
    for r, e in zip(got, _expected(rows, rules, damping=0.5)):
        assert (r.trust, r.distrust) == pytest.approx(e[4:], abs=1e-5)


def test_long_and_empty_pages(spark):
    rows = [("http://a.net/" + "x" * 200_000, "a" * 1_000_000 + ".net " + "b." * 500_000), ("y" * 300_000, "c-" * 300_000)]
    got = {r.page_id: r for r in urlfilter.filtered(_pages(spark, rows)).collect()}
    assert got[0].path == "/" + "x" * 200_000 and got[1].host == ""
    assert urlfilter.filtered(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_on_the_given_table(spark, sf_small):
    got = queries.op12_urlfilter(spark, sf_small)
    assert got.dtypes[:5] == [("page_id", "bigint"), ("host", "string"), ("path", "string"), ("rule", "string"), ("verdict", "string")]
    pages = spark.read.parquet(f"{sf_small}/pages.parquet").orderBy("page_id").collect()
    expected = _expected([(p.url, p.html) for p in pages], urlfilter.RULES)
    assert sorted(tuple(r)[:5] for r in got.collect()) == [(p.page_id, *e[:4]) for p, e in zip(pages, expected)]
