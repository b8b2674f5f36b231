from __future__ import annotations

import re

import cases
import pytest

from gevel.llm import urls as u


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), path


def rule(host, path):
    best = None
    for h, p, v in u.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (not best or len(h + p) > len(best[0])):
            best = (h + p, v)
    return best


def plain(pages):
    """Rules, then dense power iteration over the hosts."""
    rows = [(i, *parts(x), h) for i, x, h in pages]
    node = lambda host: re.sub(r"^[^@]*@|:\d*$", "", host)
    hosts = sorted({node(r[1]) for r in rows if node(r[1])})
    seed = {}
    for h in hosts:
        verdicts = [(rule(r[1], r[2]) or (None, None))[1] for r in rows if node(r[1]) == h]
        part = [verdicts.count(v) / len(verdicts) for v in ("allow", "block")]
        seed[h] = [x if x >= 0.5 else 0.0 for x in part]
    links = {}
    for _, host, _, html in rows:
        host = node(host)
        for m in re.findall(u._LINK[4:], html or "", re.I):
            to = re.sub(r"^[^@]*@|:\d*$", "", m).lower()
            if host and to and to != host:
                links[host, to] = links.get((host, to), 0) + 1
    nodes = sorted(set(seed) | {x for e in links for x in e})
    score = {}
    for side in (0, 1):
        s0 = {n: seed.get(n, [0, 0])[side] for n in nodes}
        total = sum(s0.values())
        s0 = {n: x / total if total else 0.0 for n, x in s0.items()}
        edges = {(a, b) if side == 0 else (b, a): n for (a, b), n in links.items()}
        out = {n: sum(w for (a, _), w in edges.items() if a == n) for n in nodes}
        s = dict(s0)
        for _ in range(200):
            lost = sum(s[n] for n in nodes if not out[n])
            flow = {n: 0.0 for n in nodes}
            for (a, b), w in edges.items():
                flow[b] += s[a] * w / out[a]
            s = {n: 0.15 * s0[n] + 0.85 * (flow[n] + lost * s0[n]) for n in nodes}
        score[side] = s
    out = []
    for i, host, path, _ in rows:
        r = rule(host, path)
        verdict = "block" if score[1].get(node(host), 0) > score[0].get(node(host), 0) + 1e-12 else "allow"
        out.append((i, host, path, r[0] if r else None, r[1] if r else verdict))
    return sorted(out, key=str)


def check(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'x' as h", "1 as host", "2 as n")
    assert sorted((tuple(r) for r in u.digest(u.judge(df)).collect()), key=str) == plain(pages)


PAGES = [
    (1, "http://WWW.Example.com/en/x?q#f", '<a href="http://shop.com/fr/">x</a>'),
    (2, "https://a.example.com/en/", None),
    (3, "https://a.example.com", '<a href="//Good.org:80/a">x</a>'),
    (4, "http://bad.net/fr/1", '<a HREF = \'https://friend.org/x\'>y</a>'),
    (5, "http://bad.net/es/2", ""),
    (6, "http://bad.net/de/2", ""),
    (7, "http://friend.org/", '<a href="http://bad.net/es/">x</a> <a href="/own">z</a>'),
    (8, "http://good.org/?x", '<a href="http://other.org">x</a>'),
    (9, "http://shop.com/a", '<a href="http://good.org">x</a>' * 3),
    (10, None, "<p>"),
    (11, "no scheme", "<p>"),
    (12, "://", None),
    (13, "x://?y", None),
    (14, "http://net/es/", '<a href="http://bad.net/fr/">x</a>'),
    (14, "http://net/es/", '<a href="http://bad.net/fr/">x</a>'),
    (None, "http://notnet/es/", "x" * 100000),
    (15, "http://me@Friend.org:8080/x", None),
    (16, "http://other.org:81/", '<a href="http://shop.com:8080/">x</a>'),
]


def test_rules_and_links(spark):
    check(spark, PAGES)
    got = {r[0]: r[4] for r in plain(PAGES)}
    assert got[7] == "block" and got[8] == "allow" and got[6] == "block" and got[1] == "allow" and got[2] == "block"


def test_far_hosts_are_reached(spark):
    """Each links to the next; the last is blocked, and so are all, however far."""
    pages = [(i, f"http://h{i}.org:{i}/", f'<a href="http://h{i + 1}.org/">x</a>') for i in range(9)]
    pages += [(9, "http://h9.org/", '<a href="http://bad.net/es/">x</a>'), (10, "http://bad.net/es/", "")]
    got = [r["verdict"] for r in u.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()]
    assert got == ["block"] * 11
    check(spark, pages)


def test_given_pages(spark):
    check(spark, [tuple(r) for r in cases.table(spark, "pages").select("page_id", "url", "html").collect()])


def test_empty(spark):
    assert u.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_too_many_rules(spark):
    from pyspark.sql import functions as F

    with pytest.raises(ValueError):
        u.ruled([("a", "/", "allow")] * 501, F.lit("a"), F.lit("/"), lambda r: r[0])
