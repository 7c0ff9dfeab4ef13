from __future__ import annotations

from panelwright.llm import url_filters as U
from panelwright.llm.graph import UnionFind

RULES = [U.Rule("allow", "com", "/"), U.Rule("block", "example.com", "/en/"), U.Rule("allow", "www.example.com", "/en/"), U.Rule("block", "net", "/es/")]
SCHEMA = "page_id long, url string, html string, node string, rule string, host int"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    for c in "?#":
        path = path.split(c, 1)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), path


def whole(url):
    """Host, path and query."""
    host, path = parts(url)
    rest = (url or "").split("#", 1)[0]
    return host + path + ("?" + rest.split("?", 1)[1] if "?" in rest and host + path else "")


def ruled(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.host + r.path)) if fits else None


def brute(pages, links):
    groups = UnionFind()
    blocked = set()
    for a, b in links:
        a, b = whole(a), whole(b)
        if a and b:
            groups.union(a, b)
    for x in list(groups.parent):
        rule = ruled(*parts("x://" + x))
        if rule and rule.verdict == "block":
            blocked.add(groups.find(x))
    out = []
    for i, url, _ in pages:
        host, path = parts(url)
        rule = ruled(host, path)
        node = whole(url)
        bad = node in groups.parent and groups.find(node) in blocked
        out.append((i, host, path, rule.host + rule.path if rule else None, rule.verdict if rule else "block" if bad else "allow"))
    return sorted(out, key=str)


def canonical(target):
    return f'<html><head><link rel="stylesheet" href="s.css"><link href="{target}" rel=canonical></head></html>'


PAGES = [
    (0, "http://a.org/x?q=1", canonical("https://example.com/en/1")),
    (1, "https://a.org/y#top", '<meta http-equiv="refresh" content="0; url=/x">'),
    (2, "https://b.org/", canonical("//a.org/y")),
    (3, "https://shop.com/z", canonical("https://a.org/x")),
    (4, "http://www.EXAMPLE.com/en/2", None),
    (5, "http://q.example.com/en/2", ""),
    (6, "http://n.net/es/1", "<p>none</p>"),
    (7, "http://n.net/de/1", canonical("../es/1")),
    (8, "http://m.net/d", canonical("http://n.net/es/1")),
    (9, None, canonical("http://n.net/es/1")),
    (10, "no scheme", None),
    (11, "http://com?x", None),
    (12, "http://example.com/en", None),
    (12, "http://example.com/en", None),
    (None, "ftp://User@H.COM:80/p", None),
    (13, "http:///only", None),
    (30, "http://v.org/view?id=1", canonical("http://n.net/es/9")),
    (31, "http://v.org/view?id=2", None),
    (32, "http://v.org/view?id=1#part", None),
    (33, "http://v.org/list", canonical("?id=3&amp;s=1")),
    (34, "http://v.org/list?id=3&s=1", canonical("view?id=1")),
    (35, "http://w.org/a", "<!-- " + canonical("http://n.net/es/9") + "--><script>'<link rel=canonical href=http://n.net/es/9>'</script>"),
    (36, "http://w.org/b", canonical("mailto:x@n.net") + canonical("http://[") + canonical("#top") + "<link rel=canonical href=http://n.net/es/9"),
    (37, "http://w.org/c", '<link title="a > b" rel="alternate Canonical" href="http://n.net/es/&#57;">'),
    (38, "http://w.org/d", '<link rel="canonical-no" href="http://n.net/es/9"><link data-rel="canonical" href="http://n.net/es/9">'),
]
LINKS = [
    ("http://a.org/x?q=1", "https://example.com/en/1"), ("https://a.org/y", "https://a.org/x"), ("https://b.org/", "https://a.org/y"),
    ("https://shop.com/z", "https://a.org/x"), ("http://n.net/de/1", "http://n.net/es/1"), ("http://m.net/d", "http://n.net/es/1"),
    ("http://v.org/view?id=1", "http://n.net/es/9"), ("http://v.org/list", "http://v.org/list?id=3&s=1"), ("http://v.org/list?id=3&s=1", "http://v.org/view?id=1"),
    ("http://w.org/c", "http://n.net/es/9"),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "n", "r", 1) for i, u, h in rows], SCHEMA).repartition(3)


def test_verdicts_match_brute_force(spark):
    got = U.verdicts(frame(spark, PAGES), U.rule_table(spark, RULES))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(PAGES, LINKS)


def test_given_redirects_join_in(spark):
    more = [("http://a.org/x", "https://a.org/x?q=1"), ("http://b.org/", "http://k.org/1"), (None, "http://k.org/2"), ("http://k.org/1", "http://k.org/3")]
    pages = [*PAGES, (20, "https://k.org/3", None), (21, "https://k.org/2", None)]
    redirects = spark.createDataFrame(more, "from_url string, to_url string")
    got = U.verdicts(frame(spark, pages), U.rule_table(spark, RULES), redirects)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(pages, LINKS + more)
    assert {r["page_id"]: r["verdict"] for r in got.collect()}[20] == "block"


def test_empty_tables(spark):
    assert U.verdicts(frame(spark, PAGES).limit(0), U.rule_table(spark, RULES)).count() == 0
    assert {r["verdict"] for r in U.verdicts(frame(spark, PAGES), U.rule_table(spark, RULES).limit(0)).collect()} == {"allow"}


def test_allow_goes_before_block_among_equal_rules(spark):
    rules = [U.Rule(v, "t.org", "/p") for v in ("block", "allow")] + [U.Rule("allow", "org", "/ab"), U.Rule("block", "u.org", "/")]
    pages = [(1, "http://t.org/p", None), (2, "http://u.org/ab", None), (3, "http://u.org/", None)]
    got = U.verdicts(frame(spark, pages), U.rule_table(spark, rules)).collect()
    assert sorted((r["page_id"], r["rule"], r["verdict"]) for r in got) == [(1, "t.org/p", "allow"), (2, "org/ab", "allow"), (3, "u.org/", "block")]
