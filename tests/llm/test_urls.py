import re
import string

import pytest

from quire.llm import common, urls

PAGES = "page_id long, url string, html string, host string, path string, rank string, key string, token string, rule string"
RULES = [(verdict, path) for verdict, path in urls.HOST_RULES]
URLS = [
    "http://a.net/x", "http://net/", "https://NET/y", "http://net", "http://xnet/", "http://example.net/en/1", "http://www.Example.NET/en/1", "http://www.example.net/EN/1",
    "http://example.net/en", "http://example.com/de/", "http://m.example.com/de/x?q=1", "http://example.com/fr/", "http://org/fr/", "http://a.b.org/fr/?x", "http://a.org/fr#x",
    "ftp://a.org/fr/1://b.net/", "no scheme", "", None, "://", "http:///path", "http://adult-x.example.com/en/1", "http://x.adult-y.org/", "http://notadult-x.org/", "http://spam-farm.org?a=1",
    "http://a.com/ads/1", "http://a.com/ads/policy/1", "http://a.com/ADS/1", "http://a.com/loads/1", "http://a.com/x?sessionid=1", "http://a.com/x?b=2&sessionid=", "http://é.com/ads/", "http://a.com/\n/ads/\n",
    "http://warez.com/", "http://a.net:80/x", "http://user@a.net/", "http://a.com//ads//", "http://a.com/en/ads/?sessionid=3",
]


def lowered(text):
    return "".join(c.lower() if c in string.ascii_uppercase else c for c in text)


def expression(pattern):
    start = r"^(?:[^/?#]*\.)?" if pattern.startswith("||") else "^" if pattern.startswith("|") else ""
    end = r"\Z" if pattern.endswith("|") and len(pattern) > 1 else ""
    body = "".join(".*" if c == "*" else r"(?:[^A-Za-z0-9_.%-]|\Z)" if c == "^" else re.escape(c) for c in re.sub(r"^\|\|?|\|$", "", pattern))
    return re.compile(start + body + end, re.S)


def plain_version(url, table):
    rest = url.partition("://")[2] if url and "://" in url else ""
    own = re.match(r"[^/?#]*", rest)[0]
    host, tail = lowered(own), rest[len(own) :]
    fits = [r for r in table if r[1] is not None and expression(r[1]).search(host + tail)]
    best = max(fits, key=lambda r: (r[3], len(r[1]), r[2] == "block", r[1], r[0] or ""), default=(None, None, "allow", 0))
    return (host, re.match(r"[^?#]*", tail)[0], best[0], best[2], best[1])


def table_rows():
    return [(path, f"||{path}", v, 1) for v, path in urls.HOST_RULES] + [(None, p, v, 0) for v, p in urls.PATTERNS]


def pages(spark, found):
    return spark.createDataFrame([(i, u, *"abcdefg") for i, u in enumerate(found)], PAGES)


def check(spark, found, table):
    got = urls.judged(pages(spark, found), spark.createDataFrame(table, "name string, pattern string, verdict string, tier int")).collect()
    assert len(got) == len(found)
    assert {r["page_id"]: tuple(r)[1:] for r in got} == {i: plain_version(u, table) for i, u in enumerate(found)}


def test_equals_every_rule_on_every_url(spark):
    check(spark, URLS + URLS[:3] * 20, table_rows())


def test_dealt_rules_by_hand(spark):
    got = {r["url"]: (r["rule"], r["verdict"]) for r in pages(spark, URLS).select("page_id", "url").join(urls.judged(pages(spark, URLS), urls.rules(spark)), "page_id").collect()}
    assert got["http://a.net/x"] == ("net/", "block") and got["http://net"] == (None, "allow") and got["http://xnet/"] == (None, "allow")
    assert got["http://www.Example.NET/en/1"] == ("example.net/en/", "allow") and got["http://www.example.net/EN/1"] == ("net/", "block")
    assert got["http://m.example.com/de/x?q=1"] == ("example.com/de/", "block") and got["http://a.org/fr#x"] == (None, "allow")
    assert got["ftp://a.org/fr/1://b.net/"] == ("org/fr/", "allow") and got[None] == (None, "allow")
    assert got["http://spam-farm.org?a=1"] == (None, "block") and got["http://a.com/ads/policy/1"] == (None, "allow")


ODD = [
    ("any", "*", "block", -1), ("dot", "a.b*c^", "block", 3), ("end", "/x|", "allow", 4), ("all", "|a.com/x|", "block", 5), ("paren", "(a+b)[1]{2}$\\", "block", 2), ("none", None, "block", 9),
    ("same", "||a.com^", "allow", 3), ("same2", "||a.com^", "block", 3), ("caps", "/ADS/", "block", 2), ("sub", "oad", "block", 2), ("empty", "", "allow", -2), ("é", "||é.com/", "block", 8),
]


def test_odd_patterns(spark):
    check(spark, URLS + ["http://a.b-c/", "http://q.com/(a+b)[1]{2}$\\", "http://a.com/x", "http://a.com", "http://zz.a.com:1/x"], ODD)


@pytest.mark.parametrize("rows,hot", [(3, 100_000), (3, 10)])
def test_without_one_broadcast(spark, monkeypatch, rows, hot):
    """More rules than may be broadcast: frequent tokens' rules go in blocks, the others by shuffling."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(common, "HOT", hot)
    monkeypatch.setattr(urls, "HOT", hot)
    check(spark, URLS * 3, table_rows())


def test_rules_lie_under_their_rarest_token(spark):
    found = [f"http://host{i}.example.net/en/{i}" for i in range(20)] + ["http://rare.example.net/en/"]
    table = [("a", "||rare.example.net/en/", "block", 0), ("b", "||example.net/", "block", 0), ("c", "||exam*", "block", 0), ("d", "||absent.net/", "block", 0)]
    ranked = spark.createDataFrame([(i, *r) for i, r in enumerate(table)], "rank long, name string, pattern string, verdict string, tier int")
    rows = pages(spark, found)
    host, tail = urls.host_of(rows["url"])
    tokens = rows.select(urls.F.explode(urls.tokens(urls.F.concat(host, tail))).alias("token"))
    got = {table[r["rank"]][0]: (r["token"], r["seen"]) for r in urls.index(tokens, ranked).collect()}
    assert got == {"a": ("rare", 1), "b": ("example", 21), "c": ("", 21), "d": ("absent", 0)}


def test_empty_tables(spark):
    assert urls.judged(pages(spark, []), urls.rules(spark)).collect() == []
    none = spark.createDataFrame([], "name string, pattern string, verdict string, tier int")
    assert {(r["rule"], r["verdict"]) for r in urls.judged(pages(spark, URLS), none, default="block").collect()} == {(None, "block")}
