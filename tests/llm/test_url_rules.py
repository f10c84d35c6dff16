"""URL rules against trying every rule on every address."""

import random
import re

import pytest

from auditframe.llm import url_rules as U


def parts(url):
    rest = url[url.index("://") + 3 :] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match("[^?#]*", rest[len(host) :])[0]


def plain(url, rules):
    host, path = parts(url)
    fits = [r for r in rules if re.search(r.pattern, host + path)]
    named = sorted((r for r in fits if r.named), key=lambda r: (len(r.name), r.name))
    if named:
        return host, path, named[-1].name, named[-1].verdict
    return host, path, None, "block" if any(r.verdict == "block" for r in fits if not r.named) else "allow"


SITES = ["com/", "example.com/en/", "www.example.com/en/", "net/es/", "net/fr/"]
URLS = [
    None, "", "no scheme", "://", "http://", "https:///path", "http://COM/", "http://Example.COM/en/x?y#z", "http://example.com/EN/",
    "http://www.example.com/en/", "http://a.www.example.com/en/b", "http://notexample.com/en/", "http://a.net/es/", "http://net/es/x", "http://net/es",
    "http://planet/es/", "http://a.net/fr/#/es/", "http://casino.org/", "http://big-casino.org/x", "http://bigcasino.org/x", "http://a.org/casino",
    "http://casino.com/", "http://x.org?casino.net/es/", "ftp://user:pw@adult.example.org:80/p", "http://日本.net/es/é", "http://a.net//es/", "http://a.net\n/es/x",
    "http://ads.xxx.org/" + "p/" * 50_000, "http://" + "a." * 20_000 + "net/fr/",
]


def got(spark, rows, rules, **options):
    df = spark.createDataFrame([(i, u, "v", "r") for i, u in enumerate(rows)], "page_id long, url string, verdict string, __host string")
    out = U.filter_urls(df.repartition(3), rules, **options)
    assert sorted(out.columns) == ["__host", "host", "page_id", "path", "rule", "url", "verdict"]
    found = sorted(out.collect(), key=lambda r: r.page_id)
    assert [r.page_id for r in found] == list(range(len(rows)))
    return [(r.host, r.path, r.rule, r.verdict) for r in found]


def test_against_all_rules(spark):
    urls = URLS + URLS[5:12]  # some twice
    assert got(spark, urls, U.DEFAULT_RULES) == [plain(u, U.DEFAULT_RULES) for u in urls]


@pytest.mark.parametrize("bound", [0, 50_000])
def test_many_rules_broadcast_or_not(spark, monkeypatch, bound):
    monkeypatch.setattr(U, "BROADCAST_RULES", bound)
    rng = random.Random(6)
    word = lambda: rng.choice(["a", "b", "shop", "news", "x1", "casino"])
    sites = {f"{word()}.{rng.choice(['com', 'net'])}/{rng.choice(['', 'en/', 'e', 'shop/x'])}" for _ in range(60)} | {"net/", "b"}
    rules = tuple(U.site_rule(rng.choice(["allow", "block"]), s) for s in sorted(sites)) + (
        U.host_word_rule("block", "news"),
        U.Rule("digits", r"^[^/]*[0-9]{3}", "block", (), False),  # without a token: tried on every address
        U.Rule("any", r"^", "allow", (), False),
    )
    urls = [f"http://{'.'.join(word() for _ in range(rng.randrange(3)))}.{rng.choice(['com', 'net', 'org', '123'])}/{word()}/{word()}" for _ in range(150)]
    assert got(spark, urls, rules) == [plain(u, rules) for u in urls]


def test_no_pages(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert U.filter_urls(df).collect() == []


def test_ties_between_names(spark):
    rules = (U.site_rule("allow", "a.b/"), U.site_rule("block", "a.b/"))
    rows = got(spark, ["http://a.b/", "http://x.a.b/c"], rules)
    assert {r[2] for r in rows} == {"a.b/"} and {r[3] for r in rows} <= {"allow", "block"}
