import random

from pyspark.sql import functions as F

from sedimark.llm import queries, urls

RULES = [*queries.URL_RULES, ("block", "b.example.com", "/a"), ("allow", "example.com", "/a/b/c"), ("block", "example.com", ""), ("allow", "example.com", "")]


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        for c in "?#":
            rest = rest.split(c, 1)[0]
        cut = rest.find("/") if "/" in rest else len(rest)
        host, path = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
    fits = [r for r in rules if host and (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[0] == "block"), default=None)
    return (host, path, best and best[1] + best[2], best[0] if best else default)


def sample():
    r = random.Random(3)
    hosts = ["EXAMPLE.com", "www.example.com", "a.b.example.com", "notexample.com", "com", "x.net", "net", "É.com", "example.com:80", ""]
    paths = ["", "/", "/en/1", "/en", "/es/", "/fr/x?y", "/a", "/a/b/c/d", "/abc#x", "//en/", "?q=/en/"]
    made = [f"{r.choice(['http', 'https', 'x'])}://{r.choice(hosts)}{r.choice(paths)}" for _ in range(300)]
    return [*made, None, "", "no scheme", "://", "a://b://c/en/", "http://example.com/en/\nx"]


def test_trie_and_join_equal_brute_force(spark):
    pages = spark.createDataFrame(list(enumerate(sample())), "page_id bigint, url string").withColumn("rule", F.lit(1))
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    for out in (urls.judge_urls(pages, RULES), urls.judge_urls_by_join(pages, rules)):
        assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
        for row in out.collect():
            assert (row.host, row.path, row.rule, row.verdict) == brute(row.url, RULES), row
        assert out.count() == pages.count()


def test_empty_and_repeated(spark):
    pages = spark.createDataFrame([("http://a.com/",), ("http://a.com/",)], "url string")
    assert urls.judge_urls(pages, RULES).count() == 2 and urls.judge_urls(pages.limit(0), RULES).count() == 0
    assert [r.verdict for r in urls.judge_urls(pages, [], default="block").collect()] == ["block", "block"]


def test_rules_of_a_table_and_deep_paths(spark, monkeypatch):
    deep = "/" + "/".join("abcdefgh"[i % 8] for i in range(3000))
    rules = [*RULES, ("block", "deep.org", deep), ("block", "deep.org", deep)]
    pages = spark.createDataFrame([(0, f"http://x.deep.org{deep}/z"), (1, "http://deep.org/a/b"), *((i + 2, u) for i, u in enumerate(sample()[:40]))], "page_id bigint, url string")
    table = spark.createDataFrame([*rules, (None, "a", "/")], "verdict string, host string, path string")
    wanted = {r.page_id: brute(r.url, rules) for r in pages.collect()}
    for most in (100_000, 3):
        monkeypatch.setattr(urls, "MAX_BROADCAST_RULES", most)
        for given in (rules, table):
            assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, given).collect()} == wanted
