import random

from sedimark.llm import _common, bloom, url_filter
from sedimark.llm.queries import URL_RULES


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    tail = rest[len(host) :]
    for c in "?#":
        tail = tail.split(c)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail


def brute(pages, listed):
    key = lambda u: (split(u)[0] + split(u)[1].rstrip("/")) if split(u)[0] else None
    names = {key(u) for u in listed} - {None}
    out = []
    for i, u in pages:
        host, path = split(u)
        hits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if hits:
            _, rule, verdict = max(hits)
            out.append((i, host, path, rule, verdict, False))
        else:
            is_listed = key(u) in names
            out.append((i, host, path, None, "block" if is_listed else "allow", is_listed))
    return sorted(out, key=str)


ODD = [None, "", "no scheme", "http://", "http:///p", "HTTP://Example.ORG/A", "http://ÉXAMPLE.org/É", "http://a.org?x=/y", "http://a.org#f/://b", "x://www.example.com/en/1", "x://example.com/en/", "x://notexample.com/en/", "x://a.net/es/1", "x://a.net/es", "x://com/", "x://a.com", "x://a.org/p/", "x://a.org/p"]


def test_matches_brute_force(spark):
    rng = random.Random(3)
    pages = list(enumerate(ODD)) + [(100 + i, f"http://h{rng.randrange(30)}.{rng.choice(['com', 'org', 'net'])}/{rng.choice(['en', 'es', 'q'])}/{rng.randrange(20)}") for i in range(500)] + [(0, ODD[5]), (None, "x://h1.org/q/1")]
    listed = [u for _, u in pages if u and rng.random() < 0.3] + ["x://h1.org/q/1", None, "bad"] * 2
    df = spark.createDataFrame([(i, u, "h", 1) for i, u in pages], "page_id bigint, url string, host string, block int").repartition(3)
    lf = spark.createDataFrame([(u,) for u in listed], "url string")
    got = url_filter.filter_urls(df, lf, URL_RULES)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "listed"]
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(pages, listed)


def test_long_lists_hot_urls_and_a_full_filter(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "SMALL_KEYS", 0)
    monkeypatch.setattr(_common, "SMALL_KEYS", 0)
    monkeypatch.setattr(_common, "HOT_ROWS", 50)
    monkeypatch.setattr(bloom, "BROADCAST_BLOCKS", 1)  # nearly everything passes the filter
    pages = [(i, "x://hot.org/p" if i % 3 == 0 else f"x://h{i % 40}.org/q?{i}") for i in range(600)] + [(7, None), (8, "x://l.org/" + "a" * 300_000), (9, "x://l.org/" + "a" * 300_000 + "b")]
    listed = ["x://hot.org/p/", "http://h3.org/q", "x://l.org/" + "a" * 300_000]
    df = spark.createDataFrame(pages, "page_id bigint, url string").repartition(5)
    got = url_filter.filter_urls(df, spark.createDataFrame([(u,) for u in listed], "url string"), URL_RULES)
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(pages, listed)


def test_empty_tables(spark):
    pages, listed = spark.createDataFrame([], "page_id bigint, url string"), spark.createDataFrame([], "url string")
    assert url_filter.filter_urls(pages, listed, URL_RULES).collect() == []
    one = spark.createDataFrame([(1, "x://a.org/p")], "page_id bigint, url string")
    assert [r.verdict for r in url_filter.filter_urls(one, listed, []).collect()] == ["allow"]


def test_no_python_in_the_plan(spark):
    pages = spark.createDataFrame([(1, "x://a.org/p")], "page_id bigint, url string")
    plan = url_filter.filter_urls(pages, pages.select("url"), URL_RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
