from tessera.llm import urls
from tests.oracle import compare


def plain(url, rules, default="allow"):
    """The contract by plain Python."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        tail = rest[cut:]
        end = min((tail.find(c) for c in "?#" if c in tail), default=len(tail))
        path = tail[:end]
    fits = [(len(h) + len(p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else default


URLS = [
    None, "", "no scheme", "://", "http://", "http://net", "http://net/", "http://NET/x", "http://a.net?q=/en/", "http://a.net#x", "https://Example.NET/en/1", "https://example.net/enx", "https://x.example.net/en/?a#b",
    "https://badexample.net/en/1", "https://example.com/de/", "https://example.com/DE/", "https://a.b.example.com/de/x/y", "ftp://fr.org/fr/", "http://org/fr/", "http://x.org/fr", "http://user@a.net:80/", "http://a..net/", "http://.net/", "a://b://net/",
    "http://ÄÖ.net/é", "http://e\n.net/\n", "http://" + "a." * 500 + "net/" + "p" * 5000,
]


def test_contract(spark):
    rules = [tuple(r) for r in urls.production_rules(spark).collect()]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.op3_url_filters(pages).collect()}
    assert got == {i: plain(u, rules) for i, u in enumerate(URLS + URLS[:3])}
    assert urls.op3_url_filters(pages.limit(0)).count() == 0


def test_other_rules_and_clashing_columns(spark, monkeypatch):
    rules = [("a.b", "/", "block"), ("b", "/x/y", "allow"), ("a.b", "/x", "block"), ("a.b", "/x", "allow"), ("c", None, "block"), (None, "/", "block"), ("", "/", "block"), ("D.e", "/é", "block")]
    clean = [(h.lower(), p or "", v) for h, p, v in rules if h]
    texts = ["h://a.b/x/y", "h://a.b/x", "h://a.b/", "h://z.b/x/y", "h://c", "h://q.c?x", "h://d.e/é1", "h://", "h://b/x/"]
    pages = spark.createDataFrame([(i, u, "old", "r") for i, u in enumerate(texts)], "page_id long, url string, host string, Rule string")
    for most in (urls.BROADCAST_RULES, 0):
        monkeypatch.setattr(urls, "BROADCAST_RULES", most)
        out = urls.filter_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
        assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()} == {i: plain(u, clean) for i, u in enumerate(texts)}
    none = urls.filter_urls(pages, spark.createDataFrame([], "host string, path string, verdict string"), default="block")
    assert {r.verdict for r in none.collect()} == {"block"}


def test_sql(spark, sf01):
    compare(spark, sf01, lambda s, d: urls.op3_url_filters(s.read.parquet(f"{d}/pages.parquet")), urls.OP3_SQL)


def test_no_python_on_the_main_path(spark, sf01):
    plan = urls.op3_url_filters(spark.read.parquet(f"{sf01}/pages.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "html" not in plan.split("Physical Plan")[-1]
