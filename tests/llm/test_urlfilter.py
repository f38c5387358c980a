from loomvec.llm import urlfilter
from loomvec.llm.queries import URL_RULES


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: next((i for i, c in enumerate(path) if c in "?#"), len(path))]
    best = (None, None)
    for verdict, rule in URL_RULES:
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail) and len(rule) > len(best[0] or ""):
            best = (rule, verdict)
    return host, path, best


URLS = ["https://A.Example.COM/en/7x", "http://example.com/en/8", "http://example.net/de/81?x", "http://b.example.net/de/9#y", "http://example.org/es/", "http://notcom/en/1", "http://com/en/", "no scheme", None, "", "ftp://h?x=/en/", "http://É.org/es/z", "x://y://z/a", "http://www.q.io/p/?utm_source=a&id=3&ref=b#t", "http://Q.io:80/p?id=3"]


def run(spark, urls, listed, **more):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    return {r.page_id: r for r in urlfilter.url_filter(pages, spark.createDataFrame([(u,) for u in listed], "canonical string"), URL_RULES, **more).collect()}


def test_rules_and_list(spark):
    for more in ({}, {"broadcast_bytes": 0}):
        got = run(spark, URLS, ["q.io/p?id=3", None, "q.io/p?id=3"], **more)
        assert len(got) == len(URLS)
        for i, u in enumerate(URLS):
            host, path, (rule, verdict) = brute(u)
            assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
            assert got[i].verdict == (verdict or ("block" if i >= 13 else "allow"))


def test_no_false_positives_or_dismissals(spark):
    urls = [f"http://h{i % 50}.io/p{i}" for i in range(3000)]
    listed = {f"h{i % 50}.io/p{i}" for i in range(0, 3000, 7)}
    got = run(spark, urls, sorted(listed))
    assert {i for i, r in got.items() if r.listed} == set(range(0, 3000, 7))
    assert run(spark, urls[:3], []) and run(spark, [], ["a"]) == {}


def test_pages_are_read_once(spark, sf_dir):
    from loomvec.llm.queries import op8_url_filter

    plan = op8_url_filter(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("pages.parquet") <= 1 and not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_without_broadcast_no_row_is_lost(spark):
    urls = [None] * 400 + ["no scheme"] * 100 + [f"http://h.io/{i % 5}" for i in range(200)]
    got = run(spark, urls, ["h.io/1"], broadcast_bytes=0)
    assert len(got) == 700 and sum(r.listed for r in got.values()) == 40
