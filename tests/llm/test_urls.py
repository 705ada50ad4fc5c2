import random
import re

from almanac.llm import queries, urls


def brute(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = max(((len(r), v, r) for v, r in queries.URL_RULES for h, p in [(r.split("/", 1)[0], "/" + r.split("/", 1)[1])] if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
    return host, path, best and best[2], best and best[1]


def test_query_keeps_the_rules(spark, sf):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    found = queries.op6_url_filters(spark, sf).collect()
    assert len(found) == len(pages)
    for r in found:
        host, path, rule, verdict = brute(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")


AWKWARD = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/7?x", "http://a.b.co.uk#f", "x://é.org/es/\nq", "a://b://c/d", "http://com/en/", "http://notcom/en/1", "http://1.2.3.4:80/p", "http://net?x/de/"]


def test_awkward_urls(spark):
    pages = spark.createDataFrame([(i, u, "h", "x") for i, u in enumerate(AWKWARD)] + [(None, "http://a.com/", "h", "x"), (0, None, "h", "x")], "page_id long, url string, host string, bad string")
    outcomes = spark.createDataFrame([(0, 1), (4, None), (None, 1), (99, 1)], "page_id long, bad int")
    for marked in (outcomes, outcomes.limit(0)):
        found = urls.judge(pages, marked, queries.URL_RULES).collect()
        assert len(found) == len(AWKWARD) + 2
        for r in found:
            if r.page_id:
                assert (r.host, r.path, r.rule) == brute(AWKWARD[r.page_id])[:3]
    assert urls.judge(pages.limit(0), outcomes).count() == 0


def test_suffixes_and_domains(spark):
    rows = spark.createDataFrame([(h,) for h in ("a.b.co.uk", "x.example.com", "com", "co.uk", "b.de", "")], "host string").withColumn("suffix", urls.suffix_of(urls.F.col("host")))
    found = {r.host: (r.suffix, r.domain) for r in rows.withColumn("domain", urls.domain_of(urls.F.col("host"), urls.F.col("suffix"))).collect()}
    assert found["a.b.co.uk"] == ("co.uk", "b.co.uk") and found["x.example.com"] == ("com", "example.com")
    assert found["com"] == ("com", "com") and found["co.uk"] == ("co.uk", "co.uk") and found["b.de"] == ("de", "b.de") and found[""] == ("", "")


def test_reputation_shrinks(spark):
    pages, outcomes, n = [], [], 0
    for host, good, bad in (("spam.bad.com", 2, 198), ("new.bad.com", 0, 0), ("one.bad.com", 1, 0), ("fine.org", 190, 10), ("rare.org", 0, 1), ("unseen.org", 0, 0)):
        for k in range(max(1, good + bad)):
            pages.append((n, f"http://{host}/{k}"))
            if good + bad:
                outcomes.append((n, int(k >= good)))
            n += 1
    found = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, bad int")).collect()
    by = {r.host: r for r in found}
    assert by["spam.bad.com"].verdict == "block" and by["fine.org"].verdict == "allow"
    assert by["rare.org"].verdict == "allow" and by["rare.org"].bad_share < 0.9  # one bad page is not a bad host
    assert by["new.bad.com"].bad_share > by["unseen.org"].bad_share  # the domain speaks for a host that has no pages
    assert by["one.bad.com"].bad_share < by["new.bad.com"].bad_share


def planted(n_hosts=40, seed=1):
    """Hosts of which every eighth has mostly bad pages; a third of the pages are labelled."""
    rng = random.Random(seed)
    pages, outcomes = [], []
    for h in range(n_hosts):
        share = 0.8 if h % 8 == 0 else 0.1
        for _ in range(rng.randint(40, 120)):
            i = len(pages)
            pages.append((i, f"https://h{h}.example{h % 5}.{('com', 'net', 'co.uk')[h % 3]}/p/{i}"))
            if rng.random() < 0.35:
                outcomes.append((i, int(rng.random() < share)))
    return pages, outcomes


def test_bad_hosts_are_blocked_without_a_rule(spark):
    pages, outcomes = planted()
    found = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, bad int")).collect()
    blocked = {r.host for r in found if r.verdict == "block"}
    bad = {r.host for r in found if int(r.host[1:].split(".")[0]) % 8 == 0}
    assert blocked == bad and all(r.rule is None for r in found)


def test_private_suffixes(spark):
    rows = spark.createDataFrame([("a.pages.example",), ("b.a.pages.example",), ("pages.example",), ("xpages.example",)], "host string")
    rows = rows.withColumn("suffix", urls.suffix_of(urls.F.col("host"), ("pages.example",)))
    found = {r.host: (r.suffix, r.domain) for r in rows.withColumn("domain", urls.domain_of(urls.F.col("host"), urls.F.col("suffix"))).collect()}
    assert found == {"a.pages.example": ("pages.example", "a.pages.example"), "b.a.pages.example": ("pages.example", "a.pages.example"), "pages.example": ("pages.example", "pages.example"), "xpages.example": ("example", "xpages.example")}
