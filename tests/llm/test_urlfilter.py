import random

from latchwork.llm.urlfilter import RULES, filter_urls, rules_table


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = tail[: min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))]
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[1] if best else None, best[2] if best else default


def test_against_brute_force(spark):
    rng = random.Random(8)
    parts = ["http", "://", "com", "example", ".", "net", "org", "/", "en", "de", "es", "7", "8", "?", "#", "A", "é", " ", "\n", "x"]
    urls = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    hosts = ["com", "example.com", "a.example.com", "EXAMPLE.net", "example.net", "net", "xcom", "org", "b.org.", ""]
    urls += [f"https://{rng.choice(hosts)}/{rng.choice(['en/', 'en/7', 'de/', 'de/8', 'es/', 'en', ''])}{rng.choice(['', '1', '?q', '#f', '/x'])}" for _ in range(400)]
    rows = [(i, u, "h", "p", "r") for i, u in enumerate(urls)] + [(5, None, "h", "p", "r"), (None, "http://a.com/en/", "h", "p", "r"), (3, "http://com/en/" + "x" * 9000, "h", "p", "r")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, URL string, path string, rule string")
    got = sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in filter_urls(pages, rules_table(spark)).collect())
    assert got == sorted((str(r[0]), *(str(x) if k == 2 else x for k, x in enumerate(brute(r[1], RULES)))) for r in rows)


def test_ties_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    tie = spark.createDataFrame([("allow", "b", "/c"), ("block", "b", "/c"), (None, "b", "/c"), ("block", None, "/")], "verdict string, rule_host string, rule_path string")
    assert filter_urls(pages, tie).first().verdict == "block"
    assert filter_urls(pages, tie.where("false"), "block").first().verdict == "block"
    assert filter_urls(pages.where("false"), tie).count() == 0
