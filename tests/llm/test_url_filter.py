from graphloom.llm.url_filter import RULES, judge_urls


def brute(url, rules=RULES):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut].lower() if rest.isascii() else rest[:cut], rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow")


def test_against_brute_force(spark):
    urls = [None, "", "nothing", "http://", "http://COM/", "http://com", "https://Example.com/en/a?x=/es/", "http://www.example.com/en/", "http://x.www.example.com/en/1#a",
            "http://a.net/es/", "http://a.net/es", "http://net/fr/x", "http://xcom/", "http://a..com/en/", "http://h.example.com/en/#", "ftp://example.com?/en/", "http://a.net/de/http://b.com/"] * 2
    urls += ["http://" + "a." * 300 + "net/fr/" + "p" * 5000]
    pages = spark.createDataFrame([(i // 2, u, "html", "h") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    for bound in (100, 1):  # broadcast and shuffled rules
        got = sorted(map(tuple, judge_urls(pages, rules, broadcast_rules=bound).collect()), key=str)
        assert got == sorted(((i // 2, *brute(u)) for i, u in enumerate(urls)), key=str)


def test_rules_of_any_path_and_empty_tables(spark):
    rules = spark.createDataFrame([("a.org", "/e", "block"), ("a.org", "", "allow"), (None, "/", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://b.a.org/else"), (2, "http://a.org"), (3, "http://c.org/e")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in judge_urls(pages, rules).collect()}
    assert got == {1: ("a.org/e", "block"), 2: ("a.org", "allow"), 3: (None, "allow")}
    assert judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in judge_urls(pages, rules.limit(0), default="block").collect()} == {"block"}
