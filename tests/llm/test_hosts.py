from sitecast.llm import hosts
from sitecast.llm.queries import URL_RULES

PAGES = "page_id long, url string, outcome int, verdict string"


def judged(spark, rows, rules=URL_RULES):
    pages = spark.createDataFrame([(i, u, o, "x") for i, (u, o) in enumerate(rows)], PAGES)
    return {r["page_id"]: r for r in hosts.judge_urls(pages, rules).collect()}


def test_parts_and_rules(spark):
    urls = [
        ("http://A.Example.ORG/es/x?q=1", 1),
        ("https://example.org/en/12#t", 1),
        ("x://sub.org/", 1),
        ("http://org", 1),
        ("http://notcom/fr/", 1),
        ("http://a.com/de/1", 1),
        (None, 1),
        ("no scheme", 1),
        ("a://b.com/fr/?x://y", 1),
    ]
    got = judged(spark, urls)
    want = [
        ("a.example.org", "/es/x", "example.org/es/", "block"),
        ("example.org", "/en/12", "example.org/en/1", "block"),
        ("sub.org", "/", "org/", "allow"),
        ("org", "", None, "allow"),
        ("notcom", "/fr/", None, "allow"),
        ("a.com", "/de/1", "com/de/", "block"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("b.com", "/fr/", "com/fr/", "allow"),
    ]
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in range(9)] == want


def test_hosts_are_shrunk_towards_their_domain(spark):
    rows = [("http://g1.good.net/", 1)] * 40 + [("http://g2.good.net/", 1)] * 40
    rows += [("http://b1.bad.net/", 0)] * 40 + [("http://b2.bad.net/", 0)] * 40
    rows += [("http://new.good.net/", None), ("http://new.bad.net/", None), ("http://one.good.net/", 0)]
    got = judged(spark, rows, [])
    rate = {r["host"]: r["good_rate"] for r in got.values()}
    verdict = {r["host"]: r["verdict"] for r in got.values()}
    assert rate["new.bad.net"] < 0.2 < 0.8 < rate["new.good.net"]
    assert rate["b1.bad.net"] < rate["one.good.net"] < rate["g1.good.net"]
    assert verdict["g1.good.net"] == "allow"
    assert verdict["b1.bad.net"] == verdict["new.bad.net"] == "block"


def test_registered_domains_and_empty_table(spark):
    frame = spark.createDataFrame([("a.b.co.uk",), ("u@x.y.net:80",), ("net",), ("",)], "h string")
    domain, suffix = hosts.registered(frame["h"])
    got = [(r[0], r[1]) for r in frame.select(domain, suffix).collect()]
    assert got == [("b.co.uk", "co.uk"), ("y.net", "net"), ("net", "net"), ("", "")]
    assert judged(spark, []) == {}
    assert judged(spark, [("http://a.net/", None)])[0]["verdict"] in ("allow", "block")


def test_outcomes_of_missing_pages_and_clashing_names(spark):
    rows = [(1, None), (2, ""), (3, "<p>Plain words of a page.</p>"), (4, "#* $% |& x"), (5, "ALL LOUD <b>WORDS</b>")]
    pages = spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "'mine' AS visible", "'mine' AS Outcome")
    got = hosts.with_outcome(pages).collect()
    assert {r["page_id"]: r["outcome"] for r in got} == {1: None, 2: None, 3: 1, 4: 0, 5: 0}
    assert all(r["visible"] == "mine" for r in got)
