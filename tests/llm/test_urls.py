import random

from scriptorium.llm import urls


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
        tail = rest[end:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h), len(p), v, h + p) for v, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def judged(spark, values, rules=urls.RULES):
    df = spark.createDataFrame(list(enumerate(values)), "page_id long, url string").selectExpr("*", "'x' as host", "'y' as rule", "1 as start")
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df, urls.rule_table(spark, rules)).collect()}


def test_equals_brute_force(spark):
    random.seed(4)
    hosts = ["example.com", "www.example.com", "a.www.EXAMPLE.com", "net", "x.net", "badexample.com", "com", "x..com", "", "é.net"]
    paths = ["", "/", "/en/", "/en", "/en/x/y", "/es/1", "/fr/2.html", "?q=/en/", "#top", "/EN/"]
    values = [None, "", "no scheme", "a://b://c/en/", *(f"http://{random.choice(hosts)}{random.choice(paths)}{random.choice(['', '?a=b', '#c'])}" for _ in range(300))]
    got = judged(spark, values)
    assert [got[i] for i in range(len(values))] == [brute(v, urls.RULES) for v in values]


def test_rules_of_any_path_and_ties(spark):
    rules = [("allow", "a.org", "/x"), ("block", "a.org", "/x"), ("allow", "a.org", "/xyz"), ("block", "org", ""), ("block", None, "/")]
    values = ["http://a.org/x1", "http://a.org/xyz", "http://b.org", "http://b.net"]
    good = [r for r in rules if r[1]]
    got = judged(spark, values, rules)
    assert [got[i] for i in range(4)] == [brute(v, good) for v in values]


def test_no_rules_no_pages(spark):
    assert judged(spark, ["http://a.org/"], []) == {} or judged(spark, ["http://a.org/"], [])[0] == ("a.org", "/", None, "allow")
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(empty, urls.rule_table(spark)).count() == 0
