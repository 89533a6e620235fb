import itertools

from shardwise.llm import url_rules

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.net", "/en/x", "block"), ("example.com", "", "block"), ("a.example.com", "/q", "allow"), ("org", "/fr/", "allow"), (None, "/", "block"), ("", "/", "block")]


def verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:][: min([rest[cut:].find(c) for c in "?#" if c in rest[cut:]], default=len(rest))]
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_as_brute_force(spark):
    hosts = ["net", "example.net", "www.Example.NET", "badexample.net", "example.com", "a.example.com", "b.a.example.com", "x.org", "org", "com", "", "..net", "net."]
    paths = ["", "/", "/en", "/en/", "/en/xy", "/fr/1", "/q/z", "?a=/en/", "#/fr/", "/e\nn"]
    urls = [f"http://{h}{p}" for h, p in itertools.product(hosts, paths)] + [None, "", "no scheme", "https://x.net/en/?u=http://y.org/fr/"] + ["http://hot.example.net/en/1"] * 50 + [f"https://hot.example.net/en/{k}" for k in range(200)]
    df = spark.createDataFrame([(k, u, "h", "p") for k, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_rules.judge(df, rules).collect()}
    assert got == {k: verdict(u) for k, u in enumerate(urls)}


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "http://x.net/")], "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert tuple(url_rules.judge(df, rules, default="block").first()) == (1, "x.net", "/", None, "block")
    assert url_rules.judge(df.where("false"), spark.createDataFrame(RULES, "host string, path string, verdict string")).count() == 0
