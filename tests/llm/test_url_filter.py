import random
import time

from lumasift.llm import url_filter as U


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = rest[:cut].translate(U._UPPER), rest[cut:]
        path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (r.host.count("."), len(r.path)), default=None)
    return host, path, best and best.host + best.path, best.verdict if best else default


def test_against_brute_force(spark):
    rng = random.Random(2)
    hosts = ["net", "a.net", "example.net", "x.example.net", "Example.COM", "org", "b.org", "notexample.net", "", "example.com:80"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/de/y?q=/fr/", "/fr/#a", "?x", "#y", "/de//", "/fr"]
    urls = [f"{rng.choice(['http', 'https'])}://{h}{p}" for h in hosts for p in paths] + [None, "", "junk", "a://b://c/d"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = [*U.RULES, U.Rule("example.net", "/en/x", "block"), U.Rule("com", "/d", "block"), U.Rule("x.example.net", "", "allow")]
    for size in (1, 1 << 20):
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge(df, rules, max_trie_bytes=size).collect()}
        assert got == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_clashing_names_empty_and_no_rules(spark):
    df = spark.createDataFrame([(1, "http://a.net/x", "old", 5)], "page_id long, url string, host string, verdict int")
    r = U.judge(df, U.RULES).first()
    assert (r["host"], r["verdict"], r["page_id"]) == ("a.net", "block", 1)
    assert U.judge(df.limit(0), U.RULES).count() == 0
    assert U.judge(df, []).first()["verdict"] == "allow"


def test_many_rules_of_one_host():
    """Look-ups by length, not a scan of all rules; and equal rules, repeated rows and very long urls by both ways."""
    rules = [U.Rule("big.net", f"/p{k:05}", "block") for k in range(20_000)] + [U.Rule("big.net", "/p00007", "allow")]
    trie = U.Trie(rules)
    began = time.perf_counter()
    for _ in range(200):
        assert trie.find("a.big.net", "/p19999/x").path == "/p19999" and trie.find("big.net", "/q") is None
    assert time.perf_counter() - began < 0.5 and trie.find("big.net", "/p00007").verdict == "allow"


def test_join_equals_trie(spark):
    urls = ["http://x.big.net/p00007?a", "http://x.big.net/p00007?a", "http://BIG.net/p1", "http://big.net/" + "y" * 100_000, None, "junk", "http://big.net/\n/p"]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    rules = [U.Rule("big.net", f"/p{k:05}", "block") for k in range(300)] + [U.Rule("big.net", "/p00007", "allow"), U.Rule("net", "/", "block"), U.Rule("big.net", "", "allow")]
    one, two = (sorted(map(tuple, U.judge(df, rules, max_trie_bytes=size).collect()), key=repr) for size in (1, 1 << 20))
    assert one == two and len(one) == len(urls)
    assert U.judge(df.limit(0), rules, max_trie_bytes=1).count() == 0
