from pyspark.sql import functions as F

from lumasift.functions import text as T
from lumasift.functions import url as U


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_canonical_key(spark):
    cases = {
        "http://a.b.example.com.cn:8080/x?y": "example.com.cn",
        "https://www.example.com/": "example.com",
        "http://192.168.10.7:8000/a": "192.168.10.7",
        "http://localhost:8080/app": "localhost",
        "http://user:pw@M.Example.org./p": "example.org",
        "http://[2001:DB8::1]/x": "2001:db8::1",
        "http://example.com:99999/": "",
        "http://a.b.123/": "a.b.123",
        "not a url": "",
        "": "",
        None: "",
    }
    for url, key in cases.items():
        assert one(spark, U.canonical_key(F.lit(url).cast("string"))) == key, url


def test_alias_label(spark):
    cases = {
        "https://www.example.com/": "www 前缀",
        "https://www.a.example.com:8443/x": "www 前缀/子域 a/端口 8443/带路径",
        "https://example.com": "主站",
        "nothing": "",
    }
    for url, label in cases.items():
        assert one(spark, U.alias_label(F.lit(url))) == label, url


def test_url_risk_weights(spark):
    url = "http://www-login.a.b.xn--p1ai.top:8080/" + "x" * 130 + "?q=" + "Ab1" * 12
    f = one(spark, U.url_features(F.lit(url)))
    assert f["punycode_host"] and f["suspicious_tld"] and f["subdomain_depth"] and f["nonstd_port"] and f["deceptive_prefix"] and f["plain_http"] and f["long_obfuscated_path"] and f["high_entropy_query"]
    assert one(spark, U.url_risk(U.url_features(F.lit(url)))) == 0.79
    assert one(spark, U.url_features(F.lit("junk"))["plain_http"]) is None


def test_normalised(spark):
    assert one(spark, U.normalised(F.lit(" example.com/a "))).asDict() == {"url": "https://example.com/a", "reason": None}
    assert one(spark, U.normalised(F.lit("ftp://example.com")))["reason"] == "scheme"
    assert one(spark, U.normalised(F.lit("  ")))["reason"] == "empty"


def test_within_domains(spark):
    assert one(spark, U.within_domains(F.lit("a.bad.com"), ["bad.com"]))
    assert not one(spark, U.within_domains(F.lit("notbad.com"), ["bad.com"]))


def test_tokens_and_names(spark):
    assert one(spark, T.tokens_cjk(F.lit("举报网站abc 1中"))) == ["举报", "报网", "网站", "abc", "1", "中"]
    assert one(spark, T.metric_name(F.lit("9a.b-c"))) == "_9a_b_c"
    assert one(spark, T.occurrences(F.lit("aaaa"), "aa")) == 2
    assert one(spark, T.refresh_target(F.lit('<meta http-equiv="refresh" content="0;url=/x">'))) == "/x"


def test_text_risk_caps(spark):
    r = one(spark, T.text_risk(F.lit("hot"), F.lit("hot hot cold"), ["hot"], ["cold"], []))
    assert r["u1"] == 1 and r["u2"] == 1 and r["u3"] == 0 and r["in_title"]
    assert abs(r["risk"] - (0.10 + 0.15 + 0.08 + 0.10)) < 1e-9


def test_ngrams_of_short_texts(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "a"), (3, None), (4, "abab")], "id long, text string")
    got = {(r["id"], r["gram"]): r["c"] for r in T.char_ngrams(df, "id", F.col("text")).collect()}
    assert got == {(1, "ab"): 1, (4, "ab"): 2, (4, "ba"): 1, (4, "aba"): 1, (4, "bab"): 1}


def test_addresses_of_version_6(spark):
    import ipaddress
    import random

    from lumasift.functions import url as U

    rng, rows = random.Random(6), []
    for _ in range(300):
        a = ipaddress.IPv6Address(sum((0 if rng.random() < 0.5 else rng.getrandbits(16)) << (16 * k) for k in range(8)))
        rows += [(a.exploded.upper(), a), (str(a), a)]
    rows = [(t, ":".join(str(a).split(":")) if "." not in str(a) else None) for t, a in rows]
    rows = [(t, want) for t, want in rows if want]
    odd = ["::", "::1", "1::", "2001:DB8:0:0:1:0:0:1", "fe80::1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8", "::2:3:4:5:6:7:8"]
    rows += [(t, str(ipaddress.IPv6Address(t)) if t != "fe80::1:2:3:4:5:6:7" else "fe80:0:1:2:3:4:5:6") for t in odd if t != "fe80::1:2:3:4:5:6:7"]
    rows += [("64:ff9b::192.0.2.33", "64:ff9b::c000:221"), ("1:2:3", "1:2:3"), ("1::2::3", "1::2::3"), ("g::1", "g::1"), ("1:2:3:4:5:6:7::8:9", "1:2:3:4:5:6:7::8:9"), ("12345::", "12345::")]
    df = spark.createDataFrame([(f"http://[{t}]/a", want) for t, want in rows], "url string, want string")
    got = df.select("url", "want", U.canonical_key(F.col("url")).alias("key")).collect()
    assert [(r["url"], r["key"]) for r in got] == [(r["url"], r["want"]) for r in got]


def test_iso_times_as_python_reads_them(spark):
    import datetime

    forms = ["2024-01-01T12:34:56.123456+08:00", "2024-01-01T12:34:56.123456+0800", "20240101T123456", "2024-01-01", "20240101", "2024-01-01 12:34", "2024-01-01T12", "2024-01-01T12:34:56Z", "2024-01-01T12+05"]
    forms += ["2024-13-01", "x", "2024-01-01T123456.5-0330", "2024-01-01T12:34:56,5", "2024-01", "2024-01-01T25:00", "", "2024-02-30", "20240101T1234Z"]

    def want(text):
        try:
            t = datetime.datetime.fromisoformat(text)
        except ValueError:
            return None
        return t.replace(tzinfo=t.tzinfo or datetime.timezone.utc).astimezone(datetime.timezone.utc)

    df = spark.createDataFrame([(t,) for t in forms] + [(None,)], "t string")
    got = {r["t"]: r["u"] for r in df.select("t", F.unix_micros(T.iso_utc(F.col("t"))).alias("u")).collect()}
    assert got == {t: None if want(t) is None else round(want(t).timestamp() * 1_000_000) for t in forms} | {None: None}


def test_plain_keys(spark):
    urls = {"http://a.b.com.cn/x": "b.com.cn", "http://a.co.uk": "co.uk", "https://x.y.museum": "y.museum", "http://x.123": "x.123", "http://localhost:8": "localhost", "http://10.0.0.1/": "10.0.0.1", "nothing": "", "": "", "http://[::1]/": "::1"}
    got = {r["u"]: (r["k"], r["n"]) for r in spark.createDataFrame([(u,) for u in urls], "u string").select("u", U.plain_key(F.col("u")).alias("k"), U.plain_name(F.col("u")).alias("n")).collect()}
    assert got == {u: (k, k or u) for u, k in urls.items()}
